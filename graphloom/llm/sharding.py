"""Sharding by jump consistent hashing, in DataFrame functions only.

The shard of a key follows from the key and the number of shards alone. No ring
table exists, and with one shard more, a key either stays or moves to the new
shard. A row's place in its shard comes from counts of bounded buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Multiplier of the generator that jump consistent hashing steps through (fixed value).
STEP = 2862933555777941757
#: Rows that a bucket of a shard holds, about.
BUCKET_ROWS = 20_000

_WORD = "decimal(20,0)"


def jump(key: Column, shards: int) -> Column:
    """The shard, from 0 to shards - 1, of a 64-bit key.

    Each step draws the next bucket that the key would jump to as shards are
    appended, from a 64-bit linear generator that starts at the key. Decimals
    stand for unsigned 64-bit numbers. A bucket grows at each step, so `shards`
    steps are always enough; a null key has no shard.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    wrap = F.lit(str(1 << 64)).cast("decimal(21,0)")
    start = F.when(key < 0, key.cast("decimal(21,0)") + wrap).otherwise(key.cast("decimal(21,0)")).cast(_WORD)

    def step(state: Column, _: Column) -> Column:
        product = (state["word"] * F.lit(STEP).cast("decimal(19,0)")).cast("decimal(38,0)") + F.lit(1).cast("decimal(1,0)")
        word = F.pmod(product.cast("decimal(38,0)"), wrap.cast("decimal(38,0)")).cast(_WORD)
        draw = F.floor(word / F.lit(1 << 33).cast("decimal(11,0)")).cast("double") + 1.0
        after = F.floor((state["next"].cast("double") + 1.0) * (F.lit(float(1 << 31)) / draw)).cast("long")
        return F.when(state["next"] < shards, F.struct(word.alias("word"), state["next"].alias("at"), after.alias("next"))).otherwise(state)

    zero = F.struct(start.alias("word"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    return F.when(key.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(shards)), zero, step, lambda s: s["at"])).cast("int")


def with_slots(rows: DataFrame, shard: str, order: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add slot: a gapless number from 0 in each shard.

    Rows that are equal in all columns are counted first, and get that many
    numbers in a row. A shard's different rows are dealt to buckets by hash,
    numbered in each bucket, and shifted by the rows of the buckets before it.
    No task sees a whole shard, or more than bucket_rows copies of a row.
    """
    columns = rows.columns
    n, last = rows.agg(F.count("*"), F.max(shard)).first()
    buckets = max(1, -(-n // (bucket_rows * ((last or 0) + 1))))
    rows = rows.groupBy(*columns).agg(F.count("*").alias("_n")).withColumn("_bucket", F.pmod(F.xxhash64(*order, F.lit(5)), F.lit(buckets)))
    inside = Window.partitionBy(shard, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_all"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(shard, "_bucket", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_shift"))
    at = rows.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(shift, [shard, "_bucket"]).withColumn("_from", F.col("_in") + F.col("_shift"))
    few = at.filter(F.col("_n") <= bucket_rows).select(*columns, F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_n") - 1)).alias("slot"))
    parts = at.filter(F.col("_n") > bucket_rows).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / bucket_rows)))).repartition("_part")
    low = F.col("_from") + F.col("_part") * bucket_rows
    many = parts.select(*columns, F.explode(F.sequence(low, F.least(low + bucket_rows, F.col("_from") + F.col("_n")) - 1)).alias("slot"))
    return few.unionByName(many)


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The key is doc_id; a null one counts as key 0. size is the text's UTF-8
    bytes and 1, for a null text 1; text_crc32 is over those bytes. grown_shard
    is the shard among shards + 1. Repeated rows and ids come out once each, in
    the same shard with slots of their own. An empty table gives no rows; other
    columns are ignored.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump(key, shards).alias("shard"),
        jump(key, shards + 1).alias("grown_shard"),
    )
    return with_slots(cut(rows), "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write the documents as Parquet, a folder for each shard.

    A null doc_id counts as key 0; null texts, repeated rows and columns of any
    name but shard, which is replaced, are written as they are. An empty table
    gives an empty folder.
    """
    docs.withColumn("shard", jump(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), shards)).write.partitionBy("shard").parquet(path)
