"""Benchmark decontamination by size-partitioned MinHash containment search.

All in DataFrame functions. Test items are short and documents long, so their
Jaccard similarity is close to nothing and minima over whole documents would
almost never meet. The search therefore keeps minima on the items' side only:
under one min-wise hash, each item is sketched by its p smallest shingle
hashes. Items are partitioned by size, and p follows from a partition's sizes:
a document that holds a share t of an item's n shingles lacks at most
n - ceil(t * n) of them, so of any n - ceil(t * n) + 1 it holds at least one.
A document that meets no minimum cannot contain the item; every one that does
is verified with all of its shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Words in a shingle, and the share of an item's shingles that counts as a leak.
WIDTH, SHARE_PERCENT = 5, 80
#: Words that an item needs at least.
LEAST_WORDS = 3
#: Parts that a shingle's documents are dealt to where they meet items by shuffle.
SALTS = 16
#: Items' shingles are broadcast up to this many, about 30 MB; beyond it they are joined by shuffle.
BROADCAST_SHINGLES = 500_000
#: Size partitions' upper ends grow by this factor.
RATIO = 2


def words(text: str | Column) -> Column:
    """Lower-case runs of letters and digits; null has none."""
    c = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    # only the ends can be empty; a lambda's argument is evaluated once
    first = lambda w: F.when(F.get(w, F.lit(0)) == "", 2).otherwise(1)
    last = lambda w: F.when(F.element_at(w, -1) == "", 1).otherwise(0)
    return F.get(F.transform(F.array(parts), lambda w: F.slice(w, first(w), F.greatest(F.size(w) - first(w) + 1 - last(w), F.lit(0)))), F.lit(0))


def shingles(list_of_words: Column, width: int) -> Column:
    """64-bit hashes of the word shingles at each place; shorter lists have none. A shingle's width goes into its hash."""
    hashed = F.transform(list_of_words, lambda w: F.xxhash64(w))

    def placed(h: Column) -> Column:
        at = lambda i: F.xxhash64(F.lit(width), *(F.get(h, i + k) for k in range(width)))
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0))), lambda _, i: at(i))

    return F.get(F.transform(F.array(hashed), placed), F.lit(0))


def _rank(shingle: Column) -> Column:
    """The min-wise hash that orders shingles."""
    return F.xxhash64(shingle, F.lit(97))


def _of_widths(w: Column, widths: list[int]) -> Column:
    """The shingles of several widths in one list."""
    return F.get(F.transform(F.array(w), lambda x: F.concat(*(shingles(x, n) for n in widths))), F.lit(0))


def item_sketches(items: DataFrame, width: int, percent: int, least: int) -> DataFrame:
    """One row per item and distinct shingle: item_id, n, shingle, in_sketch. A short item's whole sequence is one shingle."""
    listed = items.select("item_id", words("text").alias("w"))
    short = lambda n: F.when(F.size("w") == n, shingles(F.col("w"), n))
    own = F.coalesce(*(short(n) for n in range(least, width)), shingles(F.col("w"), width))
    sets = listed.select("item_id", F.array_distinct(own).alias("all")).dropDuplicates()
    sized = sets.withColumn("n", F.size("all")).filter("n > 0")
    part = F.floor(F.log2("n") / F.log2(F.lit(float(RATIO))))
    largest = F.least(F.pow(F.lit(float(RATIO)), part + 1) - 1, F.lit(2.0**30)).cast("long")
    lacking = largest - F.ceil(largest * percent / 100)
    keep = F.least(F.col("n").cast("long"), lacking + 1)
    ordered = F.slice(F.transform(F.array_sort(F.transform("all", lambda s: F.struct(_rank(s).alias("r"), s.alias("s")))), lambda x: x["s"]), 1, keep.cast("int"))
    return sized.withColumn("sketch", ordered).select("item_id", "n", "sketch", F.explode("all").alias("shingle")).select("item_id", "n", "shingle", F.array_contains("sketch", F.col("shingle")).alias("in_sketch"))


def _leaks(docs: DataFrame, items: DataFrame, keys: list[str], width: int, percent: int, least: int) -> DataFrame:
    """One row per document, as its keys name it, and item: the keys, item_id, n_shared, n_item."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    # no document needs shingles of a width that no item has
    short = items.select(F.size(words("text")).alias("n")).filter((F.col("n") >= least) & (F.col("n") < width)).distinct()
    widths = [width, *sorted(r[0] for r in short.collect())]
    known = cut(item_sketches(items, width, percent, least))
    small = known.count() <= BROADCAST_SHINGLES
    placed = docs.select(*keys, F.explode(F.array_distinct(_of_widths(words("text"), widths))).alias("shingle"))
    minima = known.filter("in_sketch").select("shingle").distinct()

    def met_with(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        if small:
            return left.join(F.broadcast(right), "shingle", how)
        # a passage that a third of all documents share is dealt to SALTS tasks
        salt = F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")
        return left.withColumn("_salt", salt).join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["shingle", "_salt"], how).drop("_salt")

    met = cut(met_with(placed, minima, "left_semi").select(*keys).distinct())
    same = [docs[k].eqNullSafe(met[k]) for k in keys]
    suspects = docs.join(met, same[0] if len(same) == 1 else same[0] & same[1], "left_semi")
    suspects = suspects.select(*keys, F.explode(F.array_distinct(_of_widths(words("text"), widths))).alias("shingle"))
    shared = met_with(suspects, known.drop("in_sketch"), "inner").groupBy(*keys, "item_id", "n").agg(F.countDistinct("shingle").alias("n_shared"))
    return shared.filter(F.col("n_shared") * 100 >= F.col("n") * percent).groupBy(*keys, "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n").cast("long").alias("n_item"))


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = SHARE_PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """One row per document and item of which it holds enough: doc_id, item_id, n_shared, n_item.

    A document holds an item when at least `percent` of the item's distinct
    word shingles stand in its text, wherever they stand. Words are runs of
    letters and digits in lower case. An item with fewer than `width` words is
    one shingle, its whole sequence; one with fewer than `least` is found in
    too many clean texts and matches nothing. Null and empty texts match
    nothing. Shingles compare by 64-bit hashes. Repeated documents and items
    give one row for their ids; rows that share a doc_id are one document, and
    rows without one can't be named and are left out. Empty tables give no
    rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull())
    return _leaks(docs, items, ["doc_id"], width, percent, least)


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = SHARE_PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """The documents that hold no test item.

    Rows are told apart by doc_id and text, so that one that shares its id with
    a leak stays, and one without an id goes if it leaks. Null and empty texts
    stay, as all rows do where there are no items; repeated rows stay or go
    together. All columns stay as they are, whatever their names.
    """
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row.alias("row"))
    bad = cut(_leaks(told, items, ["row", "doc_id"], width, percent, least).select(F.col("row").alias("_row"), F.col("doc_id").alias("_id")).distinct())
    key = "row"
    while key in docs.columns:
        key += "_"
    left = docs.withColumn(key, row)
    return left.join(bad, (left[key] == bad["_row"]) & left["doc_id"].cast("long").eqNullSafe(bad["_id"]), "left_anti").select(*docs.columns)


#: The same rows in DuckDB, from the shingles as text.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) AS s FROM w
  UNION SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 2), lambda k: array_to_string(ws[k:k + 3], ' '))) AS s FROM w WHERE EXISTS (SELECT 1 FROM i WHERE len(i.ws) = 4)
  UNION SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda k: array_to_string(ws[k:k + 2], ' '))) AS s FROM w WHERE EXISTS (SELECT 1 FROM i WHERE len(i.ws) = 3)
), its AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) IN (3, 4) THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' ')) END) AS s FROM i
), n AS (SELECT item_id, count(*) AS n FROM its GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n) AS n_item
FROM ds JOIN its USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) * 100 >= any_value(n) * 80
"""
