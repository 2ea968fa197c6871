"""A workspace's graph kept up to date by batches or by a stream of file events.

What each file says is stored by file and batch, and a row for each file in each
batch tells which batch holds for it, or that it is gone. A batch only adds:
it writes what its changed files say and last its row for each file, which
makes them count. So a batch that fails half-way changes nothing, and one that
runs again replaces itself. The graph is derived from what holds, by the same
joins as a whole sync; only changed files are read and parsed.

A stream finds the changes: the state of each path is its last digest, so that
events that bring nothing new stop there.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions.lineage import settled
from ..sources import extract

#: Events: a file as it is now, or removed; of several of one path the one of the largest seq holds.
EVENTS = "repo string, path string, content string, sha256 string, removed boolean, seq long"
_CHANGED = "key string, repo string, path string, content string, sha256 string, removed boolean"
_TABLES = {"nodes": "seq.file", "edges": "seq.file", "chunks": "seq.file", "unresolved": "key"}


def key_of() -> Column:
    """A file's path with its repository in front."""
    return F.when(F.col("repo").isNotNull(), F.concat(F.lit("repo:"), "repo", F.lit("/"), "path")).otherwise(F.col("path"))


def apply(base: str, batch: int, changed: DataFrame) -> None:
    """Store a batch: changed (key, repo, path, content, sha256, removed) has a row for each new, changed or removed file."""
    changed = settled(changed.select("key", "repo", "path", "content", "sha256", F.coalesce("removed", F.lit(False)).alias("removed")))
    got = extract.parse(changed.filter("not removed").select("repo", "path", "content"))
    for name, key in _TABLES.items():
        getattr(got, name).withColumn("_key", F.col(key)).write.mode("overwrite").parquet(f"{base}/{name}/batch={batch}")
    told = changed.agg(F.lit("sync").alias("event"), F.to_json(F.struct(F.count_if(~F.col("removed")).alias("changed"), F.count_if("removed").alias("removed"))).alias("payload"), F.current_timestamp().alias("ts"))
    told.write.mode("overwrite").parquet(f"{base}/journal/batch={batch}")
    changed.select(F.col("key").alias("_key"), "repo", "sha256", "removed").write.mode("overwrite").parquet(f"{base}/files/batch={batch}")


def _read(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}").withColumn("batch", F.col("batch").cast("long"))


def files(spark: SparkSession, base: str) -> DataFrame:
    """(key, repo, sha256, batch) of the files that the workspace has, with the batch that holds."""
    last = _read(spark, base, "files").groupBy("_key").agg(F.max_by(F.struct("repo", "sha256", "removed", "batch"), F.col("batch")).alias("f"))
    return last.filter("not f.removed").select(F.col("_key").alias("key"), "f.repo", "f.sha256", "f.batch")


def said(spark: SparkSession, base: str) -> extract.Parsed:
    """What the workspace's files say as they are now."""
    holds = settled(files(spark, base).select(F.col("key").alias("_key"), "batch"))
    return extract.Parsed(*(_read(spark, base, name).join(holds, ["_key", "batch"], "left_semi").drop("_key", "batch") for name in ("nodes", "edges", "chunks", "unresolved")))


def graph(spark: SparkSession, base: str) -> extract.Synced:
    """The graph of the workspace as it is now: what a whole sync of its files gives."""
    held = files(spark, base)
    return extract.derived(said(spark, base), held.agg(F.count_distinct("repo").alias("roots"), F.count("*").alias("files")), held.filter(F.col("batch") == held.agg(F.max("batch")).first()[0]).agg(F.count("*").alias("changed")))


def journal(spark: SparkSession, base: str) -> DataFrame:
    """(seq, ts, event, payload): one entry for each batch."""
    return _read(spark, base, "journal").select(F.col("batch").alias("seq"), "ts", "event", "payload")


def sync_into(base: str, scanned: DataFrame, force: bool = False) -> int:
    """Bring a stored workspace to what a scan of all its files (repo, path, content, sha256) shows, and give the batch's number.

    Files whose stored digest is the same are left alone unless forced; stored
    ones that the scan doesn't have are removed.
    """
    spark = scanned.sparkSession
    scanned = scanned.withColumn("key", key_of())
    try:
        known = files(spark, base).select("key", F.col("sha256").alias("was"), "batch")
        batch = _read(spark, base, "files").agg(F.max("batch")).first()[0] + 1
    except Exception as e:
        if getattr(e, "getCondition", lambda: None)() != "PATH_NOT_FOUND":
            raise
        known, batch = spark.createDataFrame([], "key string, was string, batch long"), 0
    met = scanned.join(known, "key", "full")
    new = met.filter(F.col("path").isNotNull() & (F.col("was").isNull() | (F.col("was") != F.col("sha256")) | F.lit(force))).select("key", "repo", "path", "content", "sha256", F.lit(False).alias("removed"))
    gone = met.filter(F.col("path").isNull()).select("key", *(F.lit(None).cast("string").alias(c) for c in ("repo", "path", "content", "sha256")), F.lit(True).alias("removed"))
    apply(base, batch, new.union(gone))
    return batch


def changes(events: DataFrame) -> DataFrame:
    """Of a stream of EVENTS, the files that are new, changed or gone, each once a batch. A path's state is its last digest."""

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = None
        for rows in parts:
            best = rows.loc[rows["seq"].idxmax()]
            if last is None or best["seq"] >= last["seq"]:
                last = best
        if last is None:
            return
        removed = bool(last["removed"])
        before = state.get[0] if state.exists else None
        if removed and before is None or not removed and before == last["sha256"]:
            return
        if removed:
            state.remove()
        else:
            state.update((last["sha256"],))
        yield pd.DataFrame([{"key": key[0], **{c: last[c] for c in ("repo", "path", "content", "sha256")}, "removed": removed}])

    told = events.filter("path is not null").withColumn("key", key_of()).withColumn("removed", F.coalesce("removed", F.lit(False))).withColumn("seq", F.coalesce("seq", F.lit(0)))
    return told.groupBy("key").applyInPandasWithState(step, _CHANGED, "sha256 string", "update", "NoTimeout")


def start(events: DataFrame, base: str, checkpoint: str) -> StreamingQuery:
    """Keep the workspace in base up to date with a stream of EVENTS, until what is there now has been read."""
    run = changes(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: apply(base, batch, rows))
    return run.trigger(availableNow=True).start()


def keep_up(spark: SparkSession, source: str, base: str, checkpoint: str) -> None:
    """Read the events that files in the folder source have brought since the last time."""
    start(spark.readStream.schema(EVENTS).parquet(source), base, checkpoint).awaitTermination()
