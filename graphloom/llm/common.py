"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: White space that ends a word in the contracts, as a Java and RE2 class.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the one that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset and
    Spark runs in one process, as in tests, a temporary folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/graphloom/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it again.

    Lost executors then cost no recomputation of what came before, the plan
    stays short, and several readers share one evaluation.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id, as text, leaves 2 when divided by 4."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def freed(run: Batches, forget: Callable[[], None]) -> Batches:
    """For mapInArrow: run, which gives its caches' memory back when a task ends.

    Spark's Python workers outlive their tasks and go on to others; what a task
    has cached must not weigh on the stages that follow.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return task


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about `most` bytes together; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def unit_hash(c: Column, seed: int) -> Column:
    """A number in [0, 1) that a column's value and the seed decide."""
    return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
