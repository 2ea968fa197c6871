"""Cutting long plans where jobs go on from what is written."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def new_folder(spark: SparkSession) -> str:
    """A new folder below the session's spark.checkpoint.dir. One is made only where that is unset and Spark runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/graphloom/{uuid.uuid4().hex}"


def settled(df: DataFrame, by: str | None = None) -> DataFrame:
    """The frame written to the shared checkpoint folder and read again.

    Loops then plan each round from files: plans don't grow, and a lost
    executor costs one round at most. `by` names a column whose values get
    folders of their own, so that filters on it read nothing else.
    """
    path = new_folder(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def bucketed(df: DataFrame, by: str, *order: str, spread: str | None = None, number: str | None = None) -> DataFrame:
    """The frame stored in the shared checkpoint folder as a table with a file for each bucket of a column, sorted by it and `order`.

    Joins and windows on that column then read it without an exchange, and
    filters on its values read their buckets only. There are as many buckets as
    the session has shuffle partitions. `spread` names a column by which a
    bucket is dealt to several tasks and files, for values that many rows have.
    `number` names a column for each row's place among those of its value, in
    `order`, which takes no exchange beside the buckets' own.
    """
    spark = df.sparkSession
    path, n = new_folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"graphloom_{uuid.uuid4().hex}"
    # a task gets whole shares of buckets, so that there are at most four files for each
    dealt = df.repartition(n, by) if spread is None else df.repartition(4 * n, F.pmod(F.hash(by), F.lit(n)), F.pmod(F.xxhash64(spread), F.lit(4)))
    dealt = dealt if number is None else dealt.withColumn(number, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    dealt.write.bucketBy(n, by).sortBy(by, *order).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)
