"""From raw documents to packed training windows, one operator a stage.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and works on
all that the stage before it kept; all but the last return the columns of
documents, and run() writes each result to the shared folder and reads it
again, so that lost executors cost one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, held_out, table
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.jaccard_join import keep_one
from graphloom.llm.langid import identify
from graphloom.llm.packing import pack
from graphloom.llm.pii import redact

#: A document stays if its language has at least this probability.
LEAST_SCORE = 0.5
#: The tokenizer whose ids the packed windows hold.
TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; null texts, texts without letters and unsure ones go."""
    found = identify(docs, ~held_out("doc_id"))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8."""
    return keep_one(docs, width=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows' pieces."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language ID", language), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark), ("PII", personal_data), ("packing", packing)]
#: SQL can't express a trained network or field; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
