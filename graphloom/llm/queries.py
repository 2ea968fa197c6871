"""The operators' queries over the driver's tables, under their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 16)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """secrets, a kind that the contract's list doesn't have, stand in columns of their own; n_found counts all spans."""
    from .pii import KINDS, find_pii

    found = find_pii(table(spark, sf_dir, "documents"))
    personal, secret = F.filter("spans", lambda s: s["kind"].isin(*KINDS)), F.filter("spans", lambda s: ~s["kind"].isin(*KINDS))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(personal).alias("spans"), listed(secret).alias("secrets"), F.size("spans").cast("long").alias("n_found"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), limit=2048)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, ~held_out("doc_id")).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fim import fill_in_middle

    return fill_in_middle(table(spark, sf_dir, "documents")).drop("output")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_packing, op2_decontamination, op3_sharding, op4_pii, op5_token_counts, op6_jaccard_join, op7_language_id, op8_html_extraction, op9_chat_format, op10_quality_rules, op11_importance_resampling, op12_fill_in_middle, op13_simhash)}


def oracle_sql() -> dict[str, str]:
    from .decontaminate import ORACLE as leaks_sql
    from .fim import ORACLE as fim_sql
    from .importance import ORACLE as importance_sql

    return {"op2_decontamination": leaks_sql, "op11_importance_resampling": importance_sql, "op12_fill_in_middle": fim_sql}
