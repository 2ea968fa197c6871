"""Lexical search over an inverted index that is kept with its graph.

The index holds postings (token, uid), bucketed by token, a vocabulary and the
searched texts, bucketed by uid. A query prunes the postings to its tokens'
buckets. A phrase may begin and end inside a token; the vocabulary tells which
tokens can hold its ends, their postings which texts can hold it, and only
those texts are read. A report of the best nodes reads fewer still: texts whose
upper bound is below what the last wanted node has without a phrase are never
read, and the best bounds come first.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ids import tokens
from ..functions.lineage import bucketed, settled
from ..schema import Graph

#: What a phrase and an exact id or name add to the share of tokens that are met.
PHRASE, EXACT = 0.75, 1.0
#: Texts of the best upper bounds that a report reads first, by their numbers.
FIRST = 256
#: A query's conditions on tokens that are looked up before texts are read; more only make the look-up closer.
CONDITIONS = 48

_TOKEN = re.compile(r"[a-z0-9_@./:-]+")


def index(graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings (token, uid), vocabulary (token, n) and texts (uid, node_id, kind, exact names and what is searched), made once for a graph.

    A token that a third of all texts hold has postings in several files of its
    bucket, as the writing tasks are dealt by token and uid.
    """
    if "search texts" not in graph.kept:
        named = graph.nodes.select(F.col("id").alias("node_id"), "name", F.col("kind").alias("node_kind"))
        met = graph.chunks.select("node_id", "kind", "text").join(named, "node_id")
        low = F.lower(F.concat_ws(" ", "node_id", "name", "text"))
        rows = settled(met.select("node_id", "kind", "node_kind", "name", low.alias("hay")).withColumn("uid", F.monotonically_increasing_id()))
        graph.kept["search texts"] = bucketed(rows, "uid")
        postings = rows.select("uid", F.explode(tokens(F.col("hay"))).alias("token"))
        graph.kept["search postings"] = bucketed(postings, "token", "uid", spread="uid")
        graph.kept["search vocabulary"] = bucketed(graph.kept["search postings"].groupBy("token").agg(F.count("*").alias("n")), "token")
    return tuple(graph.kept[f"search {x}"] for x in ("postings", "vocabulary", "texts"))


def _wanted(query: str) -> list[str]:
    return list(dict.fromkeys(_TOKEN.findall(query.lower())))


def _overlaps(postings: DataFrame, query: str) -> DataFrame:
    """(uid, overlap): the share of the query's tokens that a text holds."""
    wanted = _wanted(query)
    return postings.filter(F.col("token").isin(*wanted)).groupBy("uid").agg((F.count("*") / len(wanted)).alias("overlap"))


def _phrase_conditions(query: str) -> list[tuple[str, str]]:
    """What tokens a text with the phrase must hold: (equals, token), and (ends, token), (starts, token) or (holds, token) where the phrase may begin or end inside one."""
    low = query.lower()
    found = list(_TOKEN.finditer(low))
    out = []
    for m in found:
        inside_left, inside_right = m.start() == 0, m.end() == len(low)
        out.append(("holds" if inside_left and inside_right else "ends" if inside_left else "starts" if inside_right else "equals", m[0]))
    return list(dict.fromkeys(out))[:CONDITIONS]


def _may_hold(postings: DataFrame, vocabulary: DataFrame, query: str) -> DataFrame:
    """(uid): texts that hold a token for each condition of the phrase."""
    parts = []
    conditions = _phrase_conditions(query)
    for k, (how, t) in enumerate(conditions):
        if how == "equals":
            met = postings.filter(F.col("token") == t)
        else:
            test = {"ends": F.endswith, "starts": F.startswith, "holds": F.contains}[how]
            met = postings.join(vocabulary.filter(test("token", F.lit(t))).select("token"), "token", "left_semi")
        parts.append(met.select("uid", F.lit(1 << k).cast("long").alias("bit")))
    return reduce(DataFrame.union, parts).groupBy("uid").agg(F.bit_or("bit").alias("bits")).filter(F.col("bits") == (1 << len(conditions)) - 1).select("uid")


def _scored(texts: DataFrame, query: str, phrase: DataFrame, postings: DataFrame, kind: str | None) -> DataFrame:
    """(uid, node_id, node_kind, name, score) of the texts that hold a token or the phrase (uid)."""
    low = query.lower()
    told = texts if kind is None else texts.filter(F.col("kind") == kind)
    exact = F.when((F.lower("node_id") == low) | (F.lower("name") == low), EXACT).otherwise(0.0)
    both = _overlaps(postings, query).join(phrase.withColumn("phrase", F.lit(PHRASE)), "uid", "full").select("uid", (F.coalesce("overlap", F.lit(0.0)) + F.coalesce("phrase", F.lit(0.0))).alias("part"))
    return told.select("uid", "node_id", "node_kind", "name", exact.alias("exact")).join(both, "uid").select("uid", "node_id", "node_kind", "name", (F.col("part") + F.col("exact")).alias("score"))


def _holding(texts: DataFrame, query: str, among: DataFrame) -> DataFrame:
    """(uid): those of the texts `among` that hold the phrase."""
    return texts.join(among, "uid", "left_semi").filter(F.contains("hay", F.lit(query.lower()))).select("uid")


def search(graph: Graph, query: str, kind: str | None = None) -> DataFrame:
    """(node_id, score): every node with a chunk that holds a token of the query or the phrase itself, its best chunk's score.

    The share of the query's tokens, a phrase's bonus and an exact id's or
    name's. kind is the chunks'. The query needs a token.
    """
    postings, vocabulary, texts = index(graph)
    held = _holding(texts, query, _may_hold(postings, vocabulary, query))
    return _scored(texts, query, held, postings, kind).groupBy("node_id").agg(F.round(F.max("score"), 6).alias("score"))


def search_top(graph: Graph, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """The best nodes in order, ties by kind and id in the order of Unicode's default collation: (rank, id, kind, name, score)."""
    limit = max(1, min(50, limit))
    postings, vocabulary, texts = index(graph)
    unread = texts.limit(0).select("uid")
    # every score without a phrase, and whether a phrase may be there; a phrase without any whole token may be there too
    may = _may_hold(postings, vocabulary, query).withColumn("may", F.lit(True))
    sure = _scored(texts, query, unread, postings, kind).select("uid", "score")
    told = texts if kind is None else texts.filter(F.col("kind") == kind)
    bounds = settled(told.select("uid", "node_id", "node_kind", "name").join(sure.join(may, "uid", "full"), "uid").select("uid", "node_id", "node_kind", "name", F.coalesce("score", F.lit(0.0)).alias("low"), F.coalesce("may", F.lit(False)).alias("may")))
    order = [F.desc("score"), F.expr("node_kind COLLATE UNICODE"), F.expr("node_id COLLATE UNICODE"), F.col("node_kind"), F.col("node_id")]

    def best(rows: DataFrame) -> DataFrame:
        per = rows.filter("score > 0").groupBy("node_id", "node_kind", "name").agg(F.round(F.max("score"), 6).alias("score"))
        return per.orderBy(*order).limit(limit)

    low = best(bounds.withColumn("score", F.col("low"))).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    floor = low.least - 1e-6 if low.n == limit else 0.0
    asked = bounds.filter("may").withColumn("score", F.col("low") + PHRASE).filter(F.col("score") >= floor)
    first = [r.uid for r in asked.orderBy(*order).limit(FIRST).select("uid").collect()]
    read = _holding(texts.filter(F.col("uid").isin(first)), query, texts.filter(F.col("uid").isin(first)).select("uid")) if first else unread

    def result(held: DataFrame) -> DataFrame:
        return best(bounds.join(held.withColumn("held", F.lit(PHRASE)), "uid", "left").withColumn("score", F.col("low") + F.coalesce("held", F.lit(0.0))))

    top = settled(result(read))
    if len(first) == FIRST:  # the texts not read may still be better than the last one
        rest = asked.filter(~F.col("uid").isin(first))
        least = top.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        after = asked.orderBy(*order).limit(FIRST + 1).agg(F.min("score").alias("next")).first().next
        if least.n < limit or after >= least.least - 1e-6:
            top = settled(result(read.union(_holding(texts, query, rest.select("uid")))))
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), F.col("node_id").alias("id"), F.col("node_kind").alias("kind"), "name", "score")
