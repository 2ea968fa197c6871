"""Upserts, merges and checks of graph rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ids import edge_id
from ..functions.lineage import settled
from ..schema import EDGE_SOURCES, EDGE_TYPES, NODE_KINDS, PINS, GraphError


def upsert_nodes(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """The last row of each id; rows without id or name, or of unknown kind, are refused."""
    fit = rows.withColumn("id", F.trim("id")).filter((F.col("id") != "") & (F.trim("name") != "") & F.col("kind").isin(*NODE_KINDS))
    last = F.max_by(F.struct(*(c for c in fit.columns if c not in ("id", seq))), F.col(seq))
    return fit.groupBy("id").agg(last.alias("_last")).select("id", "_last.*")


def normal_sources(sources: Column) -> Column:
    """Distinct sources in order; null if one is unknown or none is there."""
    kept = F.array_distinct(sources)
    return F.when((F.size(kept) > 0) & F.forall(kept, lambda s: s.isin(*EDGE_SOURCES)), kept)


def valid_evidence(evidence: Column, sources: Column) -> Column:
    """Evidence is there, and each piece names a file, a line and a snippet unless only users or agents pinned the edge."""
    pinned = F.forall(sources, lambda s: s.isin(*PINS))
    whole = F.forall(evidence, lambda e: (F.coalesce(e["file"], F.lit("")) != "") & e["line"].isNotNull() & (F.coalesce(e["snippet"], F.lit("")) != ""))
    return F.coalesce((F.size(evidence) > 0) & (pinned | whole), F.lit(False))


def merge_edges(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per edge from raw rows (type, from_id, to_id, file, line, snippet, source, confidence, seq).

    Rows may bring an id of their own; without one it follows from type and
    ends. The first row of an id says what the edge is. Rows that give the id
    to another edge make it a conflict, and their evidence names the candidate.
    Evidence and sources keep their first appearance's order, the confidence is
    the largest. Repeats go before an edge's rows meet, so that its list holds
    different pieces only.
    """
    own = ["type", "from_id", "to_id"]
    named = rows.withColumn("_own", F.nullif(F.trim("id"), F.lit(""))) if "id" in rows.columns else rows.withColumn("_own", F.lit(None).cast("string"))
    once = named.groupBy("_own", *own, "file", "line", "snippet", "source").agg(F.min(seq).alias("seq"), F.max("confidence").alias("confidence"))
    once = once.withColumn("_id", F.coalesce("_own", edge_id(*own))).drop("_own").repartition("_id")  # all that follows stays where an id's rows are
    pieces = F.array_sort(F.collect_list(F.struct("seq", *own, "file", "line", "snippet", "source")))
    got = once.groupBy("_id").agg(pieces.alias("all"), F.max("confidence").alias("confidence")).withColumn("first", F.get("all", F.lit(0)))
    other = lambda x: (x["type"] != F.col("first.type")) | (x["from_id"] != F.col("first.from_id")) | (x["to_id"] != F.col("first.to_id"))
    piece = lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"), x["snippet"].alias("snippet"), F.when(other(x), F.concat_ws(" ", x["type"], x["from_id"], x["to_id"])).alias("candidate"))
    sources = F.array_sort(F.transform("all", lambda x: F.struct(x["seq"].alias("seq"), x["source"].alias("source"))))
    return got.select(
        F.col("_id").alias("id"), "first.type", "first.from_id", "first.to_id", F.array_distinct(F.transform("all", piece)).alias("evidence"),
        F.array_distinct(F.transform(sources, lambda x: x["source"])).alias("sources"), "confidence", F.exists("all", other).alias("conflict"),
    )


def _named_edges(rows: DataFrame) -> Column:
    own = edge_id("type", "from_id", "to_id")
    return F.coalesce(F.nullif(F.trim("id"), F.lit("")), own) if "id" in rows.columns else own


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with no: 1, 2, 3 and so on within each key, in the order given.

    Rows are sorted in ranges of key and order, so that a key of many rows lies
    in many ranges. A row's place follows from its place in its range and the
    sizes of the ranges before, and its number from its key's first place.
    """
    placed = settled(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))  # a row for each range
    at = placed.withColumn("_part", part).join(F.broadcast(shift), "_part").withColumn("_place", F.col("_shift") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    first = at.groupBy(key).agg(F.min("_place").alias("_first"))
    return at.join(first, key).select(*rows.columns, (F.col("_place") - F.col("_first") + 1).alias("no"))


def merged_rows(rows: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """merge_edges with evidence as rows: edges (id, type, from_id, to_id, n_evidence, sources, confidence, conflict) and evidence (id, no, file, line, snippet, candidate).

    Takes the same raw rows and gives the same pieces in the same order, but
    never gathers an edge's evidence in one row or task, so that one edge may
    have a third of all of it.
    """
    named = rows.withColumn("_id", _named_edges(rows)).withColumnRenamed(seq, "_seq")
    first = named.groupBy("_id").agg(F.min_by(F.struct("type", "from_id", "to_id"), F.struct("_seq", "type", "from_id", "to_id")).alias("first"))
    if "id" in rows.columns:
        named = named.join(first, "_id")
        other = (F.col("type") != F.col("first.type")) | (F.col("from_id") != F.col("first.from_id")) | (F.col("to_id") != F.col("first.to_id"))
        named = named.withColumn("candidate", F.when(other, F.concat_ws(" ", "type", "from_id", "to_id"))).drop("first")
    else:
        named = named.withColumn("candidate", F.lit(None).cast("string"))
    pieces = settled(named.groupBy("_id", "file", "line", "snippet", "candidate").agg(F.min("_seq").alias("_seq")))
    counts = pieces.groupBy("_id").agg(F.count("*").alias("n_evidence"), F.max(F.col("candidate").isNotNull()).alias("conflict"))
    sources = named.groupBy("_id", "source").agg(F.min("_seq").alias("_seq"), F.max("confidence").alias("confidence"))
    told = sources.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "source"))), lambda x: x["source"]).alias("sources"), F.max("confidence").alias("confidence"))  # as many as there are kinds of sources
    edges = first.join(counts, "_id").join(told, "_id").select(F.col("_id").alias("id"), "first.type", "first.from_id", "first.to_id", "n_evidence", "sources", "confidence", "conflict")
    evidence = numbered(pieces, "_id", "_seq", "file", "line", "snippet", "candidate")
    return edges, evidence.select(F.col("_id").alias("id"), "no", "file", "line", "snippet", "candidate")


def upsert_edges(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Merged edges of known type and sources whose ends exist and whose evidence holds."""
    known = nodes.select("id")
    fit = merge_edges(rows.filter(F.col("type").isin(*EDGE_TYPES)))
    fit = fit.withColumn("sources", normal_sources(F.col("sources"))).filter(F.col("sources").isNotNull() & valid_evidence(F.col("evidence"), F.col("sources")))
    for end in ("from_id", "to_id"):
        fit = fit.join(known.withColumnRenamed("id", end), end, "left_semi")
    return fit


def upsert_chunks(rows: DataFrame, nodes: DataFrame, seq: str = "seq") -> DataFrame:
    """The last chunk of each id, of existing nodes only."""
    last = rows.groupBy("id").agg(F.max_by(F.struct("node_id", "kind", "text"), F.col(seq)).alias("_last")).select("id", "_last.*")
    return last.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")


def mark_critical(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """nodes with those of the given ids critical; an id that no node has is an error."""
    missing = ids.select("id").join(nodes.select("id"), "id", "left_anti").first()
    if missing:
        raise GraphError(f"the graph has no node {missing.id}")
    marked = ids.select("id", F.lit(True).alias("_critical")).distinct()
    return nodes.join(marked, "id", "left").withColumn("critical", F.coalesce("_critical", "critical")).select(*nodes.columns)


def append_journal(journal: DataFrame, rows: DataFrame) -> DataFrame:
    """The journal (seq, ts, event, payload) with rows (ts, event, payload) after its last entry, in order of ts, event and payload.

    Only the new rows, which one run makes, are numbered in one window.
    """
    last = journal.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    order = Window.orderBy("ts", "event", "payload")
    new = rows.crossJoin(F.broadcast(last)).select((F.col("last") + F.row_number().over(order)).cast("long").alias("seq"), "ts", "event", "payload")
    return journal.select("seq", "ts", "event", "payload").unionByName(new)


def set_health(health: DataFrame, rows: DataFrame) -> DataFrame:
    """health (key, value, updated_at) with the last of rows for each key in place of its value."""
    last = rows.groupBy("key").agg(F.max_by(F.struct("value", "updated_at"), F.col("updated_at")).alias("_last")).select("key", "_last.*")
    return health.join(last.select("key"), "key", "left_anti").select("key", "value", "updated_at").unionByName(last)


def to_sync(scanned: DataFrame, stored: DataFrame, with_chunks: DataFrame, force: bool = False) -> DataFrame:
    """Each scanned file (path, sha256) and whether it is skipped: its digest is stored and its path has a chunk."""
    known = stored.select("path", "sha256").distinct().withColumn("_same", F.lit(True))
    held = with_chunks.select("path").distinct().withColumn("_held", F.lit(True))
    marked = scanned.join(known, ["path", "sha256"], "left").join(held, "path", "left")
    skip = F.coalesce(F.col("_same") & F.col("_held"), F.lit(False)) & F.lit(not force)
    return marked.select("path", "sha256", F.when(skip, "skip").otherwise("index").alias("action"))


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph's four checks: name, failed rows, ok; and conflicts as a fifth row. edges have n_evidence and sources_ok."""
    own = ["type", "from_id", "to_id"]
    # ends that no node has are told from distinct ends; edges are looked through only where there are any
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("end")).distinct()
    gone = settled(ends.join(nodes.select(F.col("id").alias("end")), "end", "left_anti"))
    lost = gone.select(F.col("end").alias("id"))
    if not gone.isEmpty():
        lost = reduce(DataFrame.union, [edges.select("id", F.col(c).alias("at")).join(gone, F.col("at").eqNullSafe(F.col("end")), "left_semi").select("id") for c in own[1:]])
    dangling = lost.distinct().agg(F.count("*").alias("failed")).withColumn("name", F.lit("dangling_edges"))
    # edges of one hash may be the same edge; only where there are such, edges meet by type and ends
    per = edges.groupBy(F.xxhash64(*own)).agg(F.count_if(F.col("n_evidence") == 0).alias("missing_evidence"), F.count_if(~F.col("sources_ok")).alias("bad_sources"), F.count_if(F.col("conflict")).alias("conflicts"), F.count("*").alias("n"))
    counts = settled(per.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("missing_evidence", "bad_sources", "conflicts")), F.count_if(F.col("n") > 1).alias("alike")))
    doubles = counts.select(F.col("alike").alias("failed"))
    if doubles.first().failed:
        doubles = edges.groupBy(*own).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("failed"))
    doubles = doubles.withColumn("name", F.lit("duplicate_edges"))
    stacked = counts.selectExpr("stack(3, 'missing_evidence', missing_evidence, 'bad_sources', bad_sources, 'conflicts', conflicts) as (name, failed)")
    rows = dangling.select("name", "failed").union(stacked).union(doubles.select("name", "failed"))
    return rows.select("name", F.col("failed").cast("long").alias("failed"), (F.col("failed") == 0).alias("ok"))
