"""Ordered scans, lookups and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import bucketed, settled
from ..schema import EDGE_TYPES, Graph, GraphError

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def clamp(limit: int, most: int) -> int:
    return max(1, min(most, int(limit)))


def list_nodes(nodes: DataFrame, limit: int = 50) -> DataFrame:
    return nodes.orderBy("kind", "id").limit(clamp(limit, 500))


def list_edges(edges: DataFrame, limit: int = 100) -> DataFrame:
    return edges.orderBy("id").limit(clamp(limit, 1000))


def list_chunks(chunks: DataFrame, limit: int = 1000) -> DataFrame:
    return chunks.orderBy("id").limit(clamp(limit, 5000))


def list_journal(journal: DataFrame, event: str | None = None, limit: int = 100) -> DataFrame:
    """Entries (seq, ts, event, payload), of one event if given, the newest first."""
    kept = journal.filter(F.col("event") == event) if event else journal
    return kept.orderBy(F.desc("seq")).limit(clamp(limit, 1000))


def get(rows: DataFrame, id_: str) -> DataFrame:
    """The node, edge or chunk of an id."""
    return rows.filter(F.col("id") == id_)


def resolve(nodes: DataFrame, identifier: str) -> str:
    """The id of the node meant: the one of that id, or else the first that find_nodes gives."""
    wanted = (identifier or "").strip()
    found = get(nodes, wanted).select("id").first() or (wanted and find_nodes(nodes, wanted, limit=1).select("id").first())
    if not found:
        raise GraphError(f"no node is named {identifier}")
    return found.id


def file_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'File'").orderBy("path", "id")


def nodes_by_kinds(nodes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return nodes.filter(F.col("kind").isin(*kinds))


def edges_by_types(edges: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return edges.filter(F.col("type").isin(*types))


def folded(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, _UPPER, _LOWER)


def find_nodes(nodes: DataFrame, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Nodes whose id or name holds the query, % and _ being wildcards: exact ones first, then by kind and id."""
    if not query:
        raise ValueError("an empty query finds nothing")
    pattern = "%" + query.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\") + "%"
    hit = nodes.filter(folded(F.col("id")).like(pattern) | folded(F.col("name")).like(pattern))
    hit = hit.filter(F.col("kind") == kind) if kind else hit
    exact = (F.col("id") == query) | (F.col("name") == query)
    return hit.withColumn("exact", exact).orderBy(F.desc("exact"), "kind", "id").limit(clamp(limit, 50))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree): a loop counts in both of the first, in one pass over the edges."""
    return end_counts(edges).drop("incident")


def end_counts(edges: DataFrame) -> DataFrame:
    """degrees, and incident: the edges at a node, a loop once."""
    end = lambda c, into: F.struct(F.col(c).alias("id"), F.lit(into).alias("into"), (F.col("from_id") == F.col("to_id")).alias("loop"))
    ends = edges.select(F.explode(F.array(end("from_id", 0), end("to_id", 1))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.count_if(F.col("into") == 1).alias("in_degree"), F.count_if(F.col("into") == 0).alias("out_degree"), F.count("*").alias("degree"), F.count_if(~(F.col("loop") & (F.col("into") == 1))).alias("incident"))


#: Nodes up to which degrees are counted for them alone.
FEW_IDS = 10_000


def stored_degrees(graph: Graph) -> DataFrame:
    """degrees of a graph, kept with it, and incident: the edges at a node, a loop once."""
    return graph.keep("degrees", lambda: bucketed(made_degrees(graph), "id"))


def made_degrees(graph: Graph) -> DataFrame:
    """stored_degrees before it is stored, from the graph's own count of its ends where it has one."""
    made = graph.degrees()
    return end_counts(graph.edges_of(EDGE_TYPES, once=True)) if made is None else made


def degrees_of(graph: Graph, ids: DataFrame) -> DataFrame:
    """(id, incident) of the given ids (id): few ones pick their edges, where the graph's degrees are not stored; those that no edge has are left out."""
    if "degrees" in graph.kept or ids.limit(FEW_IDS + 1).count() > FEW_IDS:
        return stored_degrees(graph).select("id", "incident").join(ids.select("id").distinct(), "id", "left_semi")
    few = F.broadcast(settled(ids.select("id").distinct()))
    ends = graph.edges_of(EDGE_TYPES, once=True).select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("id"))
    return ends.join(few, "id", "left_semi").groupBy("id").agg(F.count("*").alias("incident"))
