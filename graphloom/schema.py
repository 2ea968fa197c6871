"""The graph's vocabulary and the rules that operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of nodes, types of edges and their sources.
NODE_KINDS = ("Repo", "File", "Module", "Package", "Class", "Interface", "Function", "Method", "Service", "API", "Route", "Table", "Column", "Event", "Job", "Test", "External", "Infra", "Doc", "Contract", "ConfigKey")
EDGE_TYPES = ("CONTAINS", "IMPORTS", "CALLS", "IMPLEMENTS", "EXPOSES", "CONSUMES", "READS", "WRITES", "PUBLISHES", "SUBSCRIBES", "TESTS", "DEPENDS_ON", "DOCUMENTS", "CONSTRAINED_BY", "CO_CHANGED", "BROKE_BEFORE", "USES_CONFIG")
EDGE_SOURCES = ("parser", "git", "openapi", "lockfile", "coverage", "infra", "runtime", "user", "agent", "llm")
PINS = ("user", "agent")

# Which way a traversal follows each type.
DOWNSTREAM = {"CALLS": "inv", "EXPOSES": "fwd", "CONSUMES": "inv", "WRITES": "inv", "PUBLISHES": "fwd", "TESTS": "inv", "DEPENDS_ON": "inv"}
UPSTREAM = {"CALLS": "fwd", "IMPORTS": "fwd", "READS": "fwd", "CONSUMES": "fwd", "DEPENDS_ON": "fwd"}
FLOW_TYPES = ("EXPOSES", "CALLS", "WRITES", "READS", "PUBLISHES", "SUBSCRIBES", "CONSUMES", "DEPENDS_ON")
CYCLE_TYPES = ("CALLS", "IMPORTS", "DEPENDS_ON")
TESTABLE_KINDS = ("Function", "Method", "Class", "Service", "API", "Table")

# The kinds and types that each map shows, and the kind shown even without edges.
MAPS = {
    "dependency": (("File", "Module", "Package", "External"), ("IMPORTS", "DEPENDS_ON"), None),
    "call": (("Function", "Method", "Class"), ("CALLS",), None),
    "service": (("Service", "API", "External", "File", "Function", "Method"), ("CONSUMES", "EXPOSES", "DEPENDS_ON", "CONTAINS"), "Service"),
    "api": (("API", "Service", "Contract", "Function", "Method"), ("EXPOSES", "CONSUMES", "CONSTRAINED_BY", "DOCUMENTS"), "API"),
    "db": (("Table", "Column", "Service", "Function", "Method"), ("READS", "WRITES", "CONTAINS"), "Table"),
    "hierarchical": (("Repo", "Service", "Package", "Module", "File", "Class", "Interface", "Function", "Method", "Infra"), ("CONTAINS",), None),
}

MAX_DEPTH, MAX_PATHS = 5, 7


Ends = dict[str, tuple[tuple[str, ...], tuple[str, ...]]]


@dataclass(frozen=True)
class Graph:
    """nodes (id, kind, name, path, critical), edges (id, type, from_id, to_id, n_evidence, sources, confidence, conflict), chunks (id, node_id, kind, text).

    kept holds what operators have derived of the graph and stored, under a name
    each: steps bucketed by their source, degrees, a search index. ends tells of
    each type that the graph has what stands before the first colon in the ids of
    its sources and of its targets; empty where that is not known.
    """

    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    kept: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)
    ends: Ends = field(default_factory=dict, compare=False, repr=False)

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What is kept under a name, made when it is asked for first."""
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]

    def degrees(self) -> DataFrame | None:
        """(id, in_degree, out_degree, degree, incident) where a graph can count them without its edges, else None."""
        return None

    def following(self, heads: Iterable[str], rules: dict[str, str]) -> set[str]:
        """Of the types that rules follow, fwd or inv, those that a way from ids with these heads can take; all where ends are not known."""
        if not self.ends:
            return set(rules)
        sides = {t: self.ends[t] if way == "fwd" else self.ends[t][::-1] for t, way in rules.items() if t in self.ends}
        met, found = set(heads), set()
        while new := {t for t, (src, _) in sides.items() if t not in found and met & set(src)}:
            found |= new
            met = met.union(*(sides[t][1] for t in new))
        return found

    def on_cycles(self, types: Iterable[str]) -> tuple[str, ...]:
        """Of the types, those that a cycle of their edges can take; all where ends are not known."""
        rules = dict.fromkeys(types, "fwd")
        return tuple(t for t in rules if not self.ends or t in self.ends and t in self.following(self.ends[t][1], rules))

    def edges_of(self, types: Iterable[str], once: bool = False) -> DataFrame:
        """The edges of some types. once tells that they are read once, so that a graph which derives its edges need not store them for it."""
        return self.edges.filter(F.col("type").isin(*types))


class LazyGraph(Graph):
    """A graph whose parts are made when they are first asked for, edges by type.

    make_nodes gives the nodes as they are kept, make_edges the edges of one
    type, and store keeps edges of some types, apart by type. make_degrees, if
    given, counts all nodes' edges in a way of its own.
    """

    def __init__(self, make_nodes: Callable[[], DataFrame], make_edges: Callable[[str], DataFrame], chunks: DataFrame, store: Callable[[DataFrame], DataFrame], types: tuple[str, ...] = EDGE_TYPES, ends: Ends | None = None, make_degrees: Callable[[], DataFrame] | None = None) -> None:
        for name, value in (("make_nodes", make_nodes), ("make_edges", make_edges), ("chunks", chunks), ("store", store), ("types", types), ("kept", {}), ("ends", ends or {}), ("make_degrees", make_degrees)):
            object.__setattr__(self, name, value)

    def degrees(self) -> DataFrame | None:
        return self.make_degrees() if self.make_degrees else None

    @property
    def nodes(self) -> DataFrame:
        return self.keep("nodes", self.make_nodes)

    @property
    def edges(self) -> DataFrame:
        return self.edges_of(self.types)

    def edges_of(self, types: Iterable[str], once: bool = False) -> DataFrame:
        wanted = [t for t in dict.fromkeys(types) if t in self.types]
        new = [t for t in wanted if f"edges {t}" not in self.kept]
        made = [self.make_edges(t) for t in new or ([] if wanted else self.types[:1])]
        if new and not once:  # in one job
            stored = self.store(reduce(DataFrame.unionByName, made))
            self.kept.update({f"edges {t}": stored for t in new})
            made, new = [], []
        held: dict[int, tuple[DataFrame, list[str]]] = {}
        for t in wanted:
            if t not in new:
                stored = self.kept[f"edges {t}"]
                held.setdefault(id(stored), (stored, []))[1].append(t)
        parts = made + [stored.filter(F.col("type").isin(*ts)) for stored, ts in held.values()]
        return reduce(DataFrame.unionByName, parts).filter(F.lit(bool(wanted)))


class GraphError(ValueError):
    """A request that names nothing in the graph or breaks its rules."""
