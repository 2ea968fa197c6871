"""Bounded traversals as level-by-level joins, for many starts at once.

Every row carries its start; a level is one equi-join with the oriented edges
and one window per start. A graph's oriented edges are stored once, bucketed by
their source, so that a level exchanges its frontier only. Paths of a start are numbered in the order in which a
first-in-first-out search would find them, and a level keeps no more than are
still wanted, so that frontiers stay small however far hubs reach.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import bucketed, settled
from ..schema import DOWNSTREAM, EDGE_TYPES, FLOW_TYPES, MAX_DEPTH, MAX_PATHS, UPSTREAM, Graph
from .components import connected


#: What each direction follows, and which way: types by how they are followed.
DIRECTIONS = {"downstream": DOWNSTREAM, "upstream": UPSTREAM, "flow": dict.fromkeys(FLOW_TYPES, "fwd"), "forward": dict.fromkeys(EDGE_TYPES, "fwd"), "backward": dict.fromkeys(EDGE_TYPES, "inv")}


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as steps (src, dst, edge_id, type, conflict), the way a direction follows each type."""
    if direction not in DIRECTIONS:
        raise ValueError(f"no such direction: {direction}")
    rules = DIRECTIONS[direction]
    turned = F.col("type").isin(*(t for t, way in rules.items() if way == "inv"))
    ends = [F.when(turned, F.col(x)).otherwise(F.col(y)) for x, y in (("to_id", "from_id"), ("from_id", "to_id"))]
    return edges.filter(F.col("type").isin(*rules)).select(ends[0].alias("src"), ends[1].alias("dst"), F.col("id").alias("edge_id"), "type", "conflict")


#: Beginnings of ids that are looked at; starts with more follow all types.
MOST_HEADS = 64


def followed(source: Graph | DataFrame, direction: str, starts: DataFrame, column: str = "id") -> tuple[str, ...] | None:
    """The types of a direction that a way from the starts can take, as far as the graph's ends tell; None for all."""
    if not isinstance(source, Graph) or not source.ends:
        return None
    heads = starts.select(F.substring_index(column, ":", 1).alias("head")).distinct().limit(MOST_HEADS + 1).collect()
    return None if len(heads) > MOST_HEADS else tuple(sorted(source.following([h.head for h in heads], DIRECTIONS[direction])))


def stored_steps(source: Graph | DataFrame, direction: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """The steps of a direction, bucketed by source, with n, which numbers a node's steps by edge id; those of a graph are kept with it. types, if given, leave out all others."""
    make = lambda edges: bucketed(oriented(edges, direction), "src", "edge_id", number="n")
    if not isinstance(source, Graph):
        return make(source)
    wanted = tuple(DIRECTIONS[direction]) if types is None else types
    return source.keep(" ".join(("steps", direction, *(() if types is None else types or ("none",)))), lambda: make(source.edges_of(wanted, once=True)))


#: Starts up to which a bounded search looks its steps up by the frontier's nodes, instead of storing them by their source.
FEW = 2_000


def chosen_steps(source: Graph | DataFrame, direction: str, starts: DataFrame) -> DataFrame:
    """The steps for a search with bounded paths: of a graph and few starts as they come, without n and stored without an exchange; else those of stored_steps."""
    types = followed(source, direction, starts)
    if not isinstance(source, Graph) or starts.limit(FEW + 1).count() > FEW:
        return stored_steps(source, direction, types)
    wanted = tuple(DIRECTIONS[direction]) if types is None else types
    return source.keep(" ".join(("plain steps", direction, *(wanted or ("none",)))), lambda: settled(oriented(source.edges_of(wanted, once=True), direction)))


def onward(frontier: DataFrame, steps: DataFrame, few: bool = False) -> DataFrame:
    """The steps from each row's node. A frontier of few rows goes to the steps, which are not exchanged."""
    return (F.broadcast(frontier) if few else frontier).join(steps, F.col("node") == F.col("src"))


def _ranked(df: DataFrame, most: int | None) -> DataFrame:
    """A start's rows, as many as it still wants, in the order in which they are found."""
    out = df.withColumn("found", F.row_number().over(Window.partitionBy("start").orderBy("rank", "edge_id")))
    return out if most is None else out.filter((F.col("found") <= most) & (F.col("found") <= F.lit(most) - F.col("n")))


def search_paths(steps: DataFrame, starts: DataFrame, depth: int, most: int | None, avoid_own_path: bool = True, edge_paths: bool = True) -> DataFrame:
    """The paths of a first-in-first-out search: start, path_no, depth, node, type, edge_id, conflict, path, edge_path, was_seen.

    A path is found for every step from a node that was reached for the first
    time, to nodes seen before as well but, with avoid_own_path, not to one on
    the same path. Steps from one node go by edge id. Each start ends with
    `most` paths, if given. Where starts have a group, those of one group are
    searched together, in order of their ids, and start is the group. Without
    edge_paths that column is left out.

    Rows carry how many paths their start has and, where paths are bounded, the
    few nodes that it has seen, so that a level exchanges its rows once by node
    and once by start. Steps without n, which chosen_steps gives for few starts,
    are read once a level.
    """
    few = most is not None and "n" not in steps.columns
    if most is not None and not few:  # no path takes more than the first steps from a node, but for those back to its own path
        steps = steps.filter(F.col("n") <= most + (2 * len(EDGE_TYPES) * depth if avoid_own_path else 0))
    carried = most is not None and "group" not in starts.columns
    steps, starts = steps.drop("n"), settled(starts.select(F.col("group" if "group" in starts.columns else "id").alias("start"), F.col("id").alias("node")).distinct())
    trail = ("path", "edge_path") if edge_paths else ("path",)
    frontier = starts.select("start", "node", F.row_number().over(Window.partitionBy("start").orderBy("node")).alias("rank"), F.lit(0).alias("n"), F.array("node").alias("path"), F.array().cast("array<string>").alias("edge_path"), F.array("node").alias("seen"))
    frontier = frontier.select("start", "node", "rank", "n", *trail, *(["seen"] if carried else []))
    own, seen, out = Window.partitionBy("start"), starts, None
    for level in range(1, depth + 1):
        near = onward(frontier, steps, few)
        near = near.filter(~F.array_contains("path", F.col("dst"))) if avoid_own_path else near
        near = _ranked(near, most).withColumn("total", F.col("n") + F.count("*").over(own))
        if carried:
            near = near.withColumn("was_seen", F.array_contains("seen", F.col("dst"))).withColumn("seen", F.array_union("seen", F.collect_set("dst").over(own)))
        else:
            near = near.join(seen.withColumnRenamed("node", "dst").withColumn("was_seen", F.lit(True)), ["start", "dst"], "left").withColumn("was_seen", F.coalesce("was_seen", F.lit(False)))
        fresh = ~F.col("was_seen") & (F.row_number().over(Window.partitionBy("start", "dst").orderBy("found")) == 1)
        goes = fresh & (F.lit(level < depth) if most is None else (F.col("total") < most) & F.lit(level < depth))
        emitted = settled(near.withColumn("fresh", fresh).withColumn("goes", goes).select(
            "start", (F.col("n") + F.col("found")).alias("path_no"), F.lit(level).alias("depth"), F.col("dst").alias("node"), "type", "edge_id", "conflict", F.concat("path", F.array("dst")).alias("path"),
            *([F.concat("edge_path", F.array("edge_id")).alias("edge_path")] if edge_paths else []), "was_seen", F.col("src").alias("from_node"), "fresh", "goes", "total", *([F.when(F.col("goes"), F.col("seen")).alias("seen")] if carried else []),
        ))
        found = emitted.drop("fresh", "goes", "total", "seen")
        out = found if out is None else out.union(found)
        if level == depth:
            break
        frontier = emitted.filter("goes").select("start", "node", F.col("path_no").alias("rank"), F.col("total").alias("n"), *trail, *(["seen"] if carried else []))
        if not carried:
            seen = seen.union(emitted.filter("fresh").select("start", "node"))
        if frontier.isEmpty():  # every start has its paths
            break
    return out


def impact(graph: Graph | DataFrame, starts: DataFrame, direction: str = "downstream", depth: int = MAX_DEPTH, max_paths: int = MAX_PATHS, edge_paths: bool = True) -> DataFrame:
    """What a change of each start reaches, at most max_paths paths of at most depth steps each; at depth 0 nothing."""
    depth = max(0, min(MAX_DEPTH, depth))
    starts = settled(starts)
    found = search_paths(chosen_steps(graph, direction, starts), starts, max(1, depth), max(1, min(MAX_PATHS, max_paths)), edge_paths=edge_paths)
    return found if depth else found.filter(F.lit(False))


def reach(graph: Graph | DataFrame, starts: DataFrame, direction: str = "downstream", depth: int = MAX_DEPTH) -> DataFrame:
    """Every node that the starts reach together, with its least depth; no bound on paths."""
    steps = stored_steps(graph, direction, followed(graph, direction, starts)).select("src", "dst")
    seen = frontier = starts.select(F.col("id").alias("node"), F.lit(0).alias("depth")).distinct()
    for level in range(1, depth + 1):
        frontier = settled(onward(frontier, steps).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.union(frontier)
    return seen


def why_paths(graph: Graph | DataFrame, pairs: DataFrame, depth: int = MAX_DEPTH, max_paths: int = MAX_PATHS) -> DataFrame:
    """Simple forward paths for pairs (from_id, to_id): from_id, to_id, path_no, length, path, edge_path.

    Shorter paths come first, equal ones by their edges' ids. A path ends where
    it meets its target; a pair of one node twice has one empty path. Half
    trails from both ends meet in the middle, so that a path of five steps takes
    trails of three and two. Lengths go up one by one, and a pair leaves the
    search with its last wanted path.
    """
    pairs = settled(pairs.select("from_id", "to_id").distinct())
    ways = followed(graph, "forward", pairs, "from_id"), followed(graph, "backward", pairs, "to_id")
    types = None if None in ways else tuple(t for t in ways[0] if t in ways[1])
    ahead, back = (stored_steps(graph, d, types).select("src", "dst", "edge_id") for d in ("forward", "backward"))
    key = ["from_id", "to_id"]
    none = F.array().cast("array<string>")
    paths = pairs.filter("from_id = to_id").select(*key, F.array("from_id").alias("path"), none.alias("edge_path"))
    open_ = pairs.filter("from_id <> to_id")

    def grown(trails: DataFrame, forward: bool) -> DataFrame:
        """Trails with one step more at their free end, which meets neither the trail nor the pair's other end."""
        to = "to_id" if forward else "from_id"
        near = onward(trails.join(open_, key, "left_semi"), ahead if forward else back).filter(~F.array_contains("path", F.col("dst")) & (F.col("dst") != F.col(to)))
        path, edges = ([F.col("path"), F.array("dst")], [F.col("edge_path"), F.array("edge_id")])
        return near.select(*key, F.col("dst").alias("node"), F.concat(*(path if forward else path[::-1])).alias("path"), F.concat(*(edges if forward else edges[::-1])).alias("edge_path"))

    def half(end: str) -> DataFrame:
        return open_.select(*key, F.col(end).alias("node"), F.array(end).alias("path"), none.alias("edge_path"))

    fore, aft = {0: half("from_id")}, {0: half("to_id")}
    for length in range(1, depth + 1):
        f, b = (length + 1) // 2, length // 2
        if length == 1:  # a step to the target
            met = onward(fore[0], ahead).filter("dst = to_id").select(*key, F.array("from_id", "to_id").alias("path"), F.array("edge_id").alias("edge_path"))
        else:
            if b not in aft:
                aft[b] = settled(grown(aft[b - 1], False))
            for k in range(1, f + 1):
                if k not in fore:
                    more = grown(fore[k - 1], True)
                    if k > 1:  # only where a trail from the target can come, in the steps that are left
                        left = [aft[i].select(*key, "node").distinct() for i in range(1, min(max(aft), depth - k) + 1)]
                        while len(left) < depth - k:
                            left.append(onward(left[-1], back).select(*key, F.col("dst").alias("node")).distinct())
                        more = more.join(reduce(DataFrame.union, left).distinct(), [*key, "node"], "left_semi")
                    fore[k] = settled(more)
            tail = aft[b].select(*key, "node", F.col("path").alias("rest"), F.col("edge_path").alias("last"))
            met = fore[f].join(tail, [*key, "node"]).join(open_, key, "left_semi").withColumn("rest", F.slice("rest", 2, b)).filter(~F.arrays_overlap("path", "rest"))
            met = met.select(*key, F.concat("path", "rest").alias("path"), F.concat("edge_path", "last").alias("edge_path"))
        paths = paths.union(settled(met))
        if length < depth:
            full = paths.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") >= max_paths)
            open_ = settled(open_.join(full, key, "left_anti"))
            if open_.isEmpty():
                break
    w = Window.partitionBy(*key).orderBy(F.size("edge_path"), F.array_join("edge_path", ","))
    return paths.withColumn("path_no", F.row_number().over(w)).filter(F.col("path_no") <= max_paths).select(*key, "path_no", F.size("edge_path").alias("length"), "path", "edge_path")


def flow(graph: Graph | DataFrame, starts: DataFrame, max_steps: int = 12) -> DataFrame:
    """Forward steps from each start, in search order: start, step, from_node, type, node."""
    starts = settled(starts)
    found = search_paths(chosen_steps(graph, "flow", starts), starts, max(1, max_steps), max_steps, avoid_own_path=False, edge_paths=False)
    return found.select("start", F.col("path_no").alias("step"), "from_node", "type", "node")


def neighbors(edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """Edges at the given nodes: id, edge_id, type, other. A loop comes out once."""
    out, into = (F.struct(F.col(a).alias("id"), F.col(b).alias("other")) for a, b in (("from_id", "to_id"), ("to_id", "from_id")))
    both = F.when(F.col("from_id") == F.col("to_id"), F.array(out)).otherwise(F.array(out, into))
    ends = {"out": F.array(out), "in": F.array(into), "both": both}[direction]  # in one pass over the edges
    met = edges.select(F.col("id").alias("edge_id"), "type", F.explode(ends).alias("e")).select("e.id", "edge_id", "type", "e.other")
    return met.join(ids.select("id").distinct(), "id")


def component(edges: DataFrame, focus: str) -> DataFrame:
    """The nodes that edges connect with a node, in either direction; of an id that no edge has, itself alone."""
    labels = settled(connected(edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))))
    own = labels.filter(F.col("node") == focus).select("label")
    return labels.join(own, "label", "left_semi").select("node").union(edges.sparkSession.createDataFrame([(focus,)], "node string")).distinct()
