"""Connected and strongly connected components, and the cycles inside them.

Everything but the last step is joins and aggregates over pairs of ids. Rounds
are written to the checkpoint folder, so plans don't grow and a lost executor
costs one round.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce
from itertools import groupby, islice
from typing import IO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import settled
from ..schema import CYCLE_TYPES, Graph

#: Numbers of each kind that the search of a strongly connected component holds in memory; more lie in files of its task. Its cycles are the same.
DFS_EDGES = 100_000


def _turned(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))


def connected(pairs: DataFrame) -> DataFrame:
    """(node, label): the least node that pairs (a, b) connect with each of their nodes, in either direction.

    Alternating star contraction: a round hangs the larger neighbours of each
    node, then the smaller ones, on its least neighbour. Rounds grow with the
    logarithm of the components' size. No neighbourhood is gathered: a node's
    least neighbour is an aggregate that its pairs meet in a join.
    """
    pairs = settled(pairs.select("a", "b").distinct())
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    stars, before = pairs.filter("a <> b"), None
    while True:
        both = stars.union(_turned(stars))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = settled(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        stars = settled(met.select("a", F.col("m").alias("b")).union(met.filter("b <> m").select("b", "m")).distinct())
        told = stars.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if told == before:
            break
        before = told
    return nodes.join(stars.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _trimmed(steps: DataFrame, rounds: int = 2) -> DataFrame:
    """Without steps from nodes that no step leads to, and to nodes that none leaves: no cycle takes them."""
    for _ in range(rounds):
        heads, tails = steps.select(F.col("dst").alias("src")).distinct(), steps.select(F.col("src").alias("dst")).distinct()
        steps = settled(steps.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"))
    return steps


def _contracted(steps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """steps with every chain of nodes with one step in and one out as one step; the chains' nodes with the chains' ends (node, a, b); nodes of closed chains (node, scc).

    Pointers along the chains double in each round, so that a chain of n nodes takes log2 n.
    """
    into = steps.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("a")).filter("n = 1").select(F.col("dst").alias("node"), "a")
    out = steps.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("b")).filter("n = 1").select(F.col("src").alias("node"), "b")
    chain = settled(into.join(out, "node").withColumn("low", F.col("node")))
    inner = chain.select("node")
    before = None
    while True:
        ahead = chain.select(F.col("node").alias("b"), F.col("b").alias("b2"), F.col("low").alias("low2"))
        back = chain.select(F.col("node").alias("a"), F.col("a").alias("a2"))
        jumped = chain.join(ahead, "b", "left").join(back, "a", "left")
        chain = settled(jumped.select("node", F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"), F.least("low", "low2").alias("low"), F.col("b2").isNotNull().alias("open"), (F.col("low2") < F.col("low")).alias("fell")))
        told = chain.agg(F.count_if("open"), F.count_if("fell")).first()
        if told[0] == 0 or (before == told[0] and told[1] == 0):
            break
        before = told[0]
    # in the last round no chain was left, but for closed ones
    rings = chain.filter("open").select("node", F.col("low").alias("scc"))
    ends = settled(chain.filter("not open").select("node", "a", "b")) if told[0] == 0 else settled(chain.join(rings.select("node"), "node", "left_anti").select("node", "a", "b"))
    rest = steps.join(inner.withColumnRenamed("node", "src"), "src", "left_anti").join(inner.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    return settled(rest.union(ends.filter("a <> b").select("a", "b")).distinct()), ends, settled(rings)


def _coloured(steps: DataFrame) -> DataFrame:
    """(node, scc) by forward colours and backward search.

    Each node takes the least id that reaches it as its colour. Of a colour's
    nodes, those that reach its first node are a component; they go, and what
    is left is trimmed and coloured anew.
    """
    parts: list[DataFrame] = []
    while True:
        steps = _trimmed(steps)
        if steps.isEmpty():
            break
        colour = settled(steps.select(F.col("src").alias("node")).union(steps.select("dst")).distinct().withColumn("colour", F.col("node")).withColumn("fell", F.lit(True)))
        while True:  # only what fell in the last round can make others fall
            new = steps.join(colour.filter("fell").select(F.col("node").alias("src"), "colour"), "src").groupBy("dst").agg(F.min("colour").alias("new"))
            colour = settled(colour.join(new, colour["node"] == new["dst"], "left").select("node", F.least("colour", "new").alias("colour"), F.coalesce(F.col("new") < F.col("colour"), F.lit(False)).alias("fell")))
            if colour.filter("fell").isEmpty():
                break
        ends = [colour.select(F.col("node").alias(c), F.col("colour").alias(f"{c}_colour")) for c in ("src", "dst")]
        inside = settled(steps.join(ends[0], "src").join(ends[1], "dst").filter("src_colour = dst_colour").select("src", "dst"))
        found = frontier = colour.filter("node = colour").select("node", F.col("colour").alias("scc"))
        while True:
            frontier = settled(inside.join(frontier.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "scc").distinct().join(found.select("node"), "node", "left_anti"))
            if frontier.isEmpty():
                break
            found = found.union(frontier)
        found = settled(found)
        parts.append(found)
        gone = found.select("node")
        steps = steps.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    return reduce(DataFrame.union, parts) if parts else steps.select(F.col("src").alias("node"), F.col("dst").alias("scc"))


def strong_components(steps: DataFrame) -> DataFrame:
    """(node, scc, size): nodes of steps (src, dst) that lie on a cycle, with the least node of their strongly connected component.

    Nodes on no cycle are left out; a step from a node to itself is a cycle.
    Trimming and the contraction of chains shrink the graph while that helps;
    colours find the components of what is left, in as many rounds as its
    longest ways have steps; then chains get the component of their ends.
    """
    all_steps = settled(steps.select("src", "dst").distinct())
    loops = all_steps.filter("src = dst").select(F.col("src").alias("node"))
    left, levels = all_steps.filter("src <> dst"), []
    n = left.count()
    while n:
        smaller, ends, rings = _contracted(_trimmed(left))
        levels.append((ends, rings))
        left, was = smaller, n
        n = left.count()
        if n > 0.9 * was:
            break
    found = _coloured(left) if n else left.select(F.col("src").alias("node"), F.col("dst").alias("scc"))
    for ends, rings in reversed(levels):
        of = lambda c: found.select(F.col("node").alias(c), F.col("scc").alias(f"{c}_scc"))  # noqa: E731, B023
        met = ends.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("scc", F.coalesce("a_scc", "a")).filter(F.col("scc") == F.coalesce("b_scc", "b"))
        found = settled(found.union(met.select("node", "scc")).union(met.select("a", "scc")).union(rings).distinct())
    sizes = found.groupBy("scc").agg(F.min("node").alias("first"), F.count("*").alias("size")).filter("size > 1")
    whole = found.join(sizes, "scc").select("node", F.col("first").alias("scc"), "size")
    alone = loops.join(whole.select("node"), "node", "left_anti").select("node", F.col("node").alias("scc"), F.lit(1).cast("long").alias("size"))
    return settled(whole.union(alone))


def inside_components(steps: DataFrame, found: DataFrame) -> DataFrame:
    """The steps whose ends lie in one strongly connected component, with it (scc): all that any cycle takes."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("scc").alias(f"{c}_scc"))
    return steps.join(of("src"), "src").join(of("dst"), "dst").filter("src_scc = dst_scc").withColumnRenamed("src_scc", "scc").drop("dst_scc")


class _Numbers:
    """Whole numbers added in blocks: in memory up to a number of them, then in a temporary file."""

    def __init__(self, held: int) -> None:
        self.n, self._held, self._blocks = 0, held, []
        self._file: IO[bytes] | None = None

    def add(self, block: np.ndarray) -> None:
        self.n += len(block)
        self._blocks.append(block.astype(np.int64))
        if self.n > self._held:
            self._file = self._file or tempfile.TemporaryFile()
            for b in self._blocks:
                self._file.write(b.tobytes())
            self._blocks = []

    def view(self) -> memoryview:
        if not self._file:
            return memoryview(np.concatenate(self._blocks) if self._blocks else np.zeros(0, np.int64))
        self._file.flush()
        return memoryview(np.memmap(self._file, np.int64, "r", shape=self.n))


def _zeros(n: int, held: int) -> np.ndarray:
    """n zeros, in a temporary file if more than are held in memory."""
    return np.zeros(n, np.int64) if n <= held else np.memmap(tempfile.TemporaryFile(), np.int64, "w+", shape=n)


def back_edges(begins: memoryview, heads: memoryview, start: int, held: int = DFS_EDGES) -> Iterator[np.ndarray]:
    """Closed paths of a depth-first search from start: one for each step back to a node of the current path, which is where it begins and ends.

    Each is a view of the current path, without the closing node, to be read before the next. Nodes are numbers. The steps from node k lead to heads[begins[k] : begins[k + 1]], in that order.
    """
    n = len(begins) - 1
    path = _zeros(n, held)
    on, turn, at = memoryview(path), memoryview(_zeros(n, held)), memoryview(_zeros(n, held))  # at: a node's place on the path from 1, -1 once it is left
    on[0], at[start], depth = start, 1, 1
    while depth:
        node = on[depth - 1]
        step = begins[node] + turn[node]
        if step == begins[node + 1]:
            at[node] = -1
            depth -= 1
            continue
        turn[node] += 1
        head = heads[step]
        if at[head] > 0:
            yield path[at[head] - 1 : depth]
        elif not at[head]:
            on[depth] = head
            depth += 1
            at[head] = depth


def _cycles(inner: DataFrame, most: int | None) -> DataFrame:
    """(scc, no, pos, place): the cycles that a depth-first search of each component from its place `start` gives, node by node, without the closing one.

    inner has the components' steps (scc, start, src_place, dst_place, edge_id). A
    search takes one step after the other, so that a component is one
    task's; what it holds in memory is bounded, for the rest lies in files.
    """
    held = DFS_EDGES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def blocks() -> Iterator[tuple[str, pd.DataFrame]]:
            for pdf in batches:
                yield from pdf.groupby("scc", sort=False)

        for scc, parts in groupby(blocks(), key=lambda x: x[0]):
            begins, heads, last = _Numbers(held), _Numbers(held), -1
            for _, pdf in parts:  # by source, and every node is one
                src = pdf["src_place"].to_numpy()
                begins.add(heads.n + np.flatnonzero(np.diff(src, prepend=last)))
                heads.add(pdf["dst_place"].to_numpy())
                last, start = src[-1], int(pdf["start"].iloc[0])
            begins.add(np.array([heads.n]))
            for no, path in enumerate(islice(back_edges(begins.view(), heads.view(), start, held), most), 1):
                for k in range(0, len(path), held):
                    yield pd.DataFrame({"scc": scc, "no": no, "pos": np.arange(k, min(k + held, len(path))), "place": np.array(path[k : k + held])})

    dealt = inner.repartition("scc").sortWithinPartitions("scc", "src_place", "edge_id", "dst_place").select("scc", "start", "src_place", "dst_place")
    return dealt.mapInPandas(run, "scc string, no long, pos long, place long")


def dependency_cycles(graph: Graph, types: tuple[str, ...] = CYCLE_TYPES, most: int | None = 20) -> DataFrame:
    """(kind, first, no, path, length) of dependency cycles of any length; path ends with the node that it begins with.

    Components go by their first node's kind and id, and are searched depth
    first from it, steps by edge id, which gives a cycle for each step back,
    whatever a component's size. Each component has a cycle, so of a report of
    `most` cycles only so many components are searched; without it all are.
    """
    steps = settled(graph.edges_of(graph.on_cycles(types), once=True).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("id").alias("edge_id")))
    found = strong_components(steps)
    firsts = found.join(graph.nodes.select(F.col("id").alias("node"), "kind"), "node").groupBy("scc").agg(F.min(F.struct("kind", "node")).alias("f")).select("scc", "f.kind", F.col("f.node").alias("first"))
    firsts = settled(firsts if most is None else firsts.orderBy("kind", "first").limit(most))
    place = F.row_number().over(Window.partitionBy("scc").orderBy("node")).cast("long") - 1
    nodes = settled(found.join(firsts.select("scc"), "scc", "left_semi").select("scc", "node", place.alias("place")))
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("scc").alias(f"{c}_scc"), F.col("place").alias(f"{c}_place"))
    starts = firsts.select("scc", F.col("first").alias("node")).join(nodes, ["scc", "node"]).select("scc", F.col("place").alias("start"))
    inner = steps.join(of("src"), "src").join(of("dst"), "dst").filter("src_scc = dst_scc").withColumnRenamed("src_scc", "scc").join(starts, "scc")
    paths = settled(_cycles(inner, most)).join(nodes, ["scc", "place"]).groupBy("scc", "no").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("path"))
    cycles = settled(paths.join(firsts, "scc").select("kind", "first", "no", F.concat("path.node", F.slice("path.node", 1, 1)).alias("path")))
    cycles = cycles if most is None else cycles.orderBy("kind", "first", "no").limit(most)
    return cycles.select("kind", "first", "no", F.array_join("path", ">").alias("path"), (F.size("path") - 1).cast("long").alias("length"))
