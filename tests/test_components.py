"""Components and cycles beside plain searches on random graphs."""

import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import components, traverse
from graphloom.schema import Graph


def frame(spark, pairs, names=("a", "b")):
    return spark.createDataFrame(pairs, f"{names[0]} string, {names[1]} string")


def tarjan(steps):
    """{node: least node of its component} of nodes on cycles, by one recursive search."""
    sys.setrecursionlimit(10_000)
    after = {}
    for a, b in steps:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    index, low, stack, on, out = {}, {}, [], set(), {}

    def visit(v):
        index[v] = low[v] = len(index)
        stack.append(v)
        on.add(v)
        for w in after[v]:
            if w not in index:
                visit(w)
            if w in on:
                low[v] = min(low[v], low[w])
        if low[v] == index[v]:
            group = []
            while not group or group[-1] != v:
                group.append(stack.pop())
                on.discard(group[-1])
            if len(group) > 1 or v in after[v]:
                out.update(dict.fromkeys(group, min(group)))

    for v in after:
        if v not in index:
            visit(v)
    return out


def ring(name, n):
    return [(f"{name}{k:03}", f"{name}{(k + 1) % n:03}") for k in range(n)]


def chain(name, n):
    return [(f"{name}{k:04}", f"{name}{k + 1:04}") for k in range(n - 1)]


def mixed(seed, n, m):
    rng = np.random.default_rng(seed)
    return [(f"n{a:03}", f"n{b:03}") for a, b in rng.integers(0, n, (m, 2)).tolist()]


CASES = {
    "nothing": [], "loop": [("a", "a"), ("a", "b")], "chain": chain("c", 60), "two rings and a bridge": [*ring("x", 37), *ring("y", 8), ("x003", "y004"), ("z", "x001"), ("y002", "w")],
    "rings that touch": [*ring("p", 11), *ring("q", 9), ("p004", "q003"), ("q007", "p009"), ("q001", "q001")], "ring with chords": [*ring("r", 30), ("r003", "r020"), ("r021", "r002"), ("r010", "out"), ("in", "r011")],
    "chain back to itself": [("h", "c0000"), *chain("c", 20), ("c0019", "h"), ("h", "d0000"), *chain("d", 5), ("d0004", "h"), ("h", "e")], "sparse": mixed(1, 60, 70), "denser": mixed(2, 60, 130), "dense": mixed(3, 20, 120),
}


def together(names):
    """Several cases as one graph, each with names of its own."""
    return [(f"{k}{a}", f"{k}{b}") for k, name in enumerate(names) for a, b in CASES[name]]


@pytest.mark.parametrize("cases", [["nothing"], list(CASES)], ids=["nothing", "all"])
def test_strong_components(spark, cases):
    pairs = together(cases)
    got = components.strong_components(frame(spark, pairs, ("src", "dst"))).collect()
    want = tarjan(pairs)
    assert {r.node: r.scc for r in got} == want and len(got) == len(want)
    sizes = {s: list(want.values()).count(s) for s in want.values()}
    assert all(r["size"] == sizes[r.scc] for r in got)


def test_connected_counts_its_rounds(spark, monkeypatch):
    pairs = [*chain("c", 1000), *ring("x", 20), ("a", "a"), ("x003", "y"), ("z", "z2")]
    rounds = []
    plain = components.settled
    monkeypatch.setattr(components, "settled", lambda df, by=None: (rounds.append(1), plain(df, by))[1])
    got = {r.node: r.label for r in components.connected(frame(spark, pairs)).collect()}
    want = {n: {"c": "c0000", "x": "x000", "y": "x000", "a": "a", "z": "z"}[n[0]] for p in pairs for n in p}
    assert got == want
    assert (len(rounds) - 1) / 2 <= 14  # two frames a round
    assert components.connected(frame(spark, [])).count() == 0
    edges = frame(spark, pairs, ("from_id", "to_id"))
    assert {r.node for r in traverse.component(edges, "y").collect()} == {"y", *(f"x{k:03}" for k in range(20))}
    assert [r.node for r in traverse.component(edges, "nowhere").collect()] == ["nowhere"]


def graph_of(spark, pairs, types=("CALLS",)):
    rows = [(f"e{k:04}", types[k % len(types)], a, b) for k, (a, b) in enumerate(pairs)]
    ids = sorted({n for p in pairs for n in p})
    nodes = spark.createDataFrame([(n, "Class" if n.endswith("7") else "Function") for n in ids], "id string, kind string")
    return Graph(nodes, spark.createDataFrame(rows, "id string, type string, from_id string, to_id string"), nodes.select(F.col("id").alias("node_id")))


def plain_cycles(pairs):
    """Every component's closed paths, by a recursive search from its first node, in order of (kind, id)."""
    scc = tarjan(pairs)
    key = lambda n: ("Class" if n.endswith("7") else "Function", n)
    firsts = {}
    for n, s in scc.items():
        firsts[s] = min(firsts.get(s, n), n, key=key)
    out = []
    for s, first in sorted(firsts.items(), key=lambda x: key(x[1])):
        path, done = [], set()

        def visit(v, s=s, path=path, done=done):
            path.append(v)
            done.add(v)
            for a, b in pairs:
                if a == v and scc.get(b) == s:
                    if b in path:
                        out.append(">".join([*path[path.index(b) :], b]))
                    elif b not in done:
                        visit(b)
            path.pop()

        visit(first)
    return out


def test_dependency_cycles(spark):
    pairs = together(["loop", "chain", "two rings and a bridge", "rings that touch", "ring with chords", "chain back to itself", "denser"])
    g, want = graph_of(spark, pairs, ("CALLS", "IMPORTS", "DEPENDS_ON")), plain_cycles(pairs)
    got = sorted(components.dependency_cycles(g, most=None).collect(), key=lambda r: (r.kind, r.first, r.no))
    assert [r.path for r in got] == want and all(r.length == r.path.count(">") for r in got)
    few = sorted(components.dependency_cycles(g, most=3).collect(), key=lambda r: (r.kind, r.first, r.no))
    assert [r.path for r in few] == want[:3]


def test_large_components_give_a_shortest_cycle(spark, monkeypatch):
    monkeypatch.setattr(components, "DFS_EDGES", 9)
    pairs = [*ring("r", 12), ("r004", "r000"), ("r004", "r009"), *ring("s", 4), ("s000", "s001"), *ring("t", 10)]
    got = {r.first: r.path for r in components.dependency_cycles(graph_of(spark, pairs), most=None).filter("no = 1").collect()}
    assert got["r007"] == ">".join(["r007", "r008", "r009", "r010", "r011", *(f"r{k:03}" for k in range(8))])
    assert got["s000"] == "s000>s001>s002>s003>s000" and got["t007"].count(">") == 10


def test_cycles_do_not_depend_on_the_size_of_components(spark, monkeypatch):
    """Components of more than DFS_EDGES edges are searched as others are: a cycle for each step back, in the same order."""
    pairs = together(["two rings and a bridge", "ring with chords", "chain back to itself", "dense"])
    want = plain_cycles(pairs)
    for held in (100_000, 7):
        monkeypatch.setattr(components, "DFS_EDGES", held)
        got = sorted(components.dependency_cycles(graph_of(spark, pairs), most=None).collect(), key=lambda r: (r.kind, r.first, r.no))
        assert [r.path for r in got] == want and len(want) > 20
