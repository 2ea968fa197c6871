"""The tables' graph: edges by type as the raw rows give them, and nothing made that no query asks for."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.lineage import settled
from graphloom.operators import analyze, scan, store, traverse
from graphloom.plans.queries import QUERIES, looped
from graphloom.schema import CYCLE_TYPES, EDGE_TYPES, Graph, LazyGraph
from graphloom.sources import tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The smallest tables with line items of few parts and suppliers, repeated lines and events, and a supplier's name twice."""
    folder = str(tmp_path_factory.mktemp("odd"))
    for t in tables._TABLES:
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    rng = random.Random(7)
    items = [(rng.randrange(40), rng.randrange(3), rng.randrange(4), rng.choice([1, 1, 2, 3, None]), rng.choice(["N", "A", "R", None])) for _ in range(600)]
    items = spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string")
    spark.read.parquet(f"{SMALL}/lineitem.parquet").drop("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag").limit(1).crossJoin(items).write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    for t, change in (("supplier", F.when(F.col("s_suppkey") < 2, "same").otherwise(F.col("s_name")).alias("s_name")),):
        rows = spark.read.parquet(f"{SMALL}/{t}.parquet")
        rows.select(*(change if c == "s_name" else F.col(c) for c in rows.columns)).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.union(events.limit(50)).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    return folder


def test_edges_by_type_are_those_of_the_raw_rows(spark, odd):
    want = {tuple(r) for r in tables.merged_edges(tables.raw_edges(spark, odd)).collect()}
    got = [tuple(r) for t in tables.TYPES for r in tables.table_edges(spark, odd, t).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r[1] for r in want} == set(tables.TYPES) and max(r[4] for r in want) > 1 and any(r[6] == "lockfile,parser" for r in want)


def test_only_what_is_asked_for_is_made(spark, odd):
    g = tables.table_graph(spark, odd)
    QUERIES["critical_nodes"](spark, odd).collect()
    assert set(g.kept) == {"nodes"}
    whole = {r.id for r in g.edges_of(EDGE_TYPES, once=True).collect()}
    assert set(g.kept) == {"nodes"}
    assert {r.type for r in g.edges_of(("TESTS", "CONTAINS")).collect()} <= {"TESTS", "CONTAINS"} and set(g.kept) == {"nodes", "edges TESTS", "edges CONTAINS"}
    assert {r.id for r in g.edges.collect()} == whole and g.edges_of(()).isEmpty()
    analyze.project_map(g, "hierarchical").collect()
    assert sorted(x.id for x in analyze.isolated(g).collect()) == sorted({r.id for r in g.nodes.filter("kind <> 'Repo'").collect()} - {x for r in g.edges.collect() for x in (r.from_id, r.to_id)})


def test_a_graphs_parts_are_kept(spark, odd):
    g = tables.table_graph(spark, odd)
    assert scan.stored_degrees(g) is scan.stored_degrees(g) and traverse.stored_steps(g, "flow") is traverse.stored_steps(g, "flow")
    n = traverse.stored_steps(g, "downstream").groupBy("src").agg(F.count("*").alias("c"), F.max("n").alias("m"), F.count_distinct("n").alias("d"))
    assert n.filter("c <> m or c <> d").isEmpty()


def test_a_level_takes_two_exchanges(spark):
    """One by node, one by start: what a start has and has seen comes with its rows."""
    g = tables.table_graph(spark, SMALL)
    plans = []
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    settled, traverse.settled = traverse.settled, lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settled(df)
    try:
        traverse.impact(g, g.nodes.filter("kind = 'Table'").select("id")).collect()
    finally:
        traverse.settled = settled
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(plans) > 2 and all(p.count("Exchange hashpartitioning") <= 2 for p in plans[2:])


def test_pairs_between_repositories_once_without_comparing_all(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice(["EXPOSES", "CONSUMES", "CALLS"]), rng.choice(["fn:repo:r{}/f{}", "fn:f{1}"]).format(rng.randrange(3), rng.randrange(12)), rng.choice([f"api:{rng.randrange(6)}", None])) for _ in range(400)]
    rows += [("EXPOSES", "fn:repo:a/one", "api:x")] * 2 + [("CONSUMES", f"fn:repo:b/u{k}", "api:x") for k in range(30)]
    edges = spark.createDataFrame(rows, "type string, from_id string, to_id string")
    repo = lambda x: x.split(":")[2].split("/")[0] if x.startswith("fn:repo:") else None
    of = lambda type_: {(a, x) for t, x, a in rows if t == type_ and a and repo(x)}
    want = {(u, m) for a, m in of("EXPOSES") for b, u in of("CONSUMES") if a == b and repo(m) != repo(u)}
    for most in (4_000_000, 7):
        monkeypatch.setattr(analyze, "SHARE_PAIRS", most, raising=False)
        got = [(r.from_id, r.to_id) for r in analyze.cross_repo(edges).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert analyze.cross_repo(edges)._jdf.queryExecution().optimizedPlan().nodeName() == "Union"  # not one comparison of all pairs


def test_ends_are_those_of_the_edges(spark, odd):
    head = lambda c: F.substring_index(c, ":", 1)
    found = tables.merged_edges(tables.raw_edges(spark, odd)).select("type", head("from_id").alias("a"), head("to_id").alias("b")).distinct().collect()
    assert {r.type for r in found} == set(tables.ENDS) == set(tables.TYPES)
    assert all(r.a in tables.ENDS[r.type][0] and r.b in tables.ENDS[r.type][1] for r in found)


def test_only_types_on_a_way_are_stored(spark):
    """Why-paths from tests to APIs and impact of tables store no edges that none of their ways can take, and find what the whole graph gives."""
    tables._STORED.pop((spark.sparkContext.applicationId, SMALL), None)
    got = QUERIES["why_path"](spark, SMALL).collect()
    g = tables.table_graph(spark, SMALL)
    stored = {k for k in g.kept if k.startswith("steps")}
    assert {t for k in stored for t in k.split()[2:]} == {"TESTS", "CALLS", "CONSUMES"} and len(stored) == 2
    whole = Graph(g.nodes, g.edges, g.chunks)
    starts = g.nodes.filter("kind = 'Table'").select("id")
    assert traverse.followed(g, "downstream", starts) == ("CALLS", "PUBLISHES", "TESTS", "WRITES") and traverse.followed(whole, "downstream", starts) is None
    columns = ["start", "path_no", "node", "edge_id"]
    assert {tuple(r) for r in traverse.impact(g, starts).select(columns).collect()} == {tuple(r) for r in traverse.impact(whole, starts).select(columns).collect()}
    pairs = g.edges_of(("TESTS",)).select("from_id", F.col("to_id").alias("f")).join(g.edges_of(("CONSUMES",)).select(F.col("from_id").alias("f"), "to_id"), "f").select("from_id", "to_id")
    assert got and {(r.from_id, r.to_id, r.path_no, r.path) for r in got} == {(r.from_id, r.to_id, r.path_no, ">".join(r.path)) for r in traverse.why_paths(whole, pairs).collect()}


def test_starts_of_many_beginnings_follow_all_types(spark):
    g = tables.table_graph(spark, SMALL)
    assert traverse.followed(g, "downstream", spark.range(200).selectExpr("concat('x', id, ':y') as id")) is None
    assert traverse.followed(g, "downstream", spark.createDataFrame([("none",), (None,)], "id string")) == ()
    assert traverse.impact(g, spark.createDataFrame([("none",)], "id string")).isEmpty()


def test_only_types_on_cycles_are_searched(spark):
    g = tables.table_graph(spark, SMALL)
    assert g.on_cycles(CYCLE_TYPES) == ("CALLS",) and Graph(g.nodes, g.edges, g.chunks).on_cycles(CYCLE_TYPES) == CYCLE_TYPES
    both = LazyGraph(lambda: g.nodes, lambda t: g.edges_of((t,)), g.chunks, lambda e: e, ("IMPORTS", "CALLS", "DEPENDS_ON"), {"IMPORTS": (("a",), ("b",)), "CALLS": (("b",), ("a", "c")), "DEPENDS_ON": (("c",), ("d",))})
    assert both.on_cycles(CYCLE_TYPES) == ("CALLS", "IMPORTS")


def test_merging_gathers_one_list_after_the_exchange(spark):
    """Sources and evidence come from one list, which is made where an id's rows are and so is not exchanged."""
    rows = [("own", "CALLS", "a", "b", "f", 1, "s", "user", 0.5, 2), ("own", "CALLS", "a", "b", "f", 1, "s", "git", 0.9, 1), (" ", "READS", "a", "c", "g", 2, "t", "parser", 0.6, 3), ("own", "READS", "a", "c", "g", 2, "t", "git", 0.1, 4)]
    merged = store.merge_edges(spark.createDataFrame(rows, "id string, type string, from_id string, to_id string, file string, line int, snippet string, source string, confidence double, seq long"))
    got = {r.id: r for r in merged.collect()}
    assert len(got) == 2 and got["own"].sources == ["git", "user"] and got["own"].conflict and got["own"].confidence == 0.9
    assert [(e.file, e.candidate) for e in got["own"].evidence] == [("f", None), ("g", "READS a c")]
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1 and plan.index("collect_list(") < plan.index("RepartitionByExpression")


@pytest.mark.parametrize("name", ["graph_health"])
def test_checks_of_a_whole_graph_store_no_edges(spark, odd, monkeypatch, name):
    monkeypatch.setattr(tables, "_STORED", {})
    QUERIES[name](spark, odd).collect()
    assert {k for k in tables.table_graph(spark, odd).kept if k.startswith("edges ")} <= {"edges TESTS"}


def test_checks_count_each_kind_of_fault(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    schema = "id string, type string, from_id string, to_id string, n_evidence long, sources_ok boolean, conflict boolean"
    whole = [("1", "CALLS", "a", "b", 1, True, False), ("2", "CALLS", "b", "c", 2, True, False), ("3", "READS", "a", "b", 1, True, True)]
    faults = [("4", "CALLS", "a", "b", 0, False, False), ("5", "CALLS", "a", "b", 1, None, False), ("6", "CALLS", "x", "y", 0, True, None), ("7", "CALLS", None, "a", 1, True, False), ("8", None, "a", "gone", 1, True, False), ("8", None, "a", "gone", 1, True, False)]
    told = lambda rows: {r.name: (r.failed, r.ok) for r in store.validate(nodes, spark.createDataFrame(rows, schema)).collect()}
    assert told(whole) == {"dangling_edges": (0, True), "missing_evidence": (0, True), "bad_sources": (0, True), "conflicts": (1, False), "duplicate_edges": (0, True)}
    assert told(whole + faults) == {"dangling_edges": (3, False), "missing_evidence": (2, False), "bad_sources": (1, False), "conflicts": (1, False), "duplicate_edges": (3, False)}
    assert {n for n, _ in told([]).values()} == {0}


def test_degrees_from_numbers(spark, odd):
    """The tables' degrees counted by numbers are those of the edges, in the graph with calls that come back too."""
    for g in (tables.table_graph(spark, odd), looped(spark, odd)):
        assert g.degrees() is not None
        want = sorted(scan.end_counts(g.edges_of(EDGE_TYPES, once=True)).filter("id is not null").collect())
        assert sorted(g.degrees().collect()) == want and len({r.id for r in want}) == len(want)
        some = spark.createDataFrame([(r.id,) for r in want[::7]] + [("fn:none",)], "id string")
        assert sorted(scan.degrees_of(g, some).collect()) == [(r.id, r.incident) for r in want[::7]] and "degrees" not in g.kept


def test_few_starts_exchange_no_steps(spark, odd):
    """A search from few starts finds what one over steps stored by their source finds, without storing them so, and degrees are counted for what it reaches alone."""
    g = tables.table_graph(spark, odd)
    starts = settled(g.nodes.filter("kind in ('Event', 'External', 'Service', 'Table') or id like 'fn:orders/1%'").select("id"))
    for key in [k for k in g.kept if "steps" in k or k == "degrees"]:
        del g.kept[key]
    few = traverse.chosen_steps(g, "downstream", starts)
    found = settled(traverse.search_paths(few, starts, 3, 7))
    analyze.impact_summary(g, starts, found=found).collect()
    assert "n" not in few.columns and not any(k.startswith("steps") or k == "degrees" for k in g.kept)
    stored = traverse.search_paths(traverse.stored_steps(g, "downstream"), starts, 3, 7)
    told = lambda rows: sorted(tuple(map(str, r)) for r in rows.select("start", "path_no", "depth", "node", "type", "edge_id", "path", "was_seen").collect())
    assert told(found) == told(stored) and found.count() > 50


def test_whole_edges_by_numbers(spark, odd, tmp_path, monkeypatch):
    """The edges with nodes at both ends are those that a join with the nodes finds, where keys are missing or null too; none is stored or exchanged by its id."""
    folder = str(tmp_path)
    key = lambda c: F.when(F.col(c) % 7 == 0, None).otherwise(F.col(c))
    left_out = {"part": "p_partkey % 3 <> 1", "customer": "c_custkey % 4 <> 2", "supplier": "s_suppkey <> 3", "orders": "o_orderkey % 5 <> 0"}
    for t in tables._TABLES:
        rows = spark.read.parquet(f"{odd}/{t}.parquet").filter(left_out.get(t, "true"))
        for c in {"lineitem": ["l_partkey"], "orders": ["o_custkey"], "events": ["user_id"], "customer": ["c_nationkey"]}.get(t, []):
            rows = rows.withColumn(c, key(c) if c != "l_partkey" else F.when(F.col("l_suppkey") == 1, F.col(c)).otherwise(F.when(F.col("l_linenumber") != 3, F.col(c))))
        rows.write.parquet(f"{folder}/{t}.parquet")
    monkeypatch.setattr(tables, "_STORED", {})
    for d in (odd, folder):
        got = QUERIES["edge_ids"](spark, d)
        assert not any(g.kept for g in tables._STORED.values())
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join LeftSemi, (from_id" not in plan and "Join LeftSemi, (to_id" not in plan
        e, n = tables.merged_edges(tables.raw_edges(spark, d)).select("id", "type", "from_id", "to_id"), tables.table_nodes(spark, d).select("id")
        want = e.join(n.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(n.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(e.columns)
        rows = [tuple(r) for r in got.collect()]
        assert got.columns == e.columns and len(rows) == len(set(rows)) and set(rows) == {tuple(r) for r in want.collect()}
        if d == folder:
            assert 0 < len(rows) < e.filter("from_id is not null and to_id is not null").count() and {r[1] for r in rows} == set(tables.TYPES)


def test_pairs_are_made_in_cells_of_both_sides(spark, monkeypatch):
    """One API's producers and consumers are both dealt: no cell has more pairs than it may, about, and no producer is copied to more cells than consumers fill."""
    monkeypatch.setattr(analyze, "SHARE_PAIRS", 400)
    rows = [("EXPOSES", f"fn:repo:m{k % 3}/f{k}", "api:x") for k in range(200)] + [("CONSUMES", f"fn:repo:u{k % 2}/g{k}", "api:x") for k in range(300)]
    got = analyze.cross_repo(spark.createDataFrame(rows, "type string, from_id string, to_id string"))
    assert got.count() == got.distinct().count() == 200 * 300
    stored, kept = analyze.settled, []
    monkeypatch.setattr(analyze, "settled", lambda df: kept.append(stored(df)) or kept[-1])
    analyze.cross_repo(spark.createDataFrame(rows, "type string, from_id string, to_id string"))
    assert [tuple(r) for r in kept[-1].collect()] == [("api:x", 10, 15)]
