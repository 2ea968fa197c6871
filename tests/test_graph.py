"""The engine on a small fixed graph, with results worked out by hand, and on the smallest tables."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.functions.ids import canonical_json, edge_id, is_test_path, local_import, prefix_repo, repo_of
from graphloom.operators import analyze, scan, search_index, store, traverse
from graphloom.plans.queries import ORACLES, QUERIES
from graphloom.schema import Graph
from graphloom.sources import lines

SERVICE, VALIDATE = "fn:apps/payments/service.ts:processPayment", "fn:apps/payments/validate.ts:validateTransaction"
API, ORDER, TABLE, TEST = "api:POST:/payments", "ext:order-service", "table:payments", "test:tests/payments.test.ts:test_process_payment"


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(
        [(SERVICE, "Function", "processPayment", "apps/payments/service.ts", True), (VALIDATE, "Function", "validateTransaction", "apps/payments/validate.ts", False), (API, "API", "POST /payments", None, False), (ORDER, "External", "order-service", None, False), (TABLE, "Table", "payments", None, False), (TEST, "Test", "test_process_payment", "tests/payments.test.ts", False)],
        "id string, kind string, name string, path string, critical boolean",
    )
    raw = spark.createDataFrame([("EXPOSES", SERVICE, API), ("WRITES", SERVICE, TABLE), ("CONSUMES", ORDER, API), ("CALLS", SERVICE, VALIDATE), ("TESTS", TEST, SERVICE)], "type string, from_id string, to_id string")
    edges = raw.select(edge_id("type", "from_id", "to_id").alias("id"), "*", F.lit(1).alias("n_evidence"), F.lit("parser").alias("sources"), F.lit(0.9).alias("confidence"), F.lit(False).alias("conflict"))
    chunks = spark.createDataFrame([("c1", SERVICE, "code", "validateTransaction(tx)"), ("c2", VALIDATE, "code", "tx.amount > 0")], "id string, node_id string, kind string, text string")
    return Graph(nodes, edges, chunks)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_edge_ids(graph):
    assert {r.id for r in graph.edges.collect()} == {"e_16b655a52a087bde", "e_2ebe606bfbe06ee3", "e_54fd4cb3a54ccf6d", "e_d05b90e73fe6d475", "e_fcd8076e3024d9a0"}


def test_impact_in_order(spark, graph):
    got = traverse.impact(graph.edges, ids(spark, SERVICE)).orderBy("path_no").collect()
    assert [r.path for r in got] == [[SERVICE, API], [SERVICE, TEST], [SERVICE, API, ORDER]]
    up = traverse.impact(graph.edges, ids(spark, SERVICE), "upstream").collect()
    assert [r.node for r in up] == [VALIDATE]
    assert {r.node for r in traverse.impact(graph.edges, ids(spark, TABLE), depth=99, max_paths=99).collect()} == {SERVICE, API, TEST, ORDER}
    assert {(r.node, r.depth) for r in traverse.reach(graph.edges, ids(spark, VALIDATE)).collect()} == {(VALIDATE, 0), (SERVICE, 1), (API, 2), (TEST, 2), (ORDER, 3)}


def test_paths_and_flow(spark, graph):
    pairs = spark.createDataFrame([(TEST, TABLE), (SERVICE, API), (API, API), (TABLE, TEST)], "from_id string, to_id string")
    got = {(r.from_id, r.to_id): r.path for r in traverse.why_paths(graph.edges, pairs).collect()}
    assert got == {(TEST, TABLE): [TEST, SERVICE, TABLE], (SERVICE, API): [SERVICE, API], (API, API): [API]}
    assert [(r.type, r.node) for r in traverse.flow(graph.edges, ids(spark, SERVICE)).orderBy("step").collect()] == [("EXPOSES", API), ("WRITES", TABLE), ("CALLS", VALIDATE)]


def test_risk_chips_policies(spark, graph):
    chips = {r.start: r.chips for r in analyze.impact_summary(graph, ids(spark, SERVICE, TABLE)).collect()}
    # the service reaches its API, its test and, over the API, an external consumer; nothing critical but itself
    assert chips[SERVICE] == ["downstream", "critical", "external"] and chips[TABLE] == ["downstream", "critical", "db_write", "external"]
    risk = {r.start: r for r in analyze.risk_profile(graph, ids(spark, SERVICE)).collect()}[SERVICE]
    # four edges touch the service, three nodes are at most at one end, one edge writes; 12 + 20 + 12 + 10 + 20
    assert (risk.dependency_count, risk.downstream_consumers, risk.centrality, risk.db_interactions, risk.external_deps, risk.test_coverage, risk.score, risk.level) == (4, 3, 1.333, 1, 1, True, 74, "high")
    assert risk.signals == "moderate_downstream,hub,db_interaction,external_dependency,critical_path"
    rules = {(r.start, r.policy, r.severity) for r in analyze.policies(graph, ids(spark, SERVICE, TABLE), ("db_write_on_path",)).collect()}
    assert rules == {(SERVICE, "public_route_without_contract", "warn"), (TABLE, "public_route_without_contract", "warn"), (TABLE, "db_write_on_path", "block")}
    said = analyze.narration(analyze.impact_summary(graph, ids(spark, SERVICE))).first().text
    assert said == f"Changing {SERVICE} affects 3 node(s). Risks: downstream, critical, external. Example path: {SERVICE} → {API}."
    assert {r.file for r in analyze.plan_change(graph, ids(spark, SERVICE)).collect()} == {"apps/payments/service.ts"}
    assert traverse.impact(graph.edges, ids(spark, SERVICE), depth=0).count() == 0
    assert [(r.test, r.command) for r in analyze.tests_to_run(graph, ids(spark, SERVICE)).collect()] == [(TEST, "npm test")]


def test_route_tiers(spark):
    rows = [("  Impact ", False, 0.0, "deterministic", 0), ("incident", False, None, "strong", 10), ("summary", False, 0.9, "strong", 10), ("summary", False, 0.1, "cheap", 1), ("other", False, 0.1, "cheap", 1), ("other", None, 0.0, "deterministic", 0), ("impact", True, 0.0, "verifier", 12)]
    got = analyze.route(spark.createDataFrame([r[:3] for r in rows], "task string, security_sensitive boolean, ambiguity double")).collect()
    assert sorted((r.task, r.tier, r.cost, r.uses_model, r.provider_locked) for r in got) == sorted((r[0], r[3], r[4], r[3] != "deterministic", False) for r in rows)


def test_conflicts_stick(spark):
    rows = [("e1", "CALLS", "a", "b", "f", 1, "x", "parser", 0.5, 1), ("e1", "CALLS", "a", "c", "f", 2, "y", "git", 0.9, 2), ("e1", "CALLS", "a", "b", "f", 1, "x", "parser", 0.1, 3), (None, "READS", "a", "t", "f", 3, "z", "parser", 0.6, 4)]
    got = {r.type: r for r in store.merge_edges(spark.createDataFrame(rows, "id string, type string, from_id string, to_id string, file string, line int, snippet string, source string, confidence double, seq int")).collect()}
    assert (got["CALLS"].id, got["CALLS"].to_id, got["CALLS"].conflict, got["CALLS"].sources, got["CALLS"].confidence) == ("e1", "b", True, ["parser", "git"], 0.9)
    assert [e.candidate for e in got["CALLS"].evidence] == [None, "CALLS a c"] and not got["READS"].conflict and got["READS"].id.startswith("e_")


def test_fixed_lists(spark):
    from graphloom.sources.files import EXTENSIONS, IGNORED, MANIFESTS, wanted

    assert {"generated", ".turbo", "vendor"} <= set(IGNORED) and "target" not in IGNORED
    assert all(wanted(f"a.{x}") for x in EXTENSIONS) and all(map(wanted, MANIFESTS)) and not any(map(wanted, ("readme.md", "makefile", "compose.txt", "py")))
    kinds = {"api/OpenAPI.v1.yaml": "openapi", "my-swagger.json": "openapi", "asyncapi.yml": "openapi", "db/a.SQL": "sql", "compose.yml": "compose", "docker-compose.yaml": "compose", "compose.dev.yml": None, "Dockerfile": "dockerfile", "dockerfile.dev": "dockerfile", "dockerfiles": None, ".env": "config", ".env.local": "config", "prod.env": "config", ".envrc": None}
    df = spark.createDataFrame([(p,) for p in kinds], "path string")
    assert {r.path: r.k for r in df.select("path", lines.kind_of_file(F.col("path")).alias("k")).collect()} == kinds
    tests = {"tests/a.ts": True, "test/a.ts": True, "__tests__/a.js": True, "spec/a.rb": True, "specs/a.rb": False, "a.test.mjs": True, "a.spec.tsx": True, "a.test.txt": False, "x/test_a.py": True, "a_test.go": True, "a_test.java": True, "tests.py": True, "ATest.java": False}
    df = spark.createDataFrame([(p,) for p in tests], "path string")
    assert {r.path: r.k for r in df.select("path", is_test_path("path").alias("k")).collect()} == tests
    code = "export default async function a1() {\nexport abstract class B1 {\n  const c1 = async (x) => 1\ndef d1():\nclass E1:\nfn f1() {\nsub g1\nfunc h1()\nlet no = (1)"
    got = lines.symbols(spark.createDataFrame([("p.ts", code)], "path string, content string")).orderBy("line").collect()
    assert [(r.line, r.kind, r.name) for r in got] == [(1, "Function", "a1"), (2, "Class", "B1"), (3, "Function", "c1"), (4, "Function", "d1"), (5, "Class", "E1"), (6, "Function", "f1"), (7, "Function", "g1"), (8, "Function", "h1")]
    assert got[7].chunk == "func h1()\nlet no = (1)"
    said = spark.createDataFrame([("lastupdate x",), ("update y set",), ("select from z",)], "text string")
    assert [(r.access, r.table_name) for r in lines.sql_in_text(said).collect()] == [("WRITES", "y"), ("READS", "z")]


def test_search_hubs_maps(graph):
    assert {r.node_id: r.score for r in analyze.search(graph, "validateTransaction").collect()} == {VALIDATE: 2.75, SERVICE: 1.75}
    top = [(r.id, r.metric) for r in analyze.hubs(graph).collect()]
    assert top[:2] == [(SERVICE, 4), (API, 2)]
    assert {v: analyze.project_map(graph, v).count() for v in ("call", "db", "api", "service", "dependency", "hierarchical")} == {"call": 1, "db": 1, "api": 1, "service": 2, "dependency": 0, "hierarchical": 0}
    with pytest.raises(ValueError):
        analyze.project_map(graph, "none")
    with pytest.raises(ValueError):
        scan.find_nodes(graph.nodes, "")


def test_store(spark, graph):
    rows = spark.createDataFrame([("CALLS", SERVICE, VALIDATE, "a.ts", 1, "x", "parser", 0.5, 1), ("CALLS", SERVICE, VALIDATE, "b.ts", 2, "y", "git", 0.9, 2), ("CALLS", SERVICE, VALIDATE, "a.ts", 1, "x", "git", None, 3), ("CALLS", SERVICE, "gone", "a.ts", 1, "x", "parser", 0.5, 4), ("CALLS", VALIDATE, SERVICE, None, None, None, "parser", 0.5, 5)], "type string, from_id string, to_id string, file string, line int, snippet string, source string, confidence double, seq long")
    got = store.upsert_edges(rows, graph.nodes).collect()
    assert len(got) == 1 and [e.file for e in got[0].evidence] == ["a.ts", "b.ts"] and got[0].sources == ["parser", "git"] and got[0].confidence == 0.9
    nodes = spark.createDataFrame([("a", "Function", "old", 1), (" a ", "Function", "new", 2), ("b", "Nothing", "x", 1)], "id string, kind string, name string, seq long")
    assert [(r.id, r.name) for r in store.upsert_nodes(nodes).collect()] == [("a", "new")]


def test_text_functions(spark):
    df = spark.createDataFrame([("fn:a/b.ts:f", '{"b":1,"a":{"d":2,"c":3}}')], "id string, j string")
    row = df.select(prefix_repo(prefix_repo("id", F.lit("web")), F.lit("x")).alias("p"), repo_of(prefix_repo("id", F.lit("web"))).alias("r"), canonical_json("j").alias("j"), local_import(F.lit("src/a/b.ts"), F.lit("../c/d")).alias("i")).first()
    assert tuple(row) == ("fn:repo:web/a/b.ts:f", "web", '{"a":{"c":3,"d":2},"b":1}', "src/c/d.ts")


def test_line_scanners(spark):
    files = spark.createDataFrame(
        [("openapi.yaml", "paths:\n  /a:\n    get:\n    post:\n  /b:\n    put:\n"), ("schema.sql", "CREATE TABLE t (\n  id int,\n  primary key (id)\n);\n"), ("docker-compose.yml", "services:\n  web:\n    image: x\n  db:\n    image: y\nvolumes:\n  v:\n"), ("requirements.txt", "# c\nflask==2.0\nnumpy\n"), (".env", "KEY=1\nlow=2\n"), ("a.py", "class A:\n    def f(self):\n        g()\n")],
        "path string, content string",
    )
    of = lambda name: files.filter(F.col("path") == name)
    assert [(r.method, r.route) for r in lines.openapi_routes(of("openapi.yaml")).orderBy("line").collect()] == [("GET", "/a"), ("POST", "/a"), ("PUT", "/b")]
    assert [(r.table, r.column) for r in lines.sql_tables(of("schema.sql")).orderBy("line").collect()] == [("t", None), ("t", "id")]
    assert [r.service for r in lines.compose_services(of("docker-compose.yml")).orderBy("line").collect()] == ["web", "db"]
    assert [(r.package, r.version) for r in lines.requirements(of("requirements.txt")).collect()] == [("flask", "2.0"), ("numpy", None)]
    assert [r.key for r in lines.config_keys(of(".env")).collect()] == ["KEY"]
    assert [(r.kind, r.name) for r in lines.symbols(of("a.py")).orderBy("line").collect()] == [("Class", "A"), ("Function", "f")]
    assert [r.callee for r in lines.calls(of("a.py")).collect()] == ["g"]


@pytest.mark.parametrize("name", ["nodes_by_kind", "impact_down", "edge_merge", "map_focus", "sql_in_text", "openapi_forward_fill", "line_scan", "find_nodes"])
def test_against_sql(spark, name):
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    got, want = QUERIES[name](spark, d).toPandas(), con.execute(ORACLES[name]).df()
    rows = lambda x: sorted(tuple(map(str, r)) for r in x[sorted(x.columns)].astype(object).where(x[sorted(x.columns)].notna(), None).values)
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_cross_repo_reads_every_customer(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment").collect()
    name = lambda r: f"fn:repo:n{r.c_nationkey}/c{r.c_custkey}"
    want = {(name(u), name(m)) for m in rows for u in rows if m.c_custkey % 50 == 0 and u.c_custkey % 50 and m.c_mktsegment == u.c_mktsegment and m.c_nationkey != u.c_nationkey}
    got = [tuple(r) for r in QUERIES["cross_repo_all"](spark, d).select("from_id", "to_id").collect()]
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{d}/customer.parquet'")
    assert len(got) == len(want) and set(got) == want == set(con.execute(ORACLES["cross_repo_all"]).fetchall())
    assert any(int(u.rsplit("/c", 1)[1]) % 10 for u, _ in got)


def test_a_level_exchanges_its_frontier_only(spark, graph):
    """Stored steps are read by bucket: the one exchange of a level's join is of the frontier, whose rows are few."""
    steps = traverse.stored_steps(graph, "downstream")
    frontier = spark.createDataFrame([(f"fn:{k}",) for k in range(100)], "node string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = traverse.onward(frontier, steps)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(node" in plan and "Bucketed: true" in plan
    assert traverse.stored_steps(graph, "downstream") is steps


@pytest.mark.parametrize("seed", [1, 2])
def test_why_paths_by_enumeration(spark, seed):
    """All simple paths of up to five steps in a dense random graph, shorter ones first, then by their edges' ids; some pairs have more than seven."""
    rng = random.Random(seed)
    edges = [(f"e{k:03}", rng.choice(("CALLS", "READS", "TESTS")), f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for k in range(45)]
    pairs = [(f"n{a}", f"n{b}") for a in range(0, 14, 3) for b in range(0, 14, 2)]
    frame = spark.createDataFrame([(*e, False) for e in edges], "id string, type string, from_id string, to_id string, conflict boolean")
    want = {}
    for pair in pairs:
        found, trails = [], [([pair[0]], [])]
        for _ in range(6):
            found += [(len(e), e, p) for p, e in trails if p[-1] == pair[1]]
            trails = [([*p, b], [*e, i]) for p, e in trails if p[-1] != pair[1] for i, _, a, b in edges if a == p[-1] and b not in p]
        for n, (_, e, p) in enumerate(sorted(found)[:7], 1):
            want[(*pair, n)] = (p, e)
    got = traverse.why_paths(frame, spark.createDataFrame(pairs, "from_id string, to_id string")).collect()
    assert {(r.from_id, r.to_id, r.path_no): (r.path, r.edge_path) for r in got} == want and any(k[2] == 7 for k in want)


def test_pairs_leave_the_search_with_their_last_wanted_path(spark, monkeypatch):
    """Seven direct steps and a long way round: nothing is asked for beyond the first length."""
    rows = [(f"e{k}", t, "a", "b", False) for k, t in enumerate(("CALLS", "READS", "WRITES", "TESTS", "IMPORTS", "CONTAINS", "EXPOSES"))] + [("f1", "CALLS", "a", "c", False), ("f2", "CALLS", "c", "b", False)]
    frame = spark.createDataFrame(rows, "id string, type string, from_id string, to_id string, conflict boolean")
    jobs, plain = [], traverse.settled
    monkeypatch.setattr(traverse, "settled", lambda df, by=None: (jobs.append(1), plain(df, by))[1])
    got = traverse.why_paths(frame, spark.createDataFrame([("a", "b")], "from_id string, to_id string")).collect()
    assert [r.length for r in got] == [1] * 7 and len(jobs) == 3  # the pairs, the direct steps, and the pairs still open


def test_search_by_index_equals_the_scan(spark):
    """Phrases that begin and end inside tokens, hold other signs, or have no whole token; kinds; repeated chunks; nodes without chunks."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gammaray", "Delta.x", "e-mail", "foo_bar", "the", "of", "ünder", "x@y"]
    nodes = [(f"fn:n{k}", rng.choice(("Function", "Class", "class")), rng.choice(("Alpha beta", "run", "the", "Foo_Bar"))) for k in range(60)] + [("fn:N1", "Function", "run"), ("fn:bare", "Doc", "alpha")]
    chunks = [(f"c{k}", f"fn:n{rng.randrange(60)}", rng.choice(("code", "doc")), rng.choice((" ", ", ", "\n")).join(rng.choice(words) for _ in range(rng.randrange(9)))) for k in range(300)] + [("c0", "fn:n1", "code", None), ("c0", "gone", "code", "alpha beta"), ("cn", "fn:N1", "doc", "alpha beta of the")]
    g = Graph(spark.createDataFrame(nodes, "id string, kind string, name string"), None, spark.createDataFrame(chunks, "id string, node_id string, kind string, text string"))
    named = {n[0]: n for n in nodes}
    for query, kind in (("pha bet", None), ("PHA, BETA, GAM", "code"), ("ray", None), ("fn:n1", None), ("mail ünder x", None), ("(alpha)", None), ("zzz", None)):
        want = {r.node_id: r.score for r in analyze.search(g, query, kind).collect()}
        assert {r.node_id: r.score for r in search_index.search(g, query, kind).collect()} == want, query
        for first in (256, 2):
            search_index.FIRST = first
            top = search_index.search_top(g, query, kind, 5).orderBy("rank").collect()
            assert [r.score for r in top] == sorted(want.values(), reverse=True)[:5] and all(want[r.id] == r.score and named[r.id][1:] == (r.kind, r.name) for r in top), (query, first)
        search_index.FIRST = 256
    top = [(r.id, r.kind) for r in search_index.search_top(g, "fn:", None, 50).orderBy("rank").collect()]
    assert top == [(r.id, r.kind) for r in g.nodes.join(search_index.search(g, "fn:"), F.col("id") == F.col("node_id")).orderBy(F.desc("score"), F.expr("kind COLLATE UNICODE"), F.expr("id COLLATE UNICODE")).limit(50).collect()]
    postings = search_index.index(g)[0]
    assert len(postings.inputFiles()) <= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't tell that other buckets' files are left out
    try:
        plan = postings.filter(F.col("token") == "alpha").select("uid")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of" in plan


def test_evidence_as_rows_is_the_lists(spark):
    """Repeats, conflicts and one edge with most rows: the same edges and pieces, in the same order, without a list of them."""
    rng = random.Random(3)
    rows = [(rng.choice((None, None, "x1", " ")), rng.choice(("CALLS", "READS")), rng.choice("ab"), rng.choice("bc"), rng.choice(("f", "g", None)), rng.randrange(9), rng.choice("st"), rng.choice(("parser", "git")), rng.random(), k) for k in range(300)]
    rows += [(None, "CALLS", "hot", "hub", "f", k % 700, "s", "user", 0.1, 1000 + k) for k in range(2000)]
    raw = spark.createDataFrame(rows, "id string, type string, from_id string, to_id string, file string, line int, snippet string, source string, confidence double, seq long").repartition(5)
    for some in (raw, raw.drop("id"), raw.limit(0)):
        want = {r.id: r for r in store.merge_edges(some).collect()}
        edges, evidence = store.merged_rows(some)
        got = {r.id: r for r in edges.collect()}
        assert got.keys() == want.keys()
        pieces = {}
        for r in evidence.orderBy("id", "no").collect():
            pieces.setdefault(r.id, []).append((r.no, r.file, r.line, r.snippet, r.candidate))
        for i, w in want.items():
            g = got[i]
            assert (g.type, g.from_id, g.to_id, g.sources, g.confidence, g.conflict, g.n_evidence) == (w.type, w.from_id, w.to_id, w.sources, w.confidence, w.conflict, len(w.evidence))
            assert pieces[i] == [(n, e.file, e.line, e.snippet, e.candidate) for n, e in enumerate(w.evidence, 1)]


def test_factored_dependencies_are_the_pairs(spark):
    edges = [("EXPOSES", f"fn:repo:r{k % 3}/m{k}", f"api:{k % 4}") for k in range(12)] + [("CONSUMES", f"fn:repo:r{k % 4}/u{k}", f"api:{k % 5}") for k in range(30)] + [("CONSUMES", "fn:none", "api:0"), ("CALLS", "fn:repo:r1/m1", "api:0"), ("CONSUMES", "fn:repo:r0/u0", "api:0")]
    df = spark.createDataFrame(edges, "type string, from_id string, to_id string")
    factors = analyze.cross_repo_factors(df)
    repo = lambda i: i.split(":")[2].split("/")[0]
    links = {(u, m, a) for t, u, a in edges if t == "CONSUMES" and "repo" in u for s, m, b in edges if s == "EXPOSES" and a == b and repo(u) != repo(m)}
    counts = {(r.consumer, r.producer): r.links for r in analyze.cross_repo_counts(factors).collect()}
    assert sum(counts.values()) == len(links) and all(n == sum((repo(u), repo(m)) == k for u, m, _ in links) for k, n in counts.items())
    pairs = {(r.from_id, r.to_id) for r in analyze.cross_repo(df).collect()}
    assert {(r.from_id, r.to_id) for r in analyze.cross_repo_pairs(factors, "r0", "r1").collect()} == {p for p in pairs if (repo(p[0]), repo(p[1])) == ("r0", "r1")} and pairs == {x[:2] for x in links}
    assert factors.count() <= len(edges)


@pytest.mark.parametrize("hidden", [0, 15, 40])
def test_a_chart_stores_its_first_edges_only(spark, monkeypatch, hidden):
    names = [f"fn:a{k}" for k in range(40)]
    nodes = spark.createDataFrame([(x, "Function", x, None, False) for x in names[hidden:]] + [("cls:alone", "Class", "alone", None, False), ("table:t", "Table", "t", None, False)], "id string, kind string, name string, path string, critical boolean")
    edges = spark.createDataFrame([(f"e{k:02}", "CALLS", x, y) for k, (x, y) in enumerate(zip(names, names[1:], strict=False))], "id string, type string, from_id string, to_id string")
    stored, real = [], analyze.settled
    monkeypatch.setattr(analyze, "settled", lambda df, *a: stored.append(real(df, *a)) or stored[-1])
    shown, drawn, counts = analyze.capped_map(Graph(nodes, edges, None), "call", edge_cap=3, node_cap=5)
    left = [k for k in range(39) if k >= hidden][:3]
    ends = {names[k + d] for k in left for d in (0, 1)}
    assert {r.id for r in drawn.collect()} == {f"e{k:02}" for k in left} and {r.id for r in shown.collect()} == ends
    got = {r.name: r.n for r in counts.collect()}
    assert (got["total_matching_edges"], got["total_matching_nodes"], got["truncated"], got["empty_view"]) == (max(0, 39 - hidden), len(ends), int(39 - hidden > 3), int(not ends))
    assert max(df.count() for df in stored) <= 2 * 3 * analyze.EARLY  # the ends of as many edges
