"""Sync and operations on small workspaces, with results worked out by hand; the workspace queries beside their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_graph import API, ORDER, SERVICE, TABLE, TEST, VALIDATE, graph, ids  # noqa: F401  graph is a fixture

from graphloom.functions.lineage import settled
from graphloom.operators import analyze, components, scan, store
from graphloom.operators.operations import OPERATIONS, dispatch
from graphloom.plans import workspace  # noqa: F401
from graphloom.plans.queries import ORACLES, QUERIES
from graphloom.schema import Graph, GraphError
from graphloom.sources import extract, lines

TREE = {
    "apps/payments/service.ts": "import { v } from './validate'\nimport express from 'express'\ninterface Payer {\n}\nclass Payments implements Payer {\n  charge(tx) {\n    validate(tx)\n    db.run(\"INSERT INTO payments values (1)\")\n  }\n}\nexport function setup(app) {\n  app.post('/payments', h)\n  bus.emit('paid')\n}\n",
    "apps/payments/validate.ts": "export function validate(tx) {\n  return tx.amount > 0\n}\n",
    "apps/orders/client.ts": "export async function order() {\n  await fetch('https://x.example/payments', {method: 'POST'})\n}\n",
    "tests/payments.test.ts": "import { validate } from '../apps/payments/validate'\ntest('x', () => {\n  validate(1)\n})\n",
    "openapi.yaml": "openapi: 3\n  /before:\n    get:\npaths:\n  /payments:\n    POST:\n",
    "schema.sql": "CREATE TABLE payments (\n  id int,\n  unique (id)\n);\n",
    "docker-compose.yml": "services:\n  web:\n    image: x\n",
    "Dockerfile": "FROM node:20\n",
    ".env": "KEY=1\nexport NO=2\n",
    "package.json": '{"dependencies":{"express":"4"}}',
    "requirements.txt": "flask==2.0\n",
    "svc/worker.py": "import os\n\ndef load(\n    a,\n):\n    return helper(a)\n\ndef helper(a):\n    return a\n\ndef helper(b):\n    return b\n",
    "main.go": "func run() {\n  validate()\n}\n",
    "empty.ts": None,
}


@pytest.fixture(scope="module")
def synced(spark):
    rows = [(None, p, c, "x") for p, c in TREE.items()]
    return extract.sync(spark.createDataFrame(rows, "repo string, path string, content string, sha256 string"))


def test_sync_edges(synced):
    got = {(r.type, r.from_id, r.to_id, r.confidence) for r in synced.edges.collect()}
    serve, validate = "fn:apps/payments/service.ts:", "fn:apps/payments/validate.ts:validate"
    want = {
        ("CALLS", serve + "charge", validate, 0.75), ("CALLS", "fn:svc/worker.py:load", "fn:svc/worker.py:helper", 0.9), ("TESTS", "test:tests/payments.test.ts:suite", validate, 0.7),
        ("EXPOSES", serve + "setup", "api:POST:/payments", 0.7), ("CONSUMES", "fn:apps/orders/client.ts:order", "api:POST:/payments", 0.6), ("PUBLISHES", serve + "setup", "event:paid", 0.5),
        ("WRITES", serve + "charge", "table:payments", 0.6), ("IMPLEMENTS", "cls:apps/payments/service.ts:Payments", "iface:apps/payments/service.ts:Payer", 0.8),
        ("IMPORTS", "file:apps/payments/service.ts", "file:apps/payments/validate.ts", 0.7), ("IMPORTS", "file:apps/payments/service.ts", "ext:express", 0.8), ("DEPENDS_ON", "file:package.json", "ext:express", 0.9), ("DEPENDS_ON", "file:requirements.txt", "ext:flask", 0.9),
        ("DOCUMENTS", "doc:https://www.npmjs.com/package/express", "ext:express", 0.5), ("CONSTRAINED_BY", "api:POST:/payments", "contract:openapi.yaml", 0.9), ("DOCUMENTS", "contract:openapi.yaml", "api:POST:/payments", 0.9),
        ("CONTAINS", "table:payments", "col:payments.id", 0.9), ("CONTAINS", "infra:docker-compose.yml", "svc:web", 0.8), ("CONTAINS", "svc:payments", "file:apps/payments/service.ts", 0.6), ("CONTAINS", "svc:orders", "file:apps/orders/client.ts", 0.6),
    }
    assert want <= got
    assert not any("/before" in r[2] or "unique" in r[2] for r in got)
    assert {r[1:3] for r in got if r[0] == "CALLS"} == {(serve + "charge", validate), ("fn:svc/worker.py:load", "fn:svc/worker.py:helper"), (serve + "charge", "fn:main.go:run")}


def test_sync_nodes_and_counts(synced):
    nodes = {r.id: r for r in synced.nodes.collect()}
    assert (nodes["fn:svc/worker.py:load"].start_line, nodes["fn:svc/worker.py:load"].end_line) == (3, 6)
    assert (nodes["fn:apps/payments/service.ts:charge"].kind, nodes["fn:apps/payments/service.ts:charge"].end_line) == ("Method", 9)
    assert nodes["svc:payments"].path == "apps/payments" and nodes["file:empty.ts"].kind == "File" and "cfg:KEY" in nodes and "cfg:NO" not in nodes and "infra:Dockerfile" in nodes
    counts = synced.counts.first()
    assert (counts.roots, counts.files, counts.changed, counts.skipped, counts.services, counts.cross_repo_edges) == (1, len(TREE), len(TREE), 0, 2, 0)
    assert {r.id: r.text for r in synced.chunks.collect()}["chunk:fn:svc/worker.py:helper"] == "def helper(a):\n    return a"


def test_sync_skips_what_is_known_and_keeps_repositories_apart(spark):
    rows = [("one", "a/x.ts", "function f() {\n}\n", "1"), ("two", "a/x.ts", "function f() {\n}\nfunction g() {\n  f()\n}\n", "2"), ("two", "package.json", '{"dependencies":{"p":"1"}}', "3")]
    files = spark.createDataFrame(rows, "repo string, path string, content string, sha256 string")
    got = extract.sync(files)
    assert {(r.from_id, r.to_id) for r in got.edges.filter("type = 'CALLS'").collect()} == {("fn:repo:two/a/x.ts:g", "fn:repo:two/a/x.ts:f")}
    names = {r.id for r in got.nodes.collect()}
    assert {"fn:repo:one/a/x.ts:f", "file:repo:two/package.json", "ext:p"} <= names and got.counts.first().roots == 2
    known = spark.createDataFrame([("repo:one/a/x.ts", "1"), ("repo:two/a/x.ts", "old")], "path string, sha256 string")
    again = extract.sync(files, known, known.select("path")).counts.first()
    assert (again.changed, again.skipped) == (2, 1)


def test_empty_workspace(spark):
    got = extract.sync(spark.createDataFrame([], "repo string, path string, content string, sha256 string"))
    assert got.nodes.isEmpty() and got.edges.isEmpty() and got.counts.first().files == 0


def test_cross_repo_evidence(spark):
    told = lambda f: [(f, 3, "x")]
    rows = [("EXPOSES", "fn:repo:a/s.ts:h", "api:GET:/x", told("s.ts")), ("CONSUMES", "fn:repo:b/c.ts:k", "api:GET:/x", told("c.ts")), ("CONSUMES", "fn:repo:a/d.ts:k", "api:GET:/x", told("d.ts")), ("CONSUMES", "fn:z.ts:k", "api:GET:/x", None)]
    edges = spark.createDataFrame(rows, "type string, from_id string, to_id string, evidence array<struct<file string, line int, snippet string>>")
    got = store.merge_edges(extract.cross_repo_evidence(edges)).collect()
    assert [(r.type, r.from_id, r.to_id, r.confidence, [(e.file, e.line, e.snippet) for e in r.evidence]) for r in got] == [("DEPENDS_ON", "fn:repo:b/c.ts:k", "fn:repo:a/s.ts:h", 0.7, [("c.ts", 3, "consumes api:GET:/x"), ("s.ts", 3, "exposes api:GET:/x")])]


def test_enclosing_keeps_equal_rows(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 2, "x"), ("a", 9, "y"), (None, 1, "z")], "path string, line int, what string")
    spans = spark.createDataFrame([("a", "outer", 1, 5), ("a", "inner", 2, 3)], "path string, name string, start_line int, end_line int")
    assert sorted((r.what, str(r.symbol)) for r in lines.enclosing(rows, spans).collect()) == [("x", "inner"), ("x", "inner"), ("y", "None"), ("z", "None")]


def _ids(frame, column="id"):
    return {r[column] for r in frame.collect()}


def test_operations_on_the_fixed_graph(spark, graph):  # noqa: F811
    g = Graph(settled(graph.nodes), settled(graph.edges), graph.chunks)
    assert len(OPERATIONS) == 19
    got = dispatch(g, "impact", id=SERVICE)
    assert got.ok and got.evidence_used and _ids(got.nodes) == {SERVICE, API, ORDER, TEST} and {r.name: r.n for r in got.counts.collect()} == {"API": 1, "External": 1, "Test": 1}
    assert [r.chip for r in got.risk.collect()] == ["downstream", "critical", "external"] and _ids(got.more["tests_to_run"]) == {TEST} and got.more["risk_profile"].first().score == 74
    assert "risk_profile" not in dispatch(g, "impact", id=SERVICE, direction="upstream").more
    around = dispatch(g, "neighbors", id=SERVICE)
    assert around.edges.count() == 4 and around.nodes.count() == 5
    assert dispatch(g, "symbol", id="processPayment").more["symbol"].first().id == SERVICE
    why = dispatch(g, "why_path", from_=TEST, to=TABLE)
    assert [r.path for r in why.paths.collect()] == [[TEST, SERVICE, TABLE]] and why.edges.count() == 2
    assert dispatch(g, "flow", id=SERVICE).counts.first().n == 3
    tests = dispatch(g, "tests_to_run", id=SERVICE)
    assert _ids(tests.more["commands"], "command") == {"npm test"} and tests.risk.isEmpty() and dispatch(g, "tests_to_run", id=ORDER).risk.first().chip == "untested"
    changes = spark.createDataFrame([(SERVICE, "signature"), ("fn:none", "body")], "id string, change string")
    diff = dispatch(g, "diff_impact", changes=changes)
    assert ORDER in _ids(diff.nodes) and "api_shape_change" in _ids(diff.risk, "chip") and {r.id: r.known for r in diff.more["changed"].collect()} == {SERVICE: True, "fn:none": False}
    assert dispatch(g, "validate_graph").ok and {r.name: r.n for r in dispatch(g, "validate_graph").counts.collect()} == {"edges_checked": 5, "conflicts": 0, "failed": 0}
    rule = dispatch(g, "evaluate_policy", id=SERVICE)
    assert rule.ok and _ids(rule.more["violations"], "policy") == {"public_route_without_contract"} and not dispatch(g, "evaluate_policy", id=TABLE, blocking=("db_write_on_path",)).ok
    plan = dispatch(g, "plan_change", id=SERVICE)
    assert _ids(plan.more["allowed_files"], "file") == {"apps/payments/service.ts"} and {r.name: r.n for r in plan.counts.collect()} == {"impacted": 3, "allowed_files": 1, "tests": 1}
    done = dispatch(g, "orchestrate", id=SERVICE)
    assert done.ok and {r.step: r.detail for r in done.more["steps"].collect()} == {"plan": "3 impacted", "verify_graph": "0 checks failed", "verify_impact_stable": "4 vs 4"}
    assert {r.name: r.n for r in dispatch(g, "health").counts.collect()} == {"nodes": 6, "edges": 5, "critical_untested": 0}
    assert [r.id for r in dispatch(g, "search", q="validateTransaction").nodes.orderBy("rank").collect()] == [VALIDATE, SERVICE]
    assert dispatch(g, "route", task="impact").more["route"].first().tier == "deterministic"
    shown = dispatch(g, "map", view="dependency")
    assert _ids(shown.risk, "chip") == {"empty_view"} and dispatch(g, "map", view="db").edges.count() == 1
    report = dispatch(g, "insights").more["insights"].collect()
    assert [(r.id, r.metric) for r in report if r.section == "hubs"][:2] == [(SERVICE, 4), (API, 2)]
    assert {(r.id, r.metric) for r in report if r.section == "large_downstream_impact"} == {(VALIDATE, 4), (TABLE, 4), (SERVICE, 3), (API, 1)}
    pinned = dispatch(g, "pin", type="CALLS", from_=VALIDATE, to=SERVICE)
    assert pinned.ok and pinned.edges.first().sources == ["user"] and dispatch(g, "graph", node_limit=2).nodes.count() == 2


def test_operations_say_what_is_wrong(spark, graph):  # noqa: F811
    wrong = [("nothing", {}), ("impact", {}), ("impact", {"id": "fn:none"}), ("impact", {"id": SERVICE, "direction": "left"}), ("search", {"q": " "}), ("search", {"q": "§"}), ("symbol", {"id": "zzz"}), ("map", {"view": "none"}), ("pin", {"type": "CALLS", "from_": SERVICE, "to": "gone"}), ("pin", {"type": "NONE"}), ("neighbors", {"id": SERVICE, "direction": "up"})]
    for name, args in wrong:
        got = dispatch(graph, name, **args)
        assert not got.ok and got.error and not got.evidence_used, name


def test_insight_micro_graphs(spark):
    def of(names, pairs):
        nodes = spark.createDataFrame([(n, "Function", n, None, False) for n in names], "id string, kind string, name string, path string, critical boolean")
        edges = spark.createDataFrame([(f"e{i}", "CALLS", a, b, 1, "parser", 0.9, False) for i, (a, b) in enumerate(pairs)], "id string, type string, from_id string, to_id string, n_evidence int, sources string, confidence double, conflict boolean")
        return Graph(nodes, edges, spark.createDataFrame([], "id string, node_id string, kind string, text string"))

    got = {(r.section, r.id): r.metric for r in analyze.insights(of("abz", [("a", "b"), ("b", "a")])).collect()}
    assert got[("cycles", "a>b>a")] == 2 and got[("isolated", "z")] == 0 and ("hotspots", "a") in got
    star = {(r.section, r.id): r.metric for r in analyze.insights(of("habcde", [(x, "h") for x in "abcde"])).collect()}
    assert star[("hubs", "h")] == 5 and star[("large_downstream_impact", "h")] == 5 and not any(s == "bottlenecks" for s, _ in star)


def test_insights_report_all_cycles_of_large_components(spark, monkeypatch):
    """A component of more than DFS_EDGES edges gives the report each of its cycles, as a small one does."""
    monkeypatch.setattr(components, "DFS_EDGES", 3)
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "a"), ("d", "d")]
    nodes = spark.createDataFrame([(n, "Function", n, None, False) for n in "abcd"], "id string, kind string, name string, path string, critical boolean")
    edges = spark.createDataFrame([(f"e{i}", "CALLS", a, b, 1, "parser", 0.9, False) for i, (a, b) in enumerate(pairs)], "id string, type string, from_id string, to_id string, n_evidence int, sources string, confidence double, conflict boolean")
    got = analyze.insights(Graph(nodes, edges, spark.createDataFrame([], "id string, node_id string, kind string, text string"))).filter("section = 'cycles'").orderBy("rank").collect()
    assert [(r.id, r.metric) for r in got] == [("a>b>a", 2), ("b>c>d>b", 3), ("a>b>c>d>a", 4), ("d>d", 1)]


def test_journal_health_critical(spark, graph):  # noqa: F811
    none = spark.createDataFrame([], "seq long, ts string, event string, payload string")
    first = store.append_journal(none, spark.createDataFrame([("2", "sync", "b"), ("1", "sync", "a"), ("1", "pin", "c")], "ts string, event string, payload string"))
    assert [(r.seq, r.payload) for r in scan.list_journal(first, "sync").collect()] == [(3, "b"), (2, "a")] and scan.list_journal(first, limit=0).count() == 1
    marked = store.mark_critical(graph.nodes, ids(spark, VALIDATE))
    assert _ids(marked.filter("critical")) == {SERVICE, VALIDATE}
    with pytest.raises(GraphError):
        store.mark_critical(graph.nodes, ids(spark, "gone"))
    with pytest.raises(GraphError):
        scan.resolve(graph.nodes, "")


@pytest.mark.parametrize("name", ["sync_edges", "sync_nodes", "file_nodes", "service_nodes", "sync_chunks", "journal_scan", "health_set", "mark_critical", "impact_multi", "orchestrate", "cross_repo_edges", "map_nodes", "map_counts", "insights", "canonical_json", "enclosing_symbol"])
def test_against_sql(spark, name):
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    got, want = QUERIES[name](spark, d).toPandas(), con.execute(ORACLES[name]).df()
    rows = lambda x: sorted(tuple(map(str, r)) for r in x[sorted(x.columns)].astype(object).where(x[sorted(x.columns)].notna(), None).values)
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got)


def test_duplicate_free_first_definition(spark):
    """The first of two definitions of a name is the node, wherever tasks put them."""
    files = spark.createDataFrame([(None, "a.py", "def f(a):\n    return 1\n\ndef f(b):\n    return 2\n")], "repo string, path string, content string")
    got = extract.parse(files)
    assert [(r.start_line, r.signature) for r in got.nodes.filter(F.col("kind") == "Function").collect()] == [(1, "def f(a):")]
