"""Queries over a synced workspace, whose source files are written from the driver tables, and over whole operations."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import new_folder, settled
from ..operators import analyze, scan, store, traverse
from ..operators.operations import dispatch
from ..sources import extract, tables
from ..sources.files import source_files
from ..streaming import upkeep
from .queries import _COMPONENTS, _DOWN_TABLES, _TESTED_STARTS, LOOPED, _code, _g, _read, _tested, looped, query, search_sql

_SYNCED: dict[tuple[str, str], extract.Synced] = {}


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """A workspace: code of each customer, a manifest and a test of each supplier, a schema and its readers of each nation, an API description and a deployment of each region."""
    c, n, r = (F.col(x).cast("string") for x in ("s_suppkey", "n_nationkey", "r_regionkey"))
    nation = F.col("s_nationkey").cast("string")
    lines = lambda *parts: F.concat_ws("\n", *(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in part)) for part in parts))
    file = lambda table, path, text: _read(spark, d, table).select(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in path)).alias("path"), text.alias("content"))
    parts = [
        file("supplier", ("lib/s", c, "/requirements.txt"), lines(("# pinned",), ("lib", nation, " >= 1.", c), ("base",))),
        file("supplier", ("tests/s", c, ".test.ts"), lines(("it('works', () => {",), ("  f", c, "(1)"), ("})",))),
        file("nation", ("schema/n", n, ".sql"), lines(("CREATE TABLE t", n, " ("), ("  id int,",), ("  name text,",), ("  primary key (id)",), (");",))),
        file("nation", ("db/n", n, ".ts"), lines(("function q", n, "(a) {"), ("  return db.run('select * from t", n, "')"), ("}",), ("function w", n, "(a) {"), ("  q", n, "(a)"), ("}",))),
        file("region", ("api/openapi-", r, ".yaml"), lines(("paths:",), ("  /r/", r, ":"), ("    get:",), ("    post:",))),
        file("region", ("deploy/r", r, "/docker-compose.yml"), lines(("services:",), ("  web", r, ":"), ("    image: x",))),
    ]
    tree = _code(spark, d)
    for p in parts:
        tree = tree.unionByName(p)
    return tree.select(F.lit(None).cast("string").alias("repo"), "path", "content", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def _synced(spark: SparkSession, d: str) -> extract.Synced:
    """The workspace, synced once in a session for each folder."""
    key = spark.sparkContext.applicationId, d
    if key not in _SYNCED:
        _SYNCED[key] = extract.sync(_tree(spark, d))
    return _SYNCED[key]


_FILES = """files AS (SELECT 'src/c' || c_custkey || '.ts' AS path FROM customer UNION ALL SELECT 'lib/s' || s_suppkey || '/requirements.txt' FROM supplier UNION ALL SELECT 'tests/s' || s_suppkey || '.test.ts' FROM supplier
UNION ALL SELECT 'schema/n' || n_nationkey || '.sql' FROM nation UNION ALL SELECT 'db/n' || n_nationkey || '.ts' FROM nation UNION ALL SELECT 'api/openapi-' || r_regionkey || '.yaml' FROM region UNION ALL SELECT 'deploy/r' || r_regionkey || '/docker-compose.yml' FROM region)"""
_SYNC_EDGES = f"""WITH {_FILES}, c AS (SELECT 'file:src/c' || c_custkey || '.ts' AS file, 'fn:src/c' || c_custkey || '.ts:f' || c_custkey AS fn, c_custkey AS k, c_nationkey AS n, 'event:ev.' || lower(c_mktsegment) AS ev FROM customer),
e AS (SELECT 'CONTAINS' AS type, file AS from_id, fn AS to_id, CAST(NULL AS DOUBLE) AS confidence, 'parser' AS source FROM c UNION ALL SELECT 'CONTAINS', file, 'cls:src/c' || k || '.ts:A' || k, NULL, 'parser' FROM c
UNION ALL SELECT 'IMPORTS', file, 'ext:lib' || n, 0.8, 'parser' FROM c UNION ALL SELECT 'EXPOSES', fn, 'api:POST:/c/' || k, 0.7, 'parser' FROM c UNION ALL SELECT 'CONSUMES', fn, 'api:POST:/c/' || k, 0.6, 'parser' FROM c UNION ALL SELECT 'CONSUMES', fn, 'api:PUT:/n/' || n, 0.6, 'parser' FROM c
UNION ALL SELECT 'PUBLISHES', fn, ev, 0.5, 'parser' FROM c UNION ALL SELECT 'SUBSCRIBES', fn, ev, 0.5, 'parser' FROM c
UNION ALL SELECT 'DEPENDS_ON', 'file:lib/s' || s_suppkey || '/requirements.txt', unnest(['ext:lib' || s_nationkey, 'ext:base']), 0.9, 'lockfile' FROM supplier
UNION ALL SELECT 'TESTS', 'test:tests/s' || s_suppkey || '.test.ts:suite', 'fn:src/c' || s_suppkey || '.ts:f' || s_suppkey, 0.7, 'parser' FROM supplier JOIN customer ON c_custkey = s_suppkey
UNION ALL SELECT 'CONTAINS', 'table:t' || n_nationkey, 'col:t' || n_nationkey || unnest(['.id', '.name']), 0.9, 'parser' FROM nation
UNION ALL SELECT 'CONTAINS', 'file:db/n' || n_nationkey || '.ts', 'fn:db/n' || n_nationkey || '.ts:' || unnest(['q', 'w']) || n_nationkey, NULL, 'parser' FROM nation
UNION ALL SELECT 'READS', 'fn:db/n' || n_nationkey || '.ts:q' || n_nationkey, 'table:t' || n_nationkey, 0.6, 'parser' FROM nation
UNION ALL SELECT 'CALLS', 'fn:db/n' || n_nationkey || '.ts:w' || n_nationkey, 'fn:db/n' || n_nationkey || '.ts:q' || n_nationkey, 0.9, 'parser' FROM nation
UNION ALL SELECT 'CONSTRAINED_BY', 'api:' || unnest(['GET', 'POST']) || ':/r/' || r_regionkey, 'contract:api/openapi-' || r_regionkey || '.yaml', 0.9, 'openapi' FROM region
UNION ALL SELECT 'DOCUMENTS', 'contract:api/openapi-' || r_regionkey || '.yaml', 'api:' || unnest(['GET', 'POST']) || ':/r/' || r_regionkey, 0.9, 'openapi' FROM region
UNION ALL SELECT 'CONTAINS', 'infra:deploy/r' || r_regionkey || '/docker-compose.yml', 'svc:web' || r_regionkey, 0.8, 'infra' FROM region
UNION ALL SELECT 'CONTAINS', 'svc:' || split_part(path, '/', 1), 'file:' || path, 0.6, 'parser' FROM files)"""


@query(_SYNC_EDGES + " SELECT 'e_' || substring(sha1(concat(type, chr(0), from_id, chr(0), to_id)), 1, 16) AS id, type, from_id, to_id, confidence, source AS sources FROM e")
def sync_edges(spark, d):
    return _synced(spark, d).edges.select("id", "type", "from_id", "to_id", "confidence", F.array_join("sources", ",").alias("sources"))


@query(
    _SYNC_EDGES + """, n AS (SELECT from_id AS id FROM e UNION SELECT to_id FROM e UNION SELECT 'file:' || path FROM files)
SELECT id, CASE split_part(id, ':', 1) WHEN 'file' THEN 'File' WHEN 'fn' THEN 'Function' WHEN 'cls' THEN 'Class' WHEN 'ext' THEN 'External' WHEN 'api' THEN 'API' WHEN 'event' THEN 'Event' WHEN 'test' THEN 'Test' WHEN 'table' THEN 'Table' WHEN 'col' THEN 'Column'
WHEN 'contract' THEN 'Contract' WHEN 'infra' THEN 'Infra' WHEN 'svc' THEN 'Service' END AS kind FROM n"""
)
def sync_nodes(spark, d):
    return _synced(spark, d).nodes.select("id", "kind")


@query(_SYNC_EDGES + " SELECT type, from_id, to_id, confidence FROM e WHERE from_id NOT LIKE '%:src/%' AND to_id NOT LIKE '%:src/%' AND type <> 'TESTS'")
def upkeep_edges(spark, d):
    """The workspace without its customers, by a stream of three batches: every second file as it was before and some that go, all files as they are now, and what is gone."""
    tree = settled(_tree(spark, d).filter("path not like 'src/%'"))
    stale = tree.filter("pmod(hash(path), 2) = 0").withColumn("content", F.concat(F.lit("function before() { before_that() }\n"), "content"))
    more = tree.filter("path like 'db/%'").withColumn("path", F.regexp_replace("path", "^db/", "old/"))
    first = tree.filter("pmod(hash(path), 2) = 1").union(stale).union(more).withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    shape = lambda rows, removed, seq: rows.select("repo", "path", "content", "sha256", F.lit(removed).alias("removed"), F.lit(seq).cast("long").alias("seq"))
    source, base, checkpoint = (new_folder(spark) for _ in range(3))
    for events in (shape(first, False, 1), shape(tree, False, 2), shape(more, True, 3)):
        events.write.mode("append").parquet(source)
        upkeep.keep_up(spark, source, base, checkpoint)
    return upkeep.graph(spark, base).edges.select("type", "from_id", "to_id", "confidence")


@query(f"WITH {_FILES} SELECT 'file:' || path AS id, path FROM files")
def file_nodes(spark, d):
    return scan.file_nodes(_synced(spark, d).nodes).select("id", "path")


@query(f"WITH {_FILES} SELECT 'svc:' || split_part(path, '/', 1) AS id, split_part(path, '/', 1) AS name, count(*) AS files FROM files GROUP BY 1, 2")
def service_nodes(spark, d):
    return extract.derived_services(scan.file_nodes(_synced(spark, d).nodes).select("id", "path"))[0].select("id", "name", "files")


@query("WITH c AS (SELECT 'chunk:fn:src/c' || c_custkey || '.ts:f' || c_custkey AS id, 'fn:src/c' || c_custkey || '.ts:f' || c_custkey AS node_id FROM customer UNION ALL SELECT 'chunk:cls:src/c' || c_custkey || '.ts:A' || c_custkey, 'cls:src/c' || c_custkey || '.ts:A' || c_custkey FROM customer UNION ALL SELECT 'chunk:fn:db/n' || n_nationkey || '.ts:' || f || n_nationkey, 'fn:db/n' || n_nationkey || '.ts:' || f || n_nationkey FROM nation, (VALUES ('q'), ('w')) v(f)) SELECT id, node_id FROM c")
def sync_chunks(spark, d):
    return _synced(spark, d).chunks.select("id", "node_id")


@query("SELECT event_id AS seq, event_type AS event, props AS payload FROM events WHERE event_type = 'error' OR (SELECT count(*) FROM events WHERE event_type = 'error') = 0 AND event_type = 'purchase' ORDER BY event_id DESC LIMIT 100")
def journal_scan(spark, d):
    """The newest entries of one kind of event; of errors if there are any, else of purchases."""
    e = _read(spark, d, "events").select(F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("event"), F.col("props").alias("payload"))
    kind = "purchase" if e.filter("event = 'error'").isEmpty() else "error"
    return scan.list_journal(e, kind).select("seq", "event", "payload")


@query("WITH l AS (SELECT c_nationkey, max(c_custkey) AS k FROM customer GROUP BY c_nationkey) SELECT n_name AS key, coalesce('c' || k, 'none') AS value FROM nation LEFT JOIN l ON c_nationkey = n_nationkey")
def health_set(spark, d):
    """A row of health for each nation, overwritten by that of each of its customers in turn."""
    health = _read(spark, d, "nation").select(F.col("n_name").alias("key"), F.lit("none").alias("value"), F.lit(0).cast("long").alias("updated_at"))
    rows = _read(spark, d, "customer").join(_read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("key"), F.concat(F.lit("c"), "c_custkey").alias("value"), F.col("c_custkey").alias("updated_at"))
    return store.set_health(health, rows).select("key", "value")


@query("SELECT CAST(count(CASE WHEN critical OR kind = 'Service' THEN 1 END) AS BIGINT) AS critical, count(*) AS nodes FROM nodes")
def mark_critical(spark, d):
    nodes = _g(spark, d).nodes
    return store.mark_critical(nodes, nodes.filter("kind = 'Service'").select("id")).agg(F.count_if("critical").alias("critical"), F.count("*").alias("nodes"))


_GROUPS = "SELECT DISTINCT to_id AS id, split_part(to_id, ':', 2) AS grp FROM edges WHERE type = 'TESTS'"


@query(search_sql("downstream", _GROUPS, 5, 7, group="grp") + " SELECT start, path_no, CAST(depth AS BIGINT) AS depth, node, array_to_string(path, '>') AS path FROM found")
def impact_multi(spark, d):
    """The tested functions of each file as the starts of one search."""
    g = _g(spark, d)
    starts = _tested(g).withColumn("group", F.get(F.split("id", ":"), F.lit(1)))
    found = traverse.impact(g, starts)
    return found.select("start", F.col("path_no").cast("long").alias("path_no"), F.col("depth").cast("long").alias("depth"), "node", F.array_join("path", ">").alias("path"))


@query(
    search_sql("downstream", _TESTED_STARTS, 5, 7) + """, n AS (SELECT id AS start, count(DISTINCT node) AS n FROM starts LEFT JOIN found ON start = id GROUP BY id)
SELECT start, step, true AS ok, CASE step WHEN 'plan' THEN n || ' impacted' WHEN 'verify_graph' THEN '0 checks failed' ELSE (n + 1) || ' vs ' || (n + 1) END AS detail, true AS accepted FROM n, (VALUES ('plan'), ('verify_graph'), ('verify_impact_stable')) v(step)"""
)
def orchestrate(spark, d):
    g = _g(spark, d)
    return analyze.orchestrate(g, _tested(g))


@query("WITH e AS (SELECT 'fn:repo:n' || c_nationkey || '/c' || c_custkey AS from_id, 'api:/m/' || c_mktsegment || '/' || (c_custkey // 100) AS to_id, c_custkey AS k, c_custkey % 50 = 0 AS maker FROM customer) SELECT u.from_id, m.from_id AS to_id, 'c' || u.k || ' consumes ' || m.to_id || ', c' || m.k || ' exposes ' || m.to_id AS evidence, 0.7 AS confidence FROM e m JOIN e u ON m.to_id = u.to_id AND m.maker AND NOT u.maker AND split_part(m.from_id, '/', 1) <> split_part(u.from_id, '/', 1)")
def cross_repo_edges(spark, d):
    """cross_repo's dependencies with what each side's file says."""
    k = F.col("c_custkey").cast("string")
    from_id = F.concat(F.lit("fn:repo:n"), "c_nationkey", F.lit("/c"), k)
    api = F.concat(F.lit("api:/m/"), "c_mktsegment", F.lit("/"), F.floor(F.col("c_custkey") / 100))
    told = F.array(F.struct(F.concat(F.lit("c"), k).alias("file"), F.lit(1).alias("line"), F.lit("x").alias("snippet")))
    edges = _read(spark, d, "customer").select(F.when(F.col("c_custkey") % 50 == 0, "EXPOSES").otherwise("CONSUMES").alias("type"), from_id.alias("from_id"), api.alias("to_id"), told.alias("evidence"))
    merged = store.merge_edges(extract.cross_repo_evidence(edges))
    return merged.select("from_id", "to_id", F.array_join(F.transform("evidence", lambda e: F.concat(e["file"], F.lit(" "), e["snippet"])), ", ").alias("evidence"), "confidence")


_MAP = f"""{tables.WITH}, m AS (SELECT e.id, e.type, from_id, to_id FROM edges e JOIN nodes a ON a.id = from_id JOIN nodes b ON b.id = to_id WHERE type IN ('READS', 'WRITES', 'CONTAINS') AND a.kind IN ('Table', 'Column', 'Service', 'Function', 'Method') AND b.kind IN ('Table', 'Column', 'Service', 'Function', 'Method')),
f AS (SELECT * FROM m ORDER BY id LIMIT 300), l AS (SELECT id, kind, name FROM nodes WHERE kind = 'Table' OR id IN (SELECT from_id FROM f UNION SELECT to_id FROM f)), k AS (SELECT * FROM l ORDER BY kind COLLATE en, id COLLATE en, kind, id LIMIT 150), e AS (SELECT * FROM f WHERE from_id IN (SELECT id FROM k) AND to_id IN (SELECT id FROM k))"""


@query(_MAP + " SELECT id, kind, name FROM k")
def map_nodes(spark, d):
    return analyze.capped_map(_g(spark, d), "db")[0].select("id", "kind", "name")


@query(
    _MAP + """ SELECT 'nodes' AS name, count(*) AS n FROM k UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'total_matching_nodes', count(*) FROM l UNION ALL SELECT 'total_matching_edges', count(*) FROM m UNION ALL SELECT 'node_' || kind, count(*) FROM k GROUP BY kind
UNION ALL SELECT 'edge_' || type, count(*) FROM e GROUP BY type UNION ALL SELECT 'truncated', CAST((SELECT count(*) FROM l) > 150 OR (SELECT count(*) FROM m) > 300 AS BIGINT) UNION ALL SELECT 'empty_view', CAST((SELECT count(*) FROM l) = 0 AS BIGINT)"""
)
def map_counts(spark, d):
    return analyze.capped_map(_g(spark, d), "db")[2]


_WIDE = "SELECT id FROM (SELECT nodes.id, kind, count(*) AS degree FROM nodes JOIN (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges) x ON x.id = nodes.id GROUP BY nodes.id, kind ORDER BY degree DESC, kind, nodes.id LIMIT 40)"


@query(
    search_sql("downstream", _WIDE, 5, 7).replace(tables.WITH, LOOPED) + f""", {_COMPONENTS}, deg AS (SELECT x.id, kind, sum(i) AS in_degree, sum(1 - i) AS out_degree, count(*) AS degree FROM (SELECT from_id AS id, 0 AS i FROM edges UNION ALL SELECT to_id, 1 FROM edges) x JOIN nodes ON nodes.id = x.id GROUP BY x.id, kind),
churn AS (SELECT nodes.id, kind, commits FROM nodes JOIN (SELECT 'users/' || user_id || '.ts' AS path, count(*) AS commits FROM events GROUP BY user_id) USING (path)), reached AS (SELECT start AS id, count(DISTINCT node) AS n FROM found WHERE node <> start GROUP BY start),
s AS (SELECT 'hubs' AS section, row_number() OVER (ORDER BY degree DESC, kind, id) AS rank, id, degree AS metric, 10 AS most FROM deg
UNION ALL SELECT 'bottlenecks', row_number() OVER (ORDER BY least(in_degree, out_degree) DESC, kind, id), id, least(in_degree, out_degree), 10 FROM deg WHERE least(in_degree, out_degree) >= 2
UNION ALL SELECT 'coupling', row_number() OVER (ORDER BY degree DESC, kind, id), id, degree, 10 FROM deg WHERE degree >= 6
UNION ALL SELECT 'isolated', row_number() OVER (ORDER BY kind, id), id, 0, 20 FROM nodes WHERE kind <> 'Repo' AND id NOT IN (SELECT id FROM deg)
UNION ALL SELECT 'hotspots', row_number() OVER (ORDER BY commits DESC, kind, id), id, commits, 10 FROM churn
UNION ALL SELECT 'cycles', row_number() OVER (ORDER BY first), path, length, 20 FROM cyc
UNION ALL SELECT 'large_downstream_impact', row_number() OVER (ORDER BY n DESC, degree DESC, kind, deg.id), deg.id, n, 10 FROM reached JOIN deg ON deg.id = reached.id)
SELECT section, CAST(rank AS INTEGER) AS rank, id, CAST(metric AS BIGINT) AS metric FROM s WHERE rank <= most"""
)
def insights(spark, d):
    """The report on the tables' graph with calls that come back."""
    churn = _read(spark, d, "events").groupBy(F.concat(F.lit("users/"), "user_id", F.lit(".ts")).alias("path")).agg(F.count("*").alias("commits"))
    return analyze.insights(looped(spark, d), churn)


@query(_DOWN_TABLES + " SELECT id, kind, name FROM nodes WHERE id = 'table:part_7' UNION SELECT id, kind, name FROM nodes WHERE id IN (SELECT node FROM found WHERE start = 'table:part_7')")
def operation_impact(spark, d):
    """The nodes of one operation's envelope."""
    return dispatch(_g(spark, d), "impact", id="table:part_7").nodes.select("id", "kind", "name")


_SCANNED = """files AS (SELECT 'lib/s' || s_suppkey || '/_private.py' AS path, 's' || s_suppkey || ' = ' || s_nationkey || chr(10) AS content FROM supplier UNION ALL SELECT 'conf/n' || n_nationkey || '/.env', 'KEY=' || n_name FROM nation
UNION ALL SELECT 'src/c' || c_nationkey || '/c' || c_custkey || '.ts', '// ' || c_name FROM customer)"""


@query(f"WITH {_SCANNED} SELECT path, CAST(octet_length(encode(content)) AS BIGINT) AS size, sha256(content) AS sha256 FROM files")
def file_scan(spark, d):
    """Files written from the tables, hidden and ignored ones among them, found and read by tasks."""
    text = lambda c: F.col(c).cast("string")
    of = lambda table, path, content: _read(spark, d, table).select(F.concat(*path).alias("path"), F.concat(*content).alias("content"))
    tree = of("supplier", (F.lit("lib/s"), text("s_suppkey"), F.lit("/_private.py")), (F.lit("s"), text("s_suppkey"), F.lit(" = "), text("s_nationkey"), F.lit("\n"))).union(of("nation", (F.lit("conf/n"), text("n_nationkey"), F.lit("/.env")), (F.lit("KEY="), "n_name")))
    tree = tree.union(of("customer", (F.lit("src/c"), text("c_nationkey"), F.lit("/c"), text("c_custkey"), F.lit(".ts")), (F.lit("// "), "c_name"))).union(of("region", (F.lit("node_modules/r"), text("r_regionkey"), F.lit(".ts")), (F.lit("ignored"),)))
    root = re.sub("^file:/*", "/", new_folder(spark))

    def write(rows):
        made = ""
        for r in rows:
            full = os.path.join(root, r.path)
            if os.path.dirname(full) != made:
                made = os.path.dirname(full)
                os.makedirs(made, exist_ok=True)
            with open(full, "w", encoding="utf-8") as f:
                f.write(r.content)

    folder = F.regexp_replace("path", "/[^/]*$", "")  # a folder's files in turn, many folders and files to many tasks
    tree.repartition(64, "path").sortWithinPartitions(folder).foreachPartition(write)
    return source_files(spark, root).select("path", "size", "sha256")


@query(" SELECT kind, count(*) AS n FROM (SELECT kind, id FROM nodes ORDER BY kind, id LIMIT 200) GROUP BY kind")
def operation_graph(spark, d):
    return dispatch(_g(spark, d), "graph", node_limit="200").nodes.groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 'e_' || substring(sha1(concat('CALLS', chr(0), a, chr(0), b)), 1, 16) AS id, 'CALLS' AS type, a AS from_id, b AS to_id, 'user' AS sources FROM (SELECT min(id) AS a, max(id) AS b FROM nodes WHERE kind = 'Function')")
def operation_pin(spark, d):
    """A pin between the first and the last function."""
    g = _g(spark, d)
    ends = g.nodes.filter("kind = 'Function'").agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    return dispatch(g, "pin", type="CALLS", **{"from": ends.a, "to": ends.b}).edges.select("id", "type", "from_id", "to_id", F.array_join("sources", ",").alias("sources"))
