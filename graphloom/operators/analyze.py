"""Analyses over traversals: risk, tests, policies, insights, maps, search and the rest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ids import edge_id, prefix_repo, repo_of, safe_id, service_of, tokens, without_repo
from ..functions.lineage import settled
from ..schema import CYCLE_TYPES, EDGE_TYPES, MAPS, PINS, TESTABLE_KINDS, Graph, GraphError
from .components import dependency_cycles, inside_components, strong_components
from .scan import degrees_of, find_nodes, made_degrees, nodes_by_kinds, stored_degrees
from .store import validate
from .traverse import component, impact, neighbors


def _listed(*flags: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in flags)))


def impact_summary(graph: Graph, starts: DataFrame, direction: str = "downstream", found: DataFrame | None = None) -> DataFrame:
    """One row per start: n_paths, impacted, critical, and the risk chips in their fixed order.

    Chips are about what a start reaches; only `critical` looks at the start too.
    found is what impact gave for them, where that is at hand.
    """
    found = (impact(graph, starts, direction, edge_paths=False) if found is None else found).select("start", "path_no", "node", "type", "conflict", "path")
    start_nodes = graph.nodes.join(starts.select("id").distinct(), "id").select(F.col("id").alias("start"), F.col("kind").alias("start_kind"), F.col("critical").alias("start_critical"))
    degree = degrees_of(graph, found.select(F.col("node").alias("id"))).select(F.col("id").alias("node"), F.col("incident").alias("degree"))
    reached = found.join(graph.nodes.select(F.col("id").alias("node"), "kind", "critical"), "node", "left").join(degree, "node", "left")
    per = reached.groupBy("start").agg(
        F.count("*").alias("n_paths"), F.count_distinct("node").alias("impacted"), F.bool_or("critical").alias("any_critical"), F.bool_or(F.col("type") == "WRITES").alias("writes"),
        F.bool_or(F.col("kind") == "External").alias("external"), F.bool_or(F.col("conflict")).alias("conflict"), F.bool_or(F.col("kind") == "Test").alias("tested"), F.bool_or(F.col("kind").isin(*TESTABLE_KINDS)).alias("testable"),
        F.count_distinct(F.when(F.col("kind") == "Test", F.col("node"))).alias("tests"), F.count_distinct(F.when(F.col("kind") == "External", F.col("node"))).alias("externals"),
        F.bool_or(F.col("degree") >= 10).alias("high_degree"), F.bool_or(F.col("kind") == "API").alias("api"), F.bool_or(F.col("kind") == "Contract").alias("contract"), F.max(F.when(F.col("path_no") == 1, F.array_join("path", " → "))).alias("first_path"),
    )
    full = start_nodes.join(per, "start", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    chips = _listed(
        (zero("impacted") > 0, "downstream"), (no("any_critical") | F.col("start_critical"), "critical"), (no("writes"), "db_write"), (no("external"), "external"),
        (no("conflict"), "conflict"), (no("high_degree"), "high_degree"), (~no("tested") & no("testable"), "untested"),
    )
    return full.select("start", "start_kind", zero("n_paths").alias("n_paths"), zero("impacted").alias("impacted"), zero("tests").alias("tests"), (no("any_critical") | F.col("start_critical")).alias("critical"), no("writes").alias("writes"), zero("externals").alias("externals"), no("tested").alias("tested"), F.col("start_critical"), no("api").alias("api"), no("contract").alias("contract"), F.coalesce("first_path", "start").alias("first_path"), chips.alias("chips"))


def risk_profile(graph: Graph, starts: DataFrame, churn: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """The risk of changing each start: counts, centrality, score, level and signals. churn: (path, commits). found is what impact gave, where that is at hand.

    Counts of interactions with data look at the edges of the start and of all it reaches, each edge once.
    """
    found = settled(impact(graph, starts, edge_paths=False).select("start", "path_no", "node", "type", "conflict", "path")) if found is None else found
    summary = impact_summary(graph, starts, found=found)
    ids = starts.select(F.col("id").alias("start")).distinct()
    deg = degrees_of(graph, starts)
    # counted when it is asked for, where degrees are not stored
    most = (stored_degrees(graph) if "degrees" in graph.kept else made_degrees(graph)).agg(F.max(F.greatest("in_degree", "out_degree")).alias("most"))
    around = found.select("start", "node").union(ids.select("start", "start")).distinct()
    data = graph.edges_of(("READS", "WRITES"), once=True).select("id", F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("node"))
    data = data.join(around, "node").groupBy("start").agg(F.count_distinct("id").alias("db_interactions"))
    direct = graph.edges_of(("TESTS",)).select(F.col("to_id").alias("start"), F.lit(True).alias("direct")).join(ids, "start", "left_semi").distinct()
    own = deg.select(F.col("id").alias("start"), F.col("incident").alias("dependency_count")).join(ids, "start", "left_semi")
    paths = graph.nodes.select(F.col("id").alias("start"), "path")
    full = summary.join(own, "start", "left").crossJoin(F.broadcast(most)).join(data, "start", "left").join(direct, "start", "left").join(paths, "start")
    full = full.join(churn.select("path", "commits"), "path", "left") if churn is not None else full.withColumn("commits", F.lit(None).cast("long"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    full = full.withColumn("dependency_count", zero("dependency_count")).withColumn("db_interactions", zero("db_interactions")).withColumn("covered", F.col("tested") | F.coalesce("direct", F.lit(False)))
    full = full.withColumn("centrality", F.round(F.col("dependency_count") / F.greatest(F.col("most"), F.lit(1)), 3))
    signals = (
        (F.col("impacted") >= 10, "large_downstream", 25), ((F.col("impacted") >= 3) & (F.col("impacted") < 10), "moderate_downstream", 12), (F.col("centrality") >= 0.6, "hub", 20), ((F.col("centrality") >= 0.3) & (F.col("centrality") < 0.6), None, 10),
        (~F.col("covered"), "untested", 20), (F.col("db_interactions") > 0, "db_interaction", 12), (F.col("externals") > 0, "external_dependency", 10), (F.col("critical"), "critical_path", 20), (F.coalesce(F.col("commits"), F.lit(0)) >= 10, "high_churn", 8),
    )
    score = F.lit(0)
    for holds, _, weight in signals:
        score = score + F.when(holds, weight).otherwise(0)
    return full.withColumn("score", F.least(F.lit(100), score).cast("long")).select(
        "start", "dependency_count", F.col("impacted").alias("downstream_consumers"), "centrality", "commits", "db_interactions", F.col("externals").alias("external_deps"), F.col("covered").alias("test_coverage"), F.col("critical").alias("critical_path"), "score",
        F.when(F.col("score") >= 55, "high").when(F.col("score") >= 25, "medium").otherwise("low").alias("level"), F.array_join(_listed(*((holds, name) for holds, name, _ in signals if name)), ",").alias("signals"),
    )


#: The commands that run tests, by the kind of their files.
COMMANDS = {r"\.py$": "python3 -m unittest discover -s tests -v", r"\.(ts|tsx|js|jsx)$": "npm test"}


def tests_to_run(graph: Graph, starts: DataFrame) -> DataFrame:
    """(start, test, command): the tests that each start's impact reaches; a file of another kind has no command."""
    found = impact(graph, starts, edge_paths=False).select("start", "node").distinct()
    tests = graph.nodes.filter("kind = 'Test'").select(F.col("id").alias("node"), "path")
    command = F.coalesce(*(F.when(F.col("path").rlike(p), c) for p, c in COMMANDS.items()))
    return found.join(tests, "node").select("start", F.col("node").alias("test"), command.alias("command"))


def diff_impact(graph: Graph, changes: DataFrame) -> DataFrame:
    """Nodes that changed symbols (id, change) reach together, changed ones left out: (node, kind, api_shape)."""
    known = changes.join(graph.nodes.select("id"), "id", "left_semi")
    shape = known.agg(F.coalesce(F.bool_or(F.col("change").isin("signature", "removed")), F.lit(False)).alias("api_shape"))
    found = impact(graph, known, edge_paths=False).select("node").distinct().join(known.select(F.col("id").alias("node")), "node", "left_anti")
    return found.join(graph.nodes.select(F.col("id").alias("node"), "kind"), "node").crossJoin(F.broadcast(shape))


def policies(graph: Graph, starts: DataFrame, blocking: tuple[str, ...] = ()) -> DataFrame:
    """(start, policy, severity): the three built-in rules over each start and what it reaches.

    A route is open where an API is reached and no contract is.
    """
    names = _listed((F.col("start_critical") & ~F.col("tested"), "critical_without_tests"), (F.col("api") & ~F.col("contract"), "public_route_without_contract"), (F.col("writes"), "db_write_on_path"))
    blocked = F.lit("*" in blocking) | (F.col("policy").isin(*blocking) if blocking else F.lit(False))
    return impact_summary(graph, starts).select("start", F.explode(names).alias("policy")).withColumn("severity", F.when(blocked, "block").otherwise("warn"))


def plan_change(graph: Graph, starts: DataFrame) -> DataFrame:
    """(start, file): the files that a change may touch: the start's own and those of the code it reaches."""
    nodes = graph.nodes.select(F.col("id").alias("node"), "kind", "path")
    reached = impact(graph, starts, edge_paths=False).select("start", "node").distinct().join(nodes, "node").filter(F.col("kind").isin("Function", "Method", "Class", "Module", "File"))
    own = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).join(nodes, "node")
    return reached.select("start", "path").union(own.select("start", "path")).filter("path is not null").distinct().withColumnRenamed("path", "file")


def orchestrate(graph: Graph, starts: DataFrame) -> DataFrame:
    """The bounded workflow for each start: a plan, a check of the graph, the impact once more: (start, step, ok, detail, accepted).

    The graph is checked once for all starts.
    """
    reached = lambda name: starts.select(F.col("id").alias("start")).distinct().join(impact(graph, starts, edge_paths=False).groupBy("start").agg(F.count_distinct("node").alias("n")), "start", "left").select("start", F.coalesce("n", F.lit(0)).alias(name))
    rows = graph.edges_of(EDGE_TYPES, once=True).withColumn("sources_ok", F.col("sources").isNotNull())
    failed = validate(graph.nodes, rows).filter("name <> 'conflicts'").agg(F.count_if(~F.col("ok")).alias("failed"))
    both = settled(reached("planned").join(reached("again"), "start").crossJoin(F.broadcast(failed)))
    whole, same = F.col("failed") == 0, F.col("planned") == F.col("again")
    said = lambda *parts: F.concat(*(p.cast("string") for p in parts))
    step = lambda name, ok, detail: F.struct(F.lit(name).alias("step"), ok.alias("ok"), detail.alias("detail"))
    steps = F.array(
        step("plan", F.lit(True), said(F.col("planned"), F.lit(" impacted"))), step("verify_graph", whole, said(F.col("failed"), F.lit(" checks failed"))),
        step("verify_impact_stable", same, said(F.col("again") + 1, F.lit(" vs "), F.col("planned") + 1)),
    )
    return both.select("start", F.explode(steps).alias("s"), (whole & same).alias("accepted")).select("start", "s.*", "accepted")


#: Tasks by the tier that does them, the tiers' relative costs and the reasons for them.
TASKS = {
    "deterministic": ("parsing", "graph_query", "impact", "diff", "search", "why_path", "tests_to_run", "validate"),
    "strong": ("architecture", "dynamic_coupling", "plan_change", "incident"),
    "cheap": ("summary", "classification", "narration", "routing"),
}
COSTS = {"deterministic": 0, "cheap": 1, "strong": 10, "verifier": 12}
REASONS = {
    "verifier": "security-sensitive work requires an independent verifier",
    "deterministic": "deterministic tooling satisfies this with no model call",
    "strong": "high difficulty/ambiguity warrants a stronger model",
    "cheap": "a cheap model is sufficient",
    "default": "default to deterministic; escalate only when needed",
}


def route(tasks: DataFrame) -> DataFrame:
    """tasks (task, security_sensitive, ambiguity) with the tier that should do each, its cost, the reason, uses_model and provider_locked."""
    task, unsure = F.lower(F.trim("task")), F.coalesce(F.col("ambiguity"), F.lit(0.0))
    choice = (
        F.when(F.coalesce("security_sensitive", F.lit(False)), "verifier").when(task.isin(*TASKS["deterministic"]), "deterministic").when(task.isin(*TASKS["strong"]) | (unsure >= 0.6), "strong")
        .when(task.isin(*TASKS["cheap"]) | (unsure > 0), "cheap").otherwise("default")
    )
    of = lambda c, table: F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in table.items()))
    told = tasks.withColumn("_choice", choice).withColumn("tier", F.when(choice == "default", "deterministic").otherwise(choice))
    return told.withColumn("cost", of(F.col("tier"), COSTS).cast("long")).withColumn("reason", of(F.col("_choice"), REASONS)).withColumn("uses_model", F.col("tier") != "deterministic").withColumn("provider_locked", F.lit(False)).drop("_choice")


def hubs(graph: Graph, top: int = 10) -> DataFrame:
    return _top(graph, stored_degrees(graph).withColumn("metric", F.col("degree")), top)


def bottlenecks(graph: Graph, top: int = 10) -> DataFrame:
    return _top(graph, stored_degrees(graph).withColumn("metric", F.least("in_degree", "out_degree")).filter("metric >= 2"), top)


def coupling(graph: Graph, top: int = 10) -> DataFrame:
    return _top(graph, stored_degrees(graph).withColumn("metric", F.col("degree")).filter("metric >= 6"), top)


def _top(graph: Graph, measured: DataFrame, top: int) -> DataFrame:
    """The report's first rows: the largest metrics, ties by kind and id."""
    return graph.nodes.select("id", "kind").join(measured.select("id", "metric"), "id").orderBy(F.desc("metric"), "kind", "id").limit(max(1, min(50, top)))


def isolated(graph: Graph) -> DataFrame:
    return graph.nodes.filter("kind <> 'Repo'").join(stored_degrees(graph), "id", "left_anti").select("id", "kind")


def hotspots(graph: Graph, churn: DataFrame, top: int = 10) -> DataFrame:
    """Nodes on the paths that change most: churn (path, commits)."""
    return graph.nodes.join(churn, "path").select("id", "kind", F.col("commits").alias("metric")).orderBy(F.desc("metric"), "kind", "id").limit(max(1, min(50, top)))


def cycles(edges: DataFrame, types: tuple[str, ...], length: int | None = None) -> DataFrame:
    """Simple cycles, each once, from its smallest id: (cycle, length); of any length unless one is given.

    Only steps inside a strongly connected component are followed: no cycle
    takes others. Each length's trails are written, and the search ends when
    none is left. Their number can grow with the power of a component's size;
    dependency_cycles reports cycles without that.
    """
    steps = settled(edges.filter(F.col("type").isin(*types)).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct())
    steps = settled(inside_components(steps, strong_components(steps)).select("src", "dst"))
    trail = steps.filter("dst >= src").select(F.col("src").alias("first"), F.col("dst").alias("node"), F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst")).alias("path"))
    out = trail.filter("first = node").select(F.array_join("path", ">").alias("cycle"), F.lit(1).cast("long").alias("length"))
    trail, done = trail.filter("first <> node"), 1
    while length is None or done < length:
        near = settled(trail.join(steps, F.col("node") == F.col("src")).filter("dst >= first").select("first", "path", "dst"))
        out = out.union(near.filter("dst = first").select(F.array_join("path", ">"), F.size("path").cast("long")))
        trail = near.filter(~F.array_contains("path", F.col("dst"))).select("first", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        done += 1
        if trail.isEmpty():
            break
    return out.distinct()


def _between(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """The edges whose ends are both among the nodes shown (id, kind), with their kinds."""
    for end in ("from", "to"):
        edges = edges.join(shown.select(F.col("id").alias(f"{end}_id"), F.col("kind").alias(f"{end}_kind")), f"{end}_id")
    return edges


def _first_edges(graph: Graph, view: str, matching: DataFrame, cap: int) -> DataFrame:
    """The first by id of all the edges that a view matches.

    They are looked for among the first edges of its types; only where too few
    of those have both ends in the view, all edges are joined with their ends.
    """
    kinds, types, _ = MAPS[view]
    early = settled(graph.edges_of(types, once=True).select("id", "type", "from_id", "to_id").orderBy("id").limit(EARLY * cap))
    ends = early.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    shown = settled(nodes_by_kinds(graph.nodes, kinds).select("id", "kind").join(F.broadcast(ends), "id", "left_semi"))
    first = settled(_between(early, shown).orderBy("id").limit(cap))
    return first if first.count() == cap or early.count() < EARLY * cap else settled(matching.orderBy("id").limit(cap))


def project_map(graph: Graph, view: str, focus: str | None = None) -> DataFrame:
    """The edges of a view whose ends are both in it: (id, type, from_id, to_id, from_kind, to_kind)."""
    if view not in MAPS:
        raise ValueError(f"no such map: {view}")
    kinds, types, _ = MAPS[view]
    edges = _between(graph.edges_of(types, once=True).select("id", "type", "from_id", "to_id"), nodes_by_kinds(graph.nodes, kinds).select("id", "kind"))
    if focus is not None:
        edges = edges.join(component(edges, focus).select(F.col("node").alias("from_id")), "from_id", "left_semi")
    return edges


def map_anchors(graph: Graph, view: str) -> DataFrame:
    """Nodes that a view shows although none of its edges touches them: (id, kind)."""
    kind = MAPS[view][2]
    ends = project_map(graph, view).select(F.explode(F.array("from_id", "to_id")).alias("id"))
    return graph.nodes.filter(F.col("kind") == kind if kind else F.lit(False)).select("id", "kind").join(ends, "id", "left_anti")


#: Of a view's edges by id, so many times as a chart shows are looked at before all are.
EARLY = 4


def capped_map(graph: Graph, view: str, focus: str | None = None, node_cap: int = 150, edge_cap: int = 300) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A view as a chart shows it: its first nodes by kind and id in the order of Unicode's default collation, its first edges by id between them, and counts (name, n).

    Nodes are the ends of the edges kept and the kind that the view shows
    without edges. Caps are what makes it a chart; the counts name what matches
    in all. truncated and empty_view are 1 where they hold.
    """
    node_cap, edge_cap = max(1, node_cap), max(1, edge_cap)
    # without a focus only counts read all matching edges, so they are not stored
    matching = project_map(graph, view) if focus is None else settled(project_map(graph, view, focus))
    first = _first_edges(graph, view, matching, edge_cap) if focus is None else settled(matching.orderBy("id").limit(edge_cap))
    ends = first.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct().withColumn("end", F.lit(True))
    kind = MAPS[view][2]
    alone = F.col("kind") == kind if kind else F.lit(False)
    listed = settled(graph.nodes.select("id", "kind", "name", "path").join(F.broadcast(ends), "id", "left").filter(F.col("end").isNotNull() | alone).drop("end"))
    nodes = settled(listed.orderBy(F.expr("kind COLLATE UNICODE"), F.expr("id COLLATE UNICODE"), "kind", "id").limit(node_cap))
    keep = nodes.select("id")
    edges = settled(first.join(keep.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(keep.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select("id", "type", "from_id", "to_id"))
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    by = lambda df, column, prefix: df.groupBy(column).count().select(F.concat(F.lit(prefix), column).alias("name"), F.col("count").alias("n"))
    told = "'total_matching_nodes', n, 'total_matching_edges', m, 'truncated', cast(n > {0} or m > {1} as long), 'empty_view', cast(n = 0 as long)".format(node_cap, edge_cap)
    chips = n(listed, "l").crossJoin(n(matching, "m").select(F.col("n").alias("m"))).select(F.expr(f"stack(4, {told}) as (name, n)"))
    sizes = n(nodes, "nodes").union(n(edges, "edges"))
    return nodes, edges, sizes.union(by(nodes, "kind", "node_")).union(by(edges, "type", "edge_")).union(chips)


def insights(graph: Graph, churn: DataFrame | None = None, top: int = 10) -> DataFrame:
    """The report: (section, rank, id, metric) of hubs, bottlenecks, coupling, isolated nodes, cycles, hotspots and large downstream impact.

    Sections are the first `top` by metric (twice as many isolated nodes, 20
    cycles), ties by kind and id. Without churn, hotspots are the hubs. Impact
    is measured of the 40 nodes of the highest degree. Cycles are those of
    dependency_cycles, of any length, in its order.
    """
    top = max(1, min(50, top))
    kinds = graph.nodes.select("id", "kind")
    ranked = settled(stored_degrees(graph).join(kinds, "id"))
    order = lambda *cs: F.row_number().over(Window.orderBy(*cs))

    def section(name: str, rows: DataFrame, many: int, *by: Column | str) -> DataFrame:
        few = rows.orderBy(*by).limit(many)
        return few.select(F.lit(name).alias("section"), order(*by).alias("rank"), "id", F.col("metric").cast("long").alias("metric"))

    least = F.least("in_degree", "out_degree")
    by = (F.desc("metric"), "kind", "id")
    hub = section("hubs", ranked.withColumn("metric", F.col("degree")), top, *by)
    spots = graph.nodes.join(churn, "path").select("id", "kind", F.col("commits").alias("metric")) if churn is not None else ranked.withColumn("metric", F.col("degree"))
    wide = settled(ranked.orderBy(F.desc("degree"), "kind", "id").limit(40))
    reached = impact(graph, wide.select("id"), edge_paths=False).filter("node <> start").groupBy(F.col("start").alias("id")).agg(F.count_distinct("node").alias("metric"))
    parts = [
        hub, section("bottlenecks", ranked.withColumn("metric", least).filter("metric >= 2"), top, *by), section("coupling", ranked.withColumn("metric", F.col("degree")).filter("metric >= 6"), top, *by),
        section("isolated", isolated(graph).withColumn("metric", F.lit(0)), 2 * top, "kind", "id"), section("cycles", dependency_cycles(graph, CYCLE_TYPES, 20).select(F.col("path").alias("id"), F.col("length").alias("metric"), "kind", "first", "no"), 20, "kind", "first", "no"),
        section("hotspots", spots, top, *by), section("large_downstream_impact", wide.join(reached, "id"), top, F.desc("metric"), F.desc("degree"), "kind", "id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mermaid(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lines of a flowchart, one for each node and edge: (line)."""
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    boxes = nodes.join(ends, "id", "left_semi").select(F.concat(safe_id("id"), F.lit('["'), "kind", F.lit(": "), F.regexp_replace("name", '"', "'"), F.lit('"]')).alias("line"))
    return boxes.union(edges.select(F.concat(safe_id("from_id"), F.lit(" -->|"), "type", F.lit("| "), safe_id("to_id"))))


def search(graph: Graph, query: str, kind: str | None = None) -> DataFrame:
    """What search_index.search finds, by a scan of all texts: for a graph that is searched once."""
    chunks = graph.chunks if kind is None else graph.chunks.filter(F.col("kind") == kind)
    met = chunks.select("node_id", "text").join(graph.nodes.select(F.col("id").alias("node_id"), "name"), "node_id")
    hay = F.lower(F.concat_ws(" ", "node_id", "name", "text"))
    wanted = tokens(F.lit(query))
    overlap = F.size(F.array_intersect(wanted, tokens(hay))) / F.greatest(F.size(wanted), F.lit(1))
    phrase = F.when(F.contains(hay, F.lit(query.lower())), 0.75).otherwise(0.0)
    exact = F.when((F.lower("node_id") == query.lower()) | (F.lower("name") == query.lower()), 1.0).otherwise(0.0)
    return met.select("node_id", overlap.alias("overlap"), phrase.alias("phrase"), exact.alias("exact")).filter("overlap + phrase > 0").groupBy("node_id").agg(F.round(F.max(F.col("overlap") + F.col("phrase") + F.col("exact")), 6).alias("score"))


def mermaid_text(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The flowchart as one text (mermaid): its boxes by kind and id, then its arrows by id. Of a map's bounded nodes and edges."""
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    quoted = lambda c: F.regexp_replace(c, '"', "'")
    boxes = nodes.join(ends, "id", "left_semi").select(F.lit(1).alias("part"), F.struct("kind", "id").alias("at"), F.concat(F.lit("  "), safe_id("id"), F.lit('["'), quoted(F.concat("kind", F.lit(": "), "name")), F.lit('"]')).alias("line"))
    arrows = edges.select(F.lit(2).alias("part"), F.struct(F.lit("").alias("kind"), "id").alias("at"), F.concat(F.lit("  "), safe_id("from_id"), F.lit(" -->|"), "type", F.lit("| "), safe_id("to_id")).alias("line"))
    listed = boxes.union(arrows).agg(F.array_sort(F.collect_list(F.struct("part", "at", "line"))).alias("all"))
    return listed.select(F.array_join(F.concat(F.array(F.lit("flowchart LR")), F.transform("all", lambda x: x["line"])), "\n").alias("mermaid"))


def symbol(graph: Graph, identifier: str) -> DataFrame:
    """The edges at the node of that id, or else at the first that find_nodes gives, with their other nodes: (id, edge_id, type, other, other_kind)."""
    own = graph.nodes.filter(F.col("id") == identifier.strip()).select("id")
    node = own if not own.isEmpty() else find_nodes(graph.nodes, identifier.strip(), limit=1).select("id")
    if node.isEmpty():
        raise GraphError(f"no symbol is named {identifier}")
    return neighbors(graph.edges, node).join(graph.nodes.select(F.col("id").alias("other"), F.col("kind").alias("other_kind")), "other").select("id", "edge_id", "type", "other", "other_kind")


def cross_repo_edges(edges: DataFrame, canonical: bool = False) -> DataFrame:
    """cross_repo's pairs as edges: DEPENDS_ON (id, type, from_id, to_id, confidence)."""
    return cross_repo(edges, canonical).select(edge_id(F.lit("DEPENDS_ON"), "from_id", "to_id").alias("id"), F.lit("DEPENDS_ON").alias("type"), "from_id", "to_id", F.lit(0.7).alias("confidence"))


#: Pairs of one API that a cell makes at most, about.
SHARE_PAIRS = 4_000_000


def cross_repo(edges: DataFrame, canonical: bool = False) -> DataFrame:
    """(from_id, to_id): consumers that depend on producers of the same API in another repository, each pair once.

    Only pairs whose ends both have several APIs can meet twice; others are
    never compared. An API's producers are dealt to blocks and its consumers to
    shares, so that a cell of both makes SHARE_PAIRS at most, about. A block has a
    row for each repository, which the consumers of a cell unfold, and cells go
    to all tasks.
    """
    api = without_repo if canonical else lambda c: F.col(c)

    def side(type_: str, id_: str, repo: str) -> DataFrame:
        rows = edges.filter(F.col("type") == type_).select(api("to_id").alias("api"), F.col("from_id").alias(id_), repo_of("from_id").alias(repo)).filter(F.col(repo).isNotNull() & F.col("api").isNotNull()).distinct()
        return rows.withColumn(f"{id_}_many", F.count("*").over(Window.partitionBy(id_)) > 1)

    make, use = (settled(side(*x)) for x in (("EXPOSES", "to_id", "producer"), ("CONSUMES", "from_id", "consumer")))
    n = lambda rows, name: rows.groupBy("api").agg(F.count("*").alias(name))
    many = lambda c: F.ceil(F.col(c) / max(1, math.isqrt(SHARE_PAIRS))).cast("int")
    grid = settled(n(make, "m").join(n(use, "u"), "api").select("api", many("m").alias("blocks"), many("u").alias("shares")))
    cells = grid.agg(F.coalesce(F.sum(F.col("blocks").cast("long") * F.col("shares")), F.lit(1))).first()[0]
    spark = edges.sparkSession
    tasks = min(cells, 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    place, all_of = lambda c, most: F.pmod(F.xxhash64(c), F.col(most)).cast("int"), lambda most: F.explode(F.sequence(F.lit(0), F.col(most) - 1))
    dealt = lambda rows: rows.repartition(tasks, "api", "block", "share")  # noqa: E731  a number that is kept, as rows are few beside their pairs

    def met(a: str, b: str) -> DataFrame:
        made = make.filter(a).join(grid, "api").groupBy("api", place("to_id", "blocks").alias("block"), "shares", "producer").agg(F.collect_list("to_id").alias("made"))
        used = use.filter(b).join(grid, "api").select("api", all_of("blocks").alias("block"), place("from_id", "shares").alias("share"), "consumer", "from_id")
        cells = dealt(used).join(dealt(made.select("api", "block", all_of("shares").alias("share"), "producer", "made")), ["api", "block", "share"]).filter("producer <> consumer")
        return cells.select("from_id", F.explode("made").alias("to_id"))

    return met("true", "not from_id_many").union(met("not to_id_many", "from_id_many")).union(met("to_id_many", "from_id_many").distinct())


def cross_repo_factors(edges: DataFrame, canonical: bool = False) -> DataFrame:
    """cross_repo in factored form: (api, role, repo, id), what makes and what uses each API that another repository takes part in.

    As many rows as the edges behind it, where pairs are makers times users.
    """
    api = without_repo if canonical else lambda c: F.col(c)
    ends = edges.filter(F.col("type").isin("EXPOSES", "CONSUMES")).select(api("to_id").alias("api"), F.when(F.col("type") == "EXPOSES", "make").otherwise("use").alias("role"), repo_of("from_id").alias("repo"), F.col("from_id").alias("id")).filter("repo is not null").distinct()
    sides = ends.groupBy("api", "role").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi")).groupBy("api").agg(F.count("*").alias("roles"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return ends.join(sides.filter("roles = 2 and lo <> hi").select("api"), "api", "left_semi")


def cross_repo_counts(factors: DataFrame) -> DataFrame:
    """(consumer, producer, links): how many uses of a maker's API by another repository there are between each two repositories, from counts alone."""
    per = factors.groupBy("api", "role", "repo").agg(F.count("*").alias("n"))
    side = lambda role, name: per.filter(F.col("role") == role).select("api", F.col("repo").alias(name), F.col("n").alias(f"{name}_n"))
    met = side("use", "consumer").join(side("make", "producer"), "api").filter("consumer <> producer")
    return met.groupBy("consumer", "producer").agg(F.sum(F.col("consumer_n") * F.col("producer_n")).alias("links"))


def cross_repo_pairs(factors: DataFrame, consumer: str, producer: str) -> DataFrame:
    """(from_id, to_id): the pairs behind the counts of two repositories."""
    side = lambda role, repo, name: factors.filter((F.col("role") == role) & (F.col("repo") == repo)).select("api", F.col("id").alias(name))
    return side("use", consumer, "from_id").join(side("make", producer, "to_id"), "api").select("from_id", "to_id").distinct()


def prefixed(edges: DataFrame, repo: Column) -> DataFrame:
    return edges.withColumn("from_id", prefix_repo("from_id", repo)).withColumn("to_id", prefix_repo("to_id", repo))


def services(files: DataFrame) -> DataFrame:
    """(service, files): folders below a services' parent, and top folders of two files or more."""
    named = files.withColumn("s", service_of("path")).filter("s is not null").select("s.name", "s.under")
    return named.groupBy("name").agg(F.count("*").alias("files"), F.bool_or("under").alias("under")).filter("under or files >= 2").select(F.col("name").alias("service"), "files")


def verified_edges(claims: DataFrame, files: DataFrame) -> DataFrame:
    """claims (id, file, snippet) rows: an edge is accepted if all its snippets stand in the files they cite."""
    met = claims.join(files.select(F.col("path").alias("file"), "content"), "file", "left")
    return met.groupBy("id").agg(F.bool_and(F.coalesce(F.contains("content", "snippet"), F.lit(False))).alias("accepted"))


def pin(from_id: str, to_id: str, type_: str, note: str = "user pin") -> tuple:
    """A raw edge row that a user vouches for."""
    return type_, from_id, to_id, None, None, note, PINS[0], 1.0


def domain(files: DataFrame, by: str) -> DataFrame:
    """The most frequent top folder of each group, the first name on ties."""
    counts = files.withColumn("top", F.substring_index("path", "/", 1)).groupBy(by, "top").count()
    best = Window.partitionBy(by).orderBy(F.desc("count"), "top")
    return counts.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(by, "top")


def narration(summary: DataFrame) -> DataFrame:
    """(start, text): one sentence about each start's impact, with its signals and first path."""
    risks = F.when(F.size("chips") > 0, F.concat(F.lit(" Risks: "), F.array_join("chips", ", "), F.lit("."))).otherwise("")
    return summary.select("start", F.concat(F.lit("Changing "), "start", F.lit(" affects "), F.col("impacted").cast("string"), F.lit(" node(s)."), risks, F.lit(" Example path: "), "first_path", F.lit(".")).alias("text"))
