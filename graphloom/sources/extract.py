"""From source files to a graph: nodes, raw edges, chunks and calls still to be resolved, then the whole sync.

Files are (repo, path, content); repo is null where there is one root only. A
file's path carries its repository in front (repo:name/src/a.ts), so that ids
made of paths come out as prefix_repo gives them and windows never mix two
repositories. A file without text gives its File node alone; one without a
path gives nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import is_test_path, local_import, prefix_repo, repo_of, service_of, trimmed
from ..functions.lineage import settled
from ..operators import store
from . import lexical, lines

# Languages whose calls, imports and strings are read, and manifests by name.
RICH = r"\.(ts|tsx|js|jsx|mjs|cjs|py|java)$"
MANIFEST = r"(^|/)(package\.json|requirements\.txt|pyproject\.toml|go\.mod|Cargo\.toml|pom\.xml)$"
PREFIXES = {"Class": "cls:", "Interface": "iface:"}


@dataclass(frozen=True)
class Parsed:
    """nodes (id, kind, name, path, start_line, end_line, signature, critical, seq), edges (type, from_id, to_id, file, line, snippet, source, confidence, seq), chunks (id, node_id, kind, text, seq), unresolved (key, type, from_id, callee, file, line, snippet). seq.file and key are the file that says it, its repository in front."""

    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    unresolved: DataFrame


def keyed(files: DataFrame) -> DataFrame:
    """Files with the repository in front of the path."""
    front = F.when(F.col("repo").isNotNull(), F.concat(F.lit("repo:"), "repo", F.lit("/"), "path")).otherwise(F.col("path"))
    return files.filter("path is not null").select(front.alias("path"), F.coalesce("content", F.lit("")).alias("content"))


def _own(id_: Column) -> Column:
    """An id that is not made of a path, in the repository of the row's path."""
    repo = F.nullif(F.regexp_extract("path", "^repo:([^/]+)/", 1), F.lit(""))
    return F.when(repo.isNull(), id_).otherwise(prefix_repo(id_, repo))


def _bare(path: str = "path") -> Column:
    return F.regexp_replace(path, "^repo:[^/]+/", "")


def _name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


def _file_id() -> Column:
    return F.concat(F.lit("file:"), "path")


def _node(rows: DataFrame, id_: Column, kind: str | Column, name: Column, has_path: bool = True, line: Column | None = None, end: Column | None = None, signature: Column | None = None) -> DataFrame:
    none = F.lit(None)
    seq = F.struct(F.col("path").alias("file"), (F.lit(0) if line is None else line).cast("int").alias("line"))
    return rows.select(
        id_.alias("id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), name.alias("name"), (_bare() if has_path else none).cast("string").alias("path"), (none if line is None or not has_path else line).cast("int").alias("start_line"),
        (none if end is None else end).cast("int").alias("end_line"), (none if signature is None else signature).cast("string").alias("signature"), F.lit(False).alias("critical"), seq.alias("seq"),
    )


def _edge(rows: DataFrame, type_: str | Column, from_: Column, to: Column, snippet: Column, source: str = "parser", confidence: float | None = None, line: Column | None = None) -> DataFrame:
    at = (F.col("line") if line is None else line).cast("int")
    return rows.select(
        (F.lit(type_) if isinstance(type_, str) else type_).alias("type"), from_.alias("from_id"), to.alias("to_id"), _bare().alias("file"), at.alias("line"), snippet.alias("snippet"), F.lit(source).alias("source"), F.lit(confidence).cast("double").alias("confidence"),
        F.struct(F.col("path").alias("file"), at.alias("line")).alias("seq"),
    )


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _line(length: int = 200) -> Column:
    return F.substring(trimmed("text"), 1, length)


def definitions(files: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, id, pos, kind, name, start_line, end_line, signature, chunk) of code, the first of each id: what was declared in the languages of RICH, and of other files what single lines declare."""
    other = lines.symbols(files.filter(~F.lower("path").rlike(RICH)))
    other = other.select("path", F.col("line").alias("pos"), "kind", "name", F.col("line").alias("start_line"), F.col("line").alias("end_line"), "signature", "chunk")
    front = F.coalesce(*(F.when(F.col("kind") == k, p) for k, p in PREFIXES.items()), F.lit("fn:"))
    named = declared.select(*other.columns).union(other).withColumn("id", F.concat(front, "path", F.lit(":"), "name"))
    first = F.min_by(F.struct("pos", "kind", "name", "start_line", "end_line", "signature", "chunk"), F.col("pos"))
    return named.groupBy("path", "id").agg(first.alias("d")).select("path", "id", "d.*")


def _code(files: DataFrame) -> Parsed:
    rich = files.filter(F.lower("path").rlike(RICH))
    toks = settled(lexical.tokens(rich))
    opened = settled(lexical.brackets(toks))
    declared = settled(lexical.declarations(rich, toks, opened))
    defs = settled(definitions(files, declared))
    test_id = F.concat(F.lit("test:"), "path", F.lit(":suite"))
    spans = defs.select("path", F.col("id").alias("name"), "start_line", "end_line", "pos")
    within = lambda rows: lines.enclosing(rows, spans, "pos").withColumnRenamed("symbol", "caller")
    first = defs.groupBy("path", F.col("name").alias("callee")).agg(F.min_by("id", "pos").alias("target"))
    nodes = [
        _node(files, _file_id(), "File", _bare()), _node(rich.filter(is_test_path(_bare())), test_id, "Test", _bare()),
        _node(defs, F.col("id"), F.col("kind"), F.col("name"), True, F.col("start_line"), F.col("end_line"), F.col("signature")),
    ]
    edges = [_edge(defs, "CONTAINS", _file_id(), F.col("id"), F.col("signature"), line=F.col("start_line"))]

    # calls by name: inside the file, or left for the whole workspace
    text = settled(lines.lines(rich).select("path", "line", "text"))
    every = settled(lexical.calls(opened).join(declared.select("path", "pos"), ["path", "pos"], "left_anti"))
    calls = every.select("path", "line", "callee").distinct().join(text, ["path", "line"]).join(first, ["path", "callee"], "left")
    plumbing = F.lower("callee").isin(*{x.lower() for x in (*lines.HTTP_CLIENTS, *lines.ROUTE_METHODS, *lines.PUBLISHERS, *lines.SUBSCRIBERS) if x.islower()})
    calls = settled(within(calls).withColumn("plumbing", plumbing).withColumn("test", is_test_path(_bare())))
    edges.append(_edge(calls.filter("caller <> target"), "CALLS", F.col("caller"), F.col("target"), _line(), confidence=0.9))
    edges.append(_edge(calls.filter("test and not plumbing and target is not null"), "TESTS", test_id, F.col("target"), _line(), confidence=0.8))
    open_ = calls.filter("target is null and not plumbing")
    left = lambda rows, type_, from_: rows.select(F.col("path").alias("key"), F.lit(type_).alias("type"), from_.alias("from_id"), "callee", _bare().alias("file"), "line", _line().alias("snippet"))
    unresolved = left(open_.filter("test"), "TESTS", test_id).union(left(open_.filter("caller is not null"), "CALLS", F.col("caller")))

    # routes, clients and events: calls with strings among their arguments
    called = settled(within(lexical.string_arguments(every, toks, opened).join(text, ["path", "line"])))
    owner = defs.groupBy("path").agg(F.min_by("id", "pos").alias("owner"))
    api = _own(F.concat(F.lit("api:"), "method", F.lit(":"), "route"))
    callers = called.select("path", "line", "caller").distinct()
    addressed = called.filter(F.col("arg").rlike("^(/|https?://)")).groupBy("path", "pos", "line", "callee", "text").agg(F.min_by("arg", "n").alias("arg"))
    routes = lines.routes_of(called.filter("n = 1")).join(callers, ["path", "line"]).join(owner, "path", "left")
    clients = lines.clients_of(addressed).join(callers, ["path", "line"]).filter("caller is not null")
    events = lines.events_of(called.filter("n = 1")).join(callers, ["path", "line"]).filter("caller is not null")
    event = _own(F.concat(F.lit("event:"), "event"))
    nodes += [_node(x, api, "API", F.concat("method", F.lit(" "), "route"), False, F.col("line")) for x in (routes, clients)] + [_node(events, event, "Event", F.col("event"), False, F.col("line"))]
    from_ = F.coalesce("caller", "owner")
    edges += [_edge(routes.filter(from_.isNotNull()), "EXPOSES", from_, api, _line(), confidence=0.7), _edge(clients, "CONSUMES", F.col("caller"), api, _line(), confidence=0.6), _edge(events, F.col("type"), F.col("caller"), event, _line(), confidence=0.5)]

    # imports
    found = lexical.imports(toks, text).withColumn("local", F.col("mod").startswith("."))
    found = found.select("path", "line", "text", F.when(F.col("local"), local_import("path", "mod")).otherwise(F.col("mod")).alias("target"), "local")
    far, near = found.filter(~F.col("local")), found.filter("local")
    ext = _own(F.concat(F.lit("ext:"), "target"))
    nodes.append(_node(far, ext, "External", F.col("target"), False, F.col("line")))
    edges += [_edge(far, "IMPORTS", _file_id(), ext, _line(), confidence=0.8), _edge(near, "IMPORTS", _file_id(), F.concat(F.lit("file:"), "target"), _line(), confidence=0.7)]

    # SQL in string literals
    literal = lexical.strings(toks).select("path", "line", F.col("literal").alias("text"))
    tables = within(lines.sql_in_text(literal)).filter("caller is not null")
    table = _own(F.concat(F.lit("table:"), "table_name"))
    nodes.append(_node(tables, table, "Table", F.col("table_name"), False, F.col("line")))
    edges.append(_edge(tables, F.col("access"), F.col("caller"), table, _line(120), confidence=0.6))

    # interfaces of the same file
    made = lexical.implements(toks).join(text, ["path", "line"])
    made = made.join(first.select("path", F.col("callee").alias("class"), F.col("target").alias("own")), ["path", "class"]).join(first.select("path", F.col("callee").alias("interface"), F.col("target").alias("other")), ["path", "interface"])
    edges.append(_edge(made, "IMPLEMENTS", F.col("own"), F.col("other"), _line(), confidence=0.8))

    chunks = defs.filter("chunk <> ''").select(F.concat(F.lit("chunk:"), "id").alias("id"), F.col("id").alias("node_id"), F.lit("code").alias("kind"), F.col("chunk").alias("text"), F.struct(F.col("path").alias("file"), F.col("start_line").alias("line")).alias("seq"))
    return Parsed(_all(nodes), _all(edges), chunks, unresolved)


def _manifests(files: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """External packages of npm and pip manifests, each one node whatever repository names it."""
    npm = lines.npm_packages(files.filter(_name() == "package.json")).withColumn("line", F.lit(1)).withColumn("snippet", F.concat("package", F.lit(": "), "version"))
    pip = files.filter(_name() == "requirements.txt")
    pip = lines.requirements(pip).join(lines.lines(pip), ["path", "line"]).withColumn("snippet", _line(120))
    nodes, edges = [_node(files, _file_id(), "File", _bare())], []
    ext = F.concat(F.lit("ext:"), "package")
    for found in (npm, pip):
        nodes.append(_node(found, ext, "External", F.col("package"), False, F.col("line")))
        edges.append(_edge(found, "DEPENDS_ON", _file_id(), ext, F.col("snippet"), "lockfile", 0.9))
    doc = F.concat(F.lit("doc:https://www.npmjs.com/package/"), "package")
    nodes.append(_node(npm, doc, "Doc", F.concat("package", F.lit(" docs")), False, F.col("line")))
    edges.append(_edge(npm, "DOCUMENTS", doc, ext, F.col("snippet"), "lockfile", 0.5))
    return nodes, edges


def _ingested(files: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """API descriptions, schemas, settings, compose files and Dockerfiles (path, content, reader)."""
    of = lambda reader: files.filter(F.col("reader") == reader)
    nodes, edges = [_node(files, _file_id(), "File", _bare())], []

    contract = F.concat(F.lit("contract:"), "path")
    routes = lines.openapi_routes(of("openapi"))
    api, said = _own(F.concat(F.lit("api:"), "method", F.lit(":"), "route")), F.concat("method", F.lit(" "), "route")
    nodes += [_node(of("openapi"), contract, "Contract", F.concat(F.lit("OpenAPI "), _name())), _node(routes, api, "API", said, False, F.col("line"))]
    edges += [_edge(routes, "CONSTRAINED_BY", api, contract, said, "openapi", 0.9), _edge(routes, "DOCUMENTS", contract, api, said, "openapi", 0.9)]

    schema = of("sql")
    found = lines.sql_tables(schema).join(lines.lines(schema), ["path", "line"])
    columns, table = found.filter("column is not null"), _own(F.concat(F.lit("table:"), "table"))
    column = _own(F.concat(F.lit("col:"), "table", F.lit("."), "column"))
    nodes += [_node(found.filter("column is null"), table, "Table", F.col("table"), True, F.col("line")), _node(columns, column, "Column", F.col("column"), True, F.col("line"))]
    edges.append(_edge(columns, "CONTAINS", table, column, _line(120), confidence=0.9))

    keys = lines.config_keys(of("config"))
    nodes.append(_node(keys, _own(F.concat(F.lit("cfg:"), "key")), "ConfigKey", F.col("key"), True, F.col("line")))

    infra = F.concat(F.lit("infra:"), "path")
    parts = lines.compose_services(of("compose"))
    service = _own(F.concat(F.lit("svc:"), "service"))
    built = of("dockerfile").join(lines.docker_bases(of("dockerfile")), "path")  # the signature is what it builds on
    nodes += [_node(of("compose"), infra, "Infra", _name()), _node(built, infra, "Infra", _name(), signature=F.concat(F.lit("FROM "), "base")), _node(parts, service, "Service", F.col("service"), False, F.col("line"))]
    edges.append(_edge(parts, "CONTAINS", infra, service, F.concat("service", F.lit(":")), "infra", 0.8))
    return nodes, edges


def parse(files: DataFrame) -> Parsed:
    """What files (repo, path, content) say: manifests first by name, then by reader, all else as code. An edge that one file names twice counts once, where it stands first."""
    all_ = settled(keyed(files).withColumn("reader", lines.kind_of_file(F.col("path"))).withColumn("manifest", F.col("path").rlike(MANIFEST)))
    of = lambda where: all_.filter(where).select("path", "content", "reader")
    code = _code(of("not manifest and reader is null"))
    more = [_manifests(of("manifest")), _ingested(of("not manifest and reader is not null"))]
    nodes = _all([code.nodes, *(n for ns, _ in more for n in ns)])
    edges = _all([code.edges, *(e for _, es in more for e in es)])
    once = edges.groupBy(F.col("seq.file").alias("_file"), "type", "from_id", "to_id").agg(F.min_by(F.struct("file", "line", "snippet", "source", "confidence", "seq"), F.struct("line", "confidence", "snippet")).alias("e"))
    return Parsed(settled(nodes), settled(once.select("type", "from_id", "to_id", "e.*")), code.chunks, settled(code.unresolved))


def resolved(unresolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """Raw edges of calls whose name one function or method of the workspace has; a symbol never calls itself."""
    symbols = nodes.filter(F.col("kind").isin("Function", "Method")).groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("n"), F.min("id").alias("to_id")).filter("n = 1")
    found = unresolved.join(symbols.drop("n"), "callee").filter("from_id <> to_id")
    confidence = F.when(F.col("type") == "TESTS", 0.7).otherwise(0.75)
    return found.select("type", "from_id", "to_id", "file", "line", "snippet", F.lit("parser").alias("source"), confidence.alias("confidence"), F.struct("file", "line").alias("seq"))


def derived_services(file_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Service nodes of folders, and raw edges by which they contain their files (id, path): folders below a services' parent, and top folders of two files or more."""
    named = file_nodes.select("id", "path", service_of("path").alias("s")).filter("s is not null").select("id", "path", F.col("s.name").alias("name"), F.col("s.under").alias("under"))
    bare = F.concat(F.lit("svc:"), "name")
    named = named.withColumn("service", F.when(repo_of("id").isNull(), bare).otherwise(prefix_repo(bare, repo_of("id"))))
    at = F.when(F.col("under"), F.concat(F.regexp_extract("path", r"^((?:[^/]+/)*?(?:apps|services|packages|cmd)/)", 1), "name")).otherwise(F.col("name"))
    real = named.groupBy("service").agg(F.count("*").alias("files"), F.min_by(F.struct("under", at.alias("dir"), "name"), "id").alias("first")).filter("first.under or files >= 2")
    nodes = real.select(F.col("service").alias("id"), F.lit("Service").alias("kind"), F.col("first.name").alias("name"), F.col("first.dir").alias("path"), "files")
    held = named.join(real.select("service"), "service", "left_semi")
    edges = held.select(F.lit("CONTAINS").alias("type"), F.col("service").alias("from_id"), F.col("id").alias("to_id"), F.col("path").alias("file"), F.lit(1).alias("line"), F.concat(F.lit("service "), "name", F.lit(" contains "), "path").alias("snippet"), F.lit("parser").alias("source"), F.lit(0.6).alias("confidence"), F.struct(F.col("path").alias("file"), F.lit(1).alias("line")).alias("seq"))
    return nodes, edges


def cross_repo_evidence(merged: DataFrame) -> DataFrame:
    """Raw DEPENDS_ON edges between repositories, two pieces of evidence each: what consumes an API and what exposes it. merged edges have evidence."""
    at = lambda type_, end: merged.filter((F.col("type") == type_) & F.col("to_id").startswith("api:")).select(F.col("to_id").alias("api"), F.col("from_id").alias(end), repo_of("from_id").alias(f"{end}_repo"), F.get("evidence", F.lit(0)).alias(f"{end}_at"))
    pairs = at("CONSUMES", "use").join(at("EXPOSES", "make"), "api").filter("use_repo <> make_repo")
    piece = lambda end, word, n: F.struct(F.coalesce(f"{end}_at.file", F.lit("")).alias("file"), F.coalesce(f"{end}_at.line", F.lit(0)).cast("int").alias("line"), F.concat(F.lit(f"{word} "), "api").alias("snippet"), F.lit(n).alias("n"))
    both = pairs.select("use", "make", "api", F.explode(F.array(piece("use", "consumes", 0), piece("make", "exposes", 1))).alias("e"))
    return both.select(F.lit("DEPENDS_ON").alias("type"), F.col("use").alias("from_id"), F.col("make").alias("to_id"), "e.file", "e.line", "e.snippet", F.lit("openapi").alias("source"), F.lit(0.7).alias("confidence"), F.struct(F.col("api").alias("file"), F.col("e.n").alias("line")).alias("seq"))


@dataclass(frozen=True)
class Synced:
    """A workspace's nodes, merged edges with evidence, chunks, and one row of counts."""

    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    counts: DataFrame


def sync(files: DataFrame, stored: DataFrame | None = None, with_chunks: DataFrame | None = None, force: bool = False) -> Synced:
    """The graph that files (repo, path, content, sha256) give, those left out whose digest is stored and which have a chunk.

    Calls are resolved over the whole workspace, services follow from folders,
    and, with two repositories or more, dependencies between them from shared
    APIs. Edges whose ends don't exist are dropped. stored and with_chunks hold
    paths as keyed gives them.
    """
    files = files.withColumn("_key", F.when(F.col("repo").isNotNull(), F.concat(F.lit("repo:"), "repo", F.lit("/"), "path")).otherwise(F.col("path")))
    chosen = files
    if stored is not None and with_chunks is not None:
        skip = store.to_sync(files.select(F.col("_key").alias("path"), "sha256"), stored, with_chunks, force).filter("action = 'skip'")
        chosen = files.join(skip.select(F.col("path").alias("_key")).distinct(), "_key", "left_anti")
    return derived(parse(chosen.select("repo", "path", "content")), files.agg(F.count_distinct("repo").alias("roots"), F.count("*").alias("files")), chosen.agg(F.count("*").alias("changed")))


def derived(got: Parsed, roots: DataFrame, changed: DataFrame) -> Synced:
    """The graph of what files say. roots (roots, files) and changed (changed) are rows of counts."""
    nodes = settled(store.upsert_nodes(got.nodes))
    services, held = derived_services(nodes.filter("kind = 'File'").select("id", "path"))
    added = services.select("id", "kind", "name", "path", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("string").alias("signature"), F.lit(False).alias("critical"))
    full = settled(nodes.join(added.select("id"), "id", "left_anti").unionByName(added))
    raw = settled(got.edges.unionByName(resolved(got.unresolved, nodes)).unionByName(held))
    edges = settled(store.upsert_edges(raw, full))
    cross = cross_repo_evidence(edges)
    across = store.upsert_edges(cross, full)
    edges = settled(edges.join(across.select("id"), "id", "left_anti").unionByName(store.upsert_edges(raw.join(cross.select("type", "from_id", "to_id").distinct(), ["type", "from_id", "to_id"], "left_semi").unionByName(cross), full)))
    counts = roots.crossJoin(changed).crossJoin(nodes.agg(F.count_if(F.col("kind") != "File").alias("symbols"))).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(services.agg(F.count("*").alias("services"))).crossJoin(across.agg(F.count("*").alias("cross_repo_edges")))
    counts = counts.select(F.greatest("roots", F.lit(1)).alias("roots"), "files", "changed", (F.col("files") - F.col("changed")).alias("skipped"), "symbols", "edges", "services", "cross_repo_edges")
    return Synced(full, edges, store.upsert_chunks(got.chunks, full), counts)
