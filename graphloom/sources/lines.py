"""Extraction from files line by line: manifests, schemas, API descriptions and code.

Every function takes files (path, content) and explodes them into numbered
lines; what a line means by the lines before it comes from windows over one
file, which is the unit that stays together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ids import edge_id, local_import, trimmed


def _file(start: int, end: int) -> Window:
    """Lines of the same file, by their distance."""
    return Window.partitionBy("path").orderBy("line").rowsBetween(start, end)


def _so_far() -> Window:
    return _file(Window.unboundedPreceding, 0)


# What names a verb of an API.
VERBS = "get|post|put|patch|delete|options|head"
# Lower-case names of files by what reads them, in this order.
FILE_KINDS = {
    "openapi": r"(openapi|swagger|asyncapi).*\.(yaml|yml|json)$",
    "sql": r"\.sql$",
    "compose": r"^(docker-compose\.yml|docker-compose\.yaml|compose\.yml|compose\.yaml)$",
    "dockerfile": r"^dockerfile($|\.)",
    "config": r"^\.env($|\.)|\.env$",
}
# What declares a symbol, tried in this order.
DECLARATIONS = (
    (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)", "Function"),
    (r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)", "Class"),
    (r"^\s*(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(", "Function"),
    (r"^\s*def\s+([A-Za-z_][\w]*)", "Function"),
    (r"^\s*class\s+([A-Za-z_][\w]*)", "Class"),
    (r"^\s*(?:func|fn|sub)\s+([A-Za-z_][\w]*)", "Function"),
)
# Callees that register routes, call over HTTP, publish and subscribe.
ROUTE_METHODS = ("get", "post", "put", "patch", "delete", "options", "head")
HTTP_CLIENTS = ("fetch", "get", "post", "put", "patch", "delete", "request", "requests", "axios", "got", "ky", "httpx")
PUBLISHERS = ("emit", "publish", "dispatch", "send", "produce")
SUBSCRIBERS = ("on", "subscribe", "addEventListener", "consume", "listen")


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text), lines from 1."""
    return files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def kind_of_file(path: F.Column) -> F.Column:
    """What reads a file, by its name: the first of FILE_KINDS that fits, or a manifest's reader."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    kinds = [F.when(name.rlike(p), k) for k, p in FILE_KINDS.items()]
    return F.coalesce(*kinds, F.when(name == "package.json", "npm"), F.when(name == "requirements.txt", "pip"))


def requirements(files: DataFrame) -> DataFrame:
    """(path, line, package, version) of requirements files; comments and blank lines are left out."""
    found = lines(files).withColumn("m", F.regexp_extract("text", r"^\s*([A-Za-z0-9_.\-]+)", 1))
    return found.filter((F.col("m") != "") & ~trimmed("text").startswith("#")).select("path", "line", F.col("m").alias("package"), F.nullif(F.regexp_extract("text", r"(?:==|>=|<=|~=|!=|>|<)\s*([^\s;#,]+)", 1), F.lit("")).alias("version"))


def npm_packages(files: DataFrame) -> DataFrame:
    """(path, package, version) of package.json files, development packages too."""
    spec = "dependencies map<string,string>, devDependencies map<string,string>"
    both = files.select("path", F.from_json("content", spec).alias("j")).select("path", F.map_concat(F.coalesce("j.devDependencies", F.create_map()), F.map_filter(F.coalesce("j.dependencies", F.create_map()), lambda k, _: ~F.map_contains_key(F.coalesce("j.devDependencies", F.create_map()), k))).alias("m"))
    return both.select("path", F.explode("m").alias("package", "version"))


def openapi_routes(files: DataFrame) -> DataFrame:
    """(path, line, method, route): each verb's line with the last route line before it, both after paths:."""
    found = lines(files).withColumn("within", F.max(F.col("text").rlike(r"^\s*paths\s*:").cast("int")).over(_so_far()))
    found = found.withColumn("route", F.last(F.when(F.col("within") == 1, F.nullif(F.regexp_extract("text", r"^\s*[\"']?(/[A-Za-z0-9_{}/.-]*)[\"']?\s*:", 1), F.lit(""))), ignorenulls=True).over(_so_far()))
    found = found.withColumn("method", F.upper(F.regexp_extract(F.lower("text"), rf"^\s*[\"']?({VERBS})[\"']?\s*:", 1)))
    return found.filter("within = 1 and method <> '' and route is not null").select("path", "line", "method", "route")


def sql_tables(files: DataFrame) -> DataFrame:
    """(path, line, table, column): created tables (column null) and their columns up to a line that closes them."""
    text = F.lower(trimmed("text"))
    found = lines(files).withColumn("table", F.nullif(F.regexp_extract(F.lower("text"), r"create\s+table\s+(?:if\s+not\s+exists\s+)?[\"'`]?([a-z_][a-z0-9_.]*)[\"'`]?\s*\(", 1), F.lit("")))
    found = found.withColumn("of", F.last("table", ignorenulls=True).over(_so_far())).withColumn("block", F.count("table").over(_so_far()))
    inside = Window.partitionBy("path", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("closed", F.max(text.startswith(")").cast("int")).over(inside))
    column = F.nullif(F.regexp_extract(text, r"^[\"'`]?([a-z_][a-z0-9_]*)[\"'`]?\s+[a-z]", 1), F.lit(""))
    rows = found.withColumn("column", F.when(F.col("table").isNull(), column))
    dull = F.coalesce(F.col("column").isin("primary", "foreign", "constraint", "unique", "key", "index", "check"), F.lit(False))
    return rows.filter((F.col("block") > 0) & (F.col("table").isNotNull() | ((F.col("closed") == 0) & F.col("column").isNotNull() & ~dull))).select("path", "line", F.col("of").alias("table"), "column")


def config_keys(files: DataFrame) -> DataFrame:
    """(path, line, key) of .env files; values are never read."""
    return lines(files).withColumn("key", F.regexp_extract("text", r"^\s*([A-Z][A-Z0-9_]*)\s*=", 1)).filter("key <> ''").select("path", "line", "key")


def compose_services(files: DataFrame) -> DataFrame:
    """(path, line, service): keys two spaces deeper than services:."""
    found = lines(files).withColumn("indent", F.length(F.regexp_extract("text", r"^( *)", 1))).withColumn("word", F.regexp_extract("text", r"^ *([A-Za-z0-9_.\-]+)\s*:", 1))
    found = found.filter("word <> ''").withColumn("top", F.when(F.col("word") == "services", F.col("indent")))
    found = found.withColumn("at", F.last("top", ignorenulls=True).over(_so_far())).withColumn("head", F.count("top").over(_so_far()))
    left = Window.partitionBy("path", "head").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("out", F.max(((F.col("indent") <= F.col("at")) & F.col("top").isNull()).cast("int")).over(left))
    return found.filter("at is not null and out = 0 and indent = at + 2").select("path", "line", F.col("word").alias("service"))


def docker_bases(files: DataFrame) -> DataFrame:
    """(path, base) of Dockerfiles: the first FROM."""
    return files.select("path", F.nullif(F.regexp_extract("content", r"(?im)^\s*FROM\s+(\S+)", 1), F.lit("")).alias("base"))


def symbols(files: DataFrame) -> DataFrame:
    """(path, line, kind, name, signature, chunk): the first declaration of each line, with 20 lines of text from it.

    A file's lines are an array that is cut at declarations only: no window, and nothing is copied for other lines.
    """
    def told(text, i):
        names = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p, _ in DECLARATIONS]
        kind = F.coalesce(*(F.when(n.isNotNull(), k) for n, (_, k) in zip(names, DECLARATIONS, strict=True)))
        return F.struct((i + 1).alias("line"), kind.alias("kind"), F.coalesce(*names).alias("name"), text.alias("text"), i.alias("i"))

    found = files.select("path", F.split("content", "\r?\n").alias("all"))
    found = found.withColumn("s", F.filter(F.transform("all", told), lambda s: s["name"].isNotNull()))
    found = found.select("path", F.explode(F.transform("s", lambda s: F.struct(s["line"].alias("line"), s["kind"].alias("kind"), s["name"].alias("name"), F.substring(trimmed(s["text"]), 1, 200).alias("signature"), F.substring(trimmed(F.array_join(F.slice("all", s["line"], 20), "\n")), 1, 4000).alias("chunk")))).alias("s"))
    return found.select("path", "s.*")


def called_names(files: DataFrame) -> DataFrame:
    """(path, line, text, callee, arg): calls whose first argument is a string."""
    one = r"([A-Za-z_$][\w$]*)\s*\(\s*[\"'`]([^\"'`]*)[\"'`]"
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(one), F.lit(1)).alias("callee"), F.regexp_extract_all("text", F.lit(one), F.lit(2)).alias("arg"))
    return lines(files).select("path", "line", "text", F.explode(both).alias("c")).select("path", "line", "text", "c.callee", "c.arg")


def routes_of(called: DataFrame) -> DataFrame:
    return called.filter(F.lower("callee").isin(*ROUTE_METHODS) & F.col("arg").startswith("/")).select("path", "line", "text", F.upper("callee").alias("method"), F.col("arg").alias("route"))


def route_calls(files: DataFrame) -> DataFrame:
    """(path, line, method, route): calls that register a route, as in app.get("/x", ...)."""
    return routes_of(called_names(files)).drop("text")


def clients_of(called: DataFrame) -> DataFrame:
    found = called.filter(F.lower("callee").isin(*HTTP_CLIENTS) & F.col("arg").rlike("^(/|https?://)")).withColumn("route", F.regexp_replace("arg", "^https?://[^/]+", ""))
    hint = F.nullif(F.regexp_extract(F.upper(F.substring(trimmed("text"), 1, 200)), r"\b(GET|POST|PUT|PATCH|DELETE)\b", 1), F.lit(""))
    method = F.when(F.lower("callee").isin(*ROUTE_METHODS), F.upper("callee")).otherwise(F.coalesce(hint, F.lit("GET")))
    return found.filter(F.col("route").startswith("/")).select("path", "line", "text", method.alias("method"), "route")


def http_calls(files: DataFrame) -> DataFrame:
    """(path, line, method, route): calls of HTTP clients, hosts cut off; the method is the callee's, else one that the line names, else GET."""
    return clients_of(called_names(files)).drop("text")


def events_of(called: DataFrame) -> DataFrame:
    found = called.filter(F.col("arg").rlike(r"^[A-Za-z][\w.:-]*$"))
    low = F.lower("callee")
    type_ = F.when(low.isin(*PUBLISHERS), "PUBLISHES").when(low.isin(*(s.lower() for s in SUBSCRIBERS if s.islower())), "SUBSCRIBES")
    return found.withColumn("type", type_).filter("type is not null").select("path", "line", "text", "type", F.col("arg").alias("event"))


def event_calls(files: DataFrame) -> DataFrame:
    """(path, line, type, event): PUBLISHES or SUBSCRIBES with an event's name."""
    return events_of(called_names(files)).drop("text")


def imports_with_text(files: DataFrame) -> DataFrame:
    text = F.col("text")
    of = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    target = F.coalesce(of(r"^\s*import\b[^\"']*[\"']([^\"']+)[\"']"), of(r"^\s*export\b[^\"']*\bfrom\s+[\"']([^\"']+)[\"']"), of(r"^\s*from\s+(\.*[A-Za-z_][\w.]*|\.+)\s+import\b"), of(r"^\s*import\s+(?:static\s+)?([A-Za-z_][\w.]*)"))
    found = lines(files).withColumn("mod", target).filter("mod is not null").withColumn("local", F.col("mod").startswith("."))
    return found.select("path", "line", "text", F.when(F.col("local"), local_import("path", "mod")).otherwise(F.col("mod")).alias("target"), "local")


def imports(files: DataFrame) -> DataFrame:
    """(path, line, target, local): what a line imports; local targets are paths, resolved beside the file."""
    return imports_with_text(files).drop("text")


def implements(files: DataFrame) -> DataFrame:
    """(path, line, class, interface): one row for each interface that a class line names."""
    found = lines(files).select("path", "line", F.regexp_extract("text", r"\bclass\s+([A-Za-z_$][\w$]*)", 1).alias("class"), F.regexp_extract("text", r"\bimplements\s+([^{]+)", 1).alias("all"))
    return found.filter("class <> '' and all <> ''").select("path", "line", "class", F.explode(F.regexp_extract_all("all", F.lit(r"([A-Za-z_$][\w$.]*)(?:<[^>]*>)?"), F.lit(1))).alias("interface"))


def enclosing(rows: DataFrame, spans: DataFrame, order: str = "name") -> DataFrame:
    """rows (path, line, …) with the innermost of spans (path, name, start_line, end_line) around each: the one that starts last, null without one.

    Of spans that start together the last by `order` wins. A file's spans and
    lines are swept in one order: spans pile up as they start, and one that has
    ended when a line looks for it never counts again, so each is dropped once.
    Spans may overlap in any way. Each line of a file is looked up once, however
    many rows it has; equal rows stay.
    """
    spots = rows.select("path", "line").filter("path is not null and line is not null").distinct()
    ends = spans.filter("path is not null and start_line <= end_line").select("path", F.col("start_line").cast("long").alias("line"), F.lit(0).alias("what"), F.col(order).alias("by"), "name", F.col("end_line").cast("long").alias("end"))
    events = ends.unionByName(spots.select("path", F.col("line").cast("long").alias("line"), F.lit(1).alias("what")), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pile = None, []
        for batch in batches:
            out: list[tuple] = []
            for path, line, what, name, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != at:
                    at, pile = path, []
                if what == 0:
                    pile.append((end, name))
                    continue
                while pile and pile[-1][0] < line:
                    pile.pop()
                out.append((path, line, pile[-1][1] if pile else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "line", "symbol"])

    swept = events.repartition("path").sortWithinPartitions("path", "line", "what", "by").select("path", "line", "what", F.col("name").cast("string"), "end")
    inner = swept.mapInArrow(run, "path string, line long, symbol string").withColumn("line", F.col("line").cast(rows.schema["line"].dataType))
    return rows.join(inner, ["path", "line"], "left").select(*rows.columns, "symbol")


def calls(files: DataFrame) -> DataFrame:
    """(path, line, callee) of every name before a bracket, declarations and keywords left out."""
    found = lines(files).filter(~F.col("text").rlike(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|def|func|fn|class|interface)\b"))
    named = found.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_$][\w$]*)\s*\("), F.lit(1))).alias("callee"))
    return named.filter(~F.col("callee").isin("if", "for", "while", "switch", "return", "catch", "function", "def", "with", "print"))


def resolve_calls(unresolved: DataFrame, symbol_nodes: DataFrame) -> DataFrame:
    """Calls (from_id, callee) joined to symbols (id, name) whose name is unique: (from_id, to_id), never to itself."""
    unique = symbol_nodes.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("to_id")).filter("n = 1").select(F.col("name").alias("callee"), "to_id")
    return unresolved.join(unique, "callee").filter("from_id <> to_id").select("from_id", "to_id").distinct()


def sql_in_text(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with the table that a text writes to, or else reads from: access and table_name."""
    wrote = F.nullif(F.regexp_extract(F.lower(text), r"\b(?:insert\s+into|update|delete\s+from)\s+[\"'`]?([a-z_][a-z0-9_.]*)", 1), F.lit(""))
    read = F.nullif(F.regexp_extract(F.lower(text), r"\bfrom\s+[\"'`]?([a-z_][a-z0-9_.]*)", 1), F.lit(""))
    return rows.withColumn("access", F.when(wrote.isNotNull(), "WRITES").when(read.isNotNull(), "READS")).withColumn("table_name", F.coalesce(wrote, read)).filter("access is not null")


def hrefs(pages: DataFrame) -> DataFrame:
    """Links to paths of their own site: edges CONSUMES (id, from_id, to_id, n) from a page's File node to an API node."""
    found = pages.select(F.concat(F.lit("file:"), "url").alias("from_id"), F.explode(F.regexp_extract_all("html", F.lit(r'href="(/[^"#?]*)'), F.lit(1))).alias("target"))
    edges = found.groupBy("from_id", F.concat(F.lit("api:GET:"), "target").alias("to_id")).agg(F.count("*").alias("n"))
    return edges.select(edge_id(F.lit("CONSUMES"), "from_id", "to_id").alias("id"), "from_id", "to_id", "n")
