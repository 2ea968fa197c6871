"""Identifiers and small text functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(text: Column | str) -> Column:
    """The text without white space at its ends, line ends and tabs too."""
    return F.trim(_c(text), F.lit(" \t\r\n\f\v\u00a0"))


def edge_id(type_: Column | str, from_id: Column | str, to_id: Column | str) -> Column:
    """e_ and the first 16 hex digits of the SHA-1 of the parts, zero bytes between them."""
    nul = F.char(F.lit(0))
    return F.concat(F.lit("e_"), F.substring(F.sha1(F.concat(_c(type_), nul, _c(from_id), nul, _c(to_id)).cast("binary")), 1, 16))


def prefix_repo(id_: Column | str, repo: Column | str) -> Column:
    """The id with repo:<name>/ after its kind prefix, once."""
    c = _c(id_)
    rest = F.substring(c, F.instr(c, ":") + 1, F.length(c))
    head = F.substring(c, F.lit(1), F.instr(c, ":"))
    return F.when((F.instr(c, ":") == 0) | rest.startswith("repo:"), c).otherwise(F.concat(head, F.lit("repo:"), _c(repo), F.lit("/"), rest))


def repo_of(id_: Column | str) -> Column:
    """The repository name in a prefixed id, null without one."""
    return F.nullif(F.regexp_extract(_c(id_), r"^[^:]*:repo:([^/]+)/", 1), F.lit(""))


def without_repo(id_: Column | str) -> Column:
    return F.regexp_replace(_c(id_), r"^([^:]*:)repo:[^/]+/", "$1")


def tokens(text: Column | str) -> Column:
    """Distinct lower-case search tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(text)), F.lit(r"([a-z0-9_@./:-]+)"), F.lit(1)))


def safe_id(id_: Column | str) -> Column:
    return F.concat(F.lit("n_"), F.regexp_replace(_c(id_), "[^A-Za-z0-9_]", "_"))


def canonical_json(text: Column | str) -> Column:
    """JSON text with the keys of every object in order; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(_c(text)))


def local_import(file: Column | str, target: Column | str) -> Column:
    """The path that a relative import means; without an extension of code it means .ts."""
    folder = F.slice(F.split(_c(file), "/"), 1, F.size(F.split(_c(file), "/")) - 1)

    def fold(at: Column, part: Column) -> Column:
        up = F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))
        return F.when(part.isin(".", ""), at).when(part == "..", up).otherwise(F.concat(at, F.array(part)))

    path = F.array_join(F.aggregate(F.split(_c(target), "/"), folder, fold), "/")
    return F.when(path.rlike(r"\.([cm]?[jt]sx?|py|java)$"), path).otherwise(F.concat(path, F.lit(".ts")))


def service_of(path: Column | str) -> Column:
    """(name, under): the folder below apps, services, packages or cmd, else the top folder; null at the top."""
    parts = F.split(_c(path), "/")
    top = F.filter(F.transform(parts, lambda x, i: F.when(x.isin("apps", "services", "packages", "cmd") & (i + 2 < F.size(parts)), F.get(parts, i + 1))), lambda x: x.isNotNull())
    return F.when(F.size(top) > 0, F.struct(F.get(top, F.lit(0)).alias("name"), F.lit(True).alias("under"))).when(F.size(parts) > 1, F.struct(F.get(parts, F.lit(0)).alias("name"), F.lit(False).alias("under")))


#: Lower-case paths of test files.
TEST_PATHS = (r"(^|/)(tests?|__tests__|spec)/", r"\.(test|spec)\.[cm]?[jt]sx?$", r"(^|/)test_[^/]+\.py$", r"_test\.(py|go|java)$", r"tests?\.py$")


def is_test_path(path: Column | str) -> Column:
    return F.lower(_c(path)).rlike("|".join(TEST_PATHS))
