"""Code as tokens: comments and strings over several lines, brackets that match, declarations, calls and their arguments.

A file is cut into tokens by one pattern of its language, whose alternatives
are tried at each place in order, so that what looks like a call in a comment
or string is none. Tokens are rows, and all structure comes from windows over a
file: a running count of brackets is a token's level; an opening bracket and
the one that closes it are neighbours among the brackets of their level; what
holds a token is the last bracket opened one level below. Each window is a
sort and one pass, so work is linear in a file's tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ids import trimmed
from ..functions.lineage import settled

_QUOTED = r""""[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'"""
_REST = r"[A-Za-z_$][\w$]*|[0-9][\w.]*|\n|[^\S\n]+|(?s:.)"
#: Comments, strings, names, numbers, line ends, other white space, single signs.
BRACES = r'//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|"""(?s:.*?)(?:"""|\z)|' + _QUOTED + r"|`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`|" + _REST
INDENTS = r'#[^\n]*|(?:[rRbBuUfF]{1,2})?+(?:"""(?s:.*?)(?:"""|\z)|' + r"'''(?s:.*?)(?:'''|\z)|" + _QUOTED + ")|" + _REST

#: Words before a bracket that call nothing.
CONTROL = ("if", "for", "while", "switch", "catch", "function", "return", "with", "def", "class", "print", "synchronized", "try", "super", "typeof", "elif", "and", "or", "not", "in", "is", "lambda", "assert", "yield", "await", "except", "del", "raise", "else", "do")
#: Words and signs before a name that a declaration can't follow.
_NOT_DECLARED = ("new", ".", "return", "await", "throw", "function", "=", "else", "case", "?", "@")
_MODIFIERS = ("public", "private", "protected", "static", "async", "get", "set", "override", "abstract", "readonly", "final", "*", "{", "}", ";")
_NAME = r"^[A-Za-z_$]"
_STRING = r"""^(?:[rRbBuUfF]{1,2})?["'`]"""


def language(path: Column) -> Column:
    """python, java or ts, of which the last stands for JavaScript too."""
    low = F.lower(path)
    return F.when(low.endswith(".py"), "python").when(low.endswith(".java"), "java").otherwise("ts")


def tokens(files: DataFrame) -> DataFrame:
    """Tokens of files (path, content) without comments and white space: (path, pos, line, lang, tok, level, prev, prev2, prev_line, prev2_line, next).

    level is the number of brackets open around a token; a bracket has that of
    what it stands in. A string is one token, on the line where it begins.
    """
    lang = language(F.col("path"))
    cut = files.select("path", lang.alias("lang"), F.posexplode(F.regexp_extract_all("content", F.when(lang == "python", INDENTS).otherwise(BRACES), F.lit(0))).alias("pos", "tok"))
    comment = F.when(F.col("lang") == "python", F.col("tok").startswith("#")).otherwise(F.col("tok").rlike("^/[/*]"))
    cut = cut.withColumn("mute", comment | F.col("tok").rlike(r"^\s")).withColumn("ends", F.length("tok") - F.length(F.replace("tok", F.lit("\n"), F.lit(""))))
    cut = cut.filter(~F.col("mute") | (F.col("ends") > 0))
    so_far = Window.partitionBy("path").orderBy("pos")
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    opens, closes = (F.col("tok").isin(*x).cast("int") for x in ("([{", ")]}"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    told = cut.withColumn("line", (zero(F.sum("ends").over(before)) + 1).cast("int")).withColumn("level", zero(F.sum(opens).over(before)) - F.sum(closes).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    told = told.filter(~F.col("mute")).drop("mute", "ends")
    return told.withColumns({"prev": F.lag("tok").over(so_far), "prev2": F.lag("tok", 2).over(so_far), "prev_line": F.lag("line").over(so_far), "prev2_line": F.lag("line", 2).over(so_far), "next": F.lead("tok").over(so_far)})


def brackets(toks: DataFrame) -> DataFrame:
    """Opening brackets (path, pos, line, lang, tok, level, prev, prev2, prev_line, prev2_line) with the line that closes them and the token after that (end_line, after); both null where none does."""
    only = toks.filter(F.col("tok").isin(*"()[]{}"))
    pair = Window.partitionBy("path", "level").orderBy("pos")
    closed = only.withColumns({"closer": F.lead("tok").over(pair), "end_line": F.lead("line").over(pair), "after": F.lead("next").over(pair)})
    right = F.translate("tok", "([{", ")]}") == F.col("closer")
    return closed.filter(F.col("tok").isin(*"([{")).select("path", "pos", "line", "lang", "tok", "level", "prev", "prev2", "prev_line", "prev2_line", F.when(right, F.col("end_line")).alias("end_line"), F.when(right, F.col("after")).alias("after"))


def _bodies(declared: DataFrame, toks: DataFrame, opened: DataFrame) -> DataFrame:
    """declared (path, pos, level, …) with end_line: where the first braces on their level after them close, null if ; or } comes before any."""
    ends = opened.filter("tok = '{'").select("path", "pos", "level", F.struct(F.coalesce("end_line", F.lit(1 << 30)).alias("end")).alias("stop"))
    inside = F.col("level") + F.when(F.col("tok") == "}", 1).otherwise(0)  # the block that it ends
    ends = ends.union(toks.filter("tok in (';', '}')").select("path", "pos", inside.alias("level"), F.struct(F.lit(None).cast("int").alias("end")).alias("stop")))
    rows = declared.withColumn("stop", F.lit(None).cast("struct<end:int>")).unionByName(ends, allowMissingColumns=True)
    ahead = Window.partitionBy("path", "level").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("end_line", F.last("stop", ignorenulls=True).over(ahead)["end"]).filter("kind is not null").drop("stop")


def _indented_ends(rows: DataFrame) -> DataFrame:
    """(path, pos, end_line) of declarations whose body is what is indented further.

    rows (path, pos, line, indent, declared, ended), one for each line that begins outside brackets, sorted by path and
    pos; ended is the line on which the code before it ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_, last = None, [], 0
        for batch in batches:
            out: list[tuple] = []
            for path, pos, line, indent, declared, ended in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != at:
                    out += [(at, p, None) for _, p in open_]
                    at, open_ = path, []
                while open_ and indent <= open_[-1][0]:
                    out.append((path, open_.pop()[1], ended))
                if declared:
                    open_.append((indent, pos))
                last = line
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.string(), pa.int32(), pa.int32()), strict=True)], names=["path", "pos", "end_line"])
        if open_ and last:
            yield pa.RecordBatch.from_arrays([pa.array([at] * len(open_), pa.string()), pa.array([p for _, p in open_], pa.int32()), pa.array([None] * len(open_), pa.int32())], names=["path", "pos", "end_line"])

    return rows.repartition("path").sortWithinPartitions("path", "pos").select("path", "pos", "line", "indent", "declared", "ended").mapInArrow(run, "path string, pos int, end_line int")


def declarations(files: DataFrame, toks: DataFrame, opened: DataFrame) -> DataFrame:
    """(path, pos, kind, name, start_line, end_line, signature, chunk) of what code declares.

    Functions, classes and interfaces follow their word; methods are names with
    brackets and a body in TypeScript and JavaScript, and with a type in Java,
    where a body is not needed. A body is a pair of braces, or in Python what
    is indented further. A chunk has the first 41 lines, 4000 signs at most.
    """
    word = F.when(F.col("prev") == "*", F.col("prev2")).otherwise(F.col("prev"))
    python, ts, java = (F.col("lang") == x for x in ("python", "ts", "java"))
    kind = (
        F.when(python & (word == "def"), "Function").when(ts & (word == "function"), "Function").when((word == "class") & ~F.col("tok").isin("extends", "implements"), "Class").when(~python & (word == "interface"), "Interface")
    )
    worded = toks.filter(F.col("tok").rlike(_NAME)).withColumn("kind", kind).filter("kind is not null").select("path", "pos", "lang", "level", "kind", F.col("tok").alias("name"), F.col("prev_line").alias("start_line"))
    fit = F.col("prev").rlike(_NAME) & ~F.col("prev").isin(*CONTROL) & ~F.coalesce(F.col("prev2").isin(*_NOT_DECLARED), F.lit(False))
    begins = F.coalesce(F.col("prev2").isin(*_MODIFIERS), F.lit(True)) | (F.col("prev2_line") < F.col("prev_line"))
    typed = F.col("prev2").rlike(r"^[A-Za-z_$>\]]") & ~F.col("prev2").isin(*CONTROL)
    method = F.when(ts, (F.col("after") == "{") | ((F.col("after") == ":") & begins)).when(java, F.col("after").isin("{", "throws") | ((F.col("after") == ";") & typed))
    names = opened.filter("tok = '('").filter(fit & ~python)
    methods = names.filter(F.coalesce(method, F.lit(False))).select("path", "pos", "lang", "level", F.lit("Method").alias("kind"), F.col("prev").alias("name"), F.col("prev_line").alias("start_line"))
    all_ = settled(worded.union(methods))
    braced = _bodies(all_.filter("lang <> 'python'").select("path", "pos", "level", "kind"), toks, opened).select("path", "pos", "end_line")
    texts = files.select("path", F.split("content", "\r?\n").alias("all"))
    begin = toks.filter((F.col("lang") == "python") & (F.col("prev_line").isNull() | (F.col("prev_line") < F.col("line")))).filter("level = 0 and tok not in (')', ']', '}')")
    lines = texts.select("path", F.posexplode(F.transform("all", lambda x: F.length(F.regexp_extract(x, r"^(\s*)", 1)))).alias("line", "indent")).withColumn("line", F.col("line") + 1)
    begin = begin.select("path", "pos", "line", "prev_line").join(lines, ["path", "line"])
    own = all_.filter("lang = 'python'").groupBy("path", F.col("start_line").alias("line")).agg(F.min("pos").alias("of"))
    begin = begin.join(own, ["path", "line"], "left")
    indented = _indented_ends(begin.select("path", F.coalesce("of", "pos").cast("int").alias("pos"), "line", "indent", F.col("of").isNotNull().alias("declared"), F.col("prev_line").alias("ended")))
    last = toks.groupBy("path").agg(F.max("line").alias("last_line"))
    ended = all_.join(braced.union(indented), ["path", "pos"], "left").join(last, "path")
    ended = ended.filter((F.col("lang") != "ts") | F.col("end_line").isNotNull())  # a signature alone declares nothing there
    ended = ended.withColumn("end_line", F.when(F.col("lang") == "python", F.coalesce("end_line", "last_line")).otherwise(F.least(F.coalesce("end_line", "start_line"), "last_line"))).withColumn("end_line", F.greatest("end_line", "start_line"))
    per_file = ended.groupBy("path").agg(F.collect_list(F.struct("pos", "kind", "name", "start_line", "end_line")).alias("defs")).join(texts, "path")
    cut = lambda d, n: F.array_join(F.slice("all", d["start_line"], n), "\n")
    told = F.transform("defs", lambda d: F.struct(d.alias("d"), F.substring(trimmed(cut(d, F.lit(1))), 1, 200).alias("signature"), F.substring(trimmed(cut(d, F.least(d["end_line"] - d["start_line"] + 1, F.lit(41)))), 1, 4000).alias("chunk")))
    return per_file.select("path", F.explode(told).alias("t")).select("path", "t.d.*", "t.signature", "t.chunk")


def calls(opened: DataFrame) -> DataFrame:
    """(path, pos, line, callee) of calls; pos is the bracket's. What a word declares, and what `new` makes, is none."""
    made = F.coalesce(F.col("prev2").isin("new", "function", "def", "class", "interface"), F.lit(False)) | ((F.col("prev2") == "*") & (F.col("lang") == "ts"))
    fit = (F.col("tok") == "(") & F.col("prev").rlike(_NAME) & ~F.col("prev").isin(*CONTROL) & ~F.coalesce(made, F.lit(False))
    return opened.filter(fit).select("path", "pos", F.col("prev_line").alias("line"), F.col("prev").alias("callee"))


def strings(toks: DataFrame) -> DataFrame:
    """(path, pos, line, level, text, prev, next) of string literals, text without its first and last quote."""
    return toks.filter(F.col("tok").rlike(_STRING)).select("path", "pos", "line", "level", F.col("tok").alias("literal"), F.regexp_replace("tok", "^[\"'`]|[\"'`]$", "").alias("text"), "prev", "next")


def string_arguments(called: DataFrame, toks: DataFrame, opened: DataFrame) -> DataFrame:
    """called (path, pos, line, callee) with each string that is an argument by itself: arg, and its number among them, n."""
    args = strings(toks).filter(F.col("prev").isin("(", ",") & F.col("next").isin(")", ",")).select("path", "pos", (F.col("level") - 1).alias("level"), F.col("text").alias("arg"))
    rows = opened.select("path", "pos", "level", F.col("pos").alias("home")).unionByName(args, allowMissingColumns=True)
    inside = Window.partitionBy("path", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("home", F.last("home", ignorenulls=True).over(inside)).filter("arg is not null")
    held = held.withColumn("n", F.row_number().over(Window.partitionBy("path", "home").orderBy("pos"))).select("path", F.col("home").alias("pos"), "arg", "n")
    return called.join(held, ["path", "pos"])


def imports(toks: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, line, text, mod): what an import statement names. texts are lines (path, line, text).

    In TypeScript and JavaScript that is the first string after the word,
    however many lines down; in Python and Java the first dotted name.
    """
    first = F.col("prev_line").isNull() | (F.col("prev_line") < F.col("line")) | (F.col("prev") == ";")
    marks = toks.filter((F.col("tok").isin("import", "from") & first & (F.col("level") == 0)) | F.col("tok").rlike(_STRING))
    word = F.col("tok").isin("import", "from")
    ahead = Window.partitionBy("path").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("string", F.last(F.when(~word, F.col("tok")), ignorenulls=True).over(ahead)).filter(word)
    found = marks.join(texts, ["path", "line"])
    named = F.coalesce(
        F.nullif(F.regexp_extract("text", r"^\s*from\s+\.*\s*([A-Za-z_][\w.]*)\s+import\b", 1), F.lit("")), F.nullif(F.regexp_extract("text", r"^\s*from\s+\.+\s*import\s+([A-Za-z_][\w.]*)", 1), F.lit("")),
        F.nullif(F.regexp_extract("text", r"^\s*import\s+(?:static\s+)?([A-Za-z_$]\w*(?:\.[A-Za-z_$]\w*)*)", 1), F.lit("")),
    )
    quoted = F.when((F.col("tok") == "import") & ~F.coalesce(F.col("next").isin("(", "."), F.lit(False)), F.regexp_replace("string", "^[\"'`]|[\"'`]$", ""))
    return found.withColumn("mod", F.when(F.col("lang") == "ts", quoted).otherwise(named)).filter("mod is not null and mod <> ''").select("path", "line", "text", "mod")


def implements(toks: DataFrame) -> DataFrame:
    """(path, line, class, interface): names between a class's `implements` and its body, of a dotted name the last part."""
    flat = Window.partitionBy("path", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    name = (F.col("prev") == "class") & F.col("tok").rlike(_NAME)
    mark = F.when(name | F.col("tok").isin("implements", "{", ";"), F.col("tok"))
    told = toks.filter("lang <> 'python'").withColumn("mark", F.last(mark, ignorenulls=True).over(flat)).withColumn("of", F.last(F.when(name, F.struct(F.col("tok").alias("class"), F.col("prev_line").alias("line"))), ignorenulls=True).over(flat))
    fit = (F.col("mark") == "implements") & F.col("tok").rlike(_NAME) & (F.col("next") != ".") & (F.col("prev") != "<")
    return told.filter(fit & F.col("of").isNotNull()).select("path", F.col("of.line").alias("line"), F.col("of.class").alias("class"), F.col("tok").alias("interface"))
