"""Quality rules by distribution divergence from language references.

Every language has two references, counted over all labelled documents of the
corpus: a histogram of classes of bytes, and one of its common words (those
with at least a fixed share of its words, so at most 1 / SHARE of them; very long
ones stand there by their hashes). A
document is held against each language's pair by the Jensen-Shannon distance
and takes the nearest. A language whose documents are too few for a reference
is not judged by the others' references: its documents pass this rule. Short
texts scatter by chance, so that each comparison has its own least length. Two
base rules come first: too few words, or too many
words in three-word windows that repeat.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, freed

#: Base rules: words at least, and the largest percentage of words in repeated three-word windows.
LEAST_WORDS, REPEAT_PERCENT = 50, 50
#: A word with at least this share of a language's words is common; one of more bytes is counted by its hash.
SHARE, WORD_BYTES = 0.002, 64
#: Largest distances to the nearest reference, for n words a limit of far + short / sqrt(n), since short
#: texts scatter; and the least bytes and words for which the distances are asked.
CHAR_FAR, CHAR_SHORT = 0.27, 0.3
WORD_FAR, WORD_SHORT = 0.32, 1.0
LEAST_CHARS, LEAST_COMMON = 200, 75
#: Languages need so many labelled documents and words to become a reference.
LANGUAGE_DOCS, LANGUAGE_WORDS = 10, 2000
#: Distinct words that a task gathers before it hands them on.
FLUSH = 250_000

_SYMBOLS = b"#*$%&|<>"
#: Classes of bytes: small and capital letters, bytes of other letters, digits,
#: spaces, line ends, marks of sentences, symbols, and the rest.
CLASSES = 9


def _class_table() -> np.ndarray:
    table = np.full(256, 8, np.int64)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(128, 256)), b"0123456789", b" ", b"\n", b".,;:?'\"()-", b"#*$%&|<>!_=+^~{}[]\\/@`")):
        table[list(chars)] = k
    return table


_CLASS = _class_table()


def char_histogram(raw: bytes) -> np.ndarray:
    """How often each class occurs."""
    return np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=CLASSES)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of rows of p from q; 0 to 1."""
    p = p / np.maximum(p.sum(-1, keepdims=True), 1e-12)
    q = q / np.maximum(q.sum(-1, keepdims=True), 1e-12)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def repeated(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    if v < 2_000_000:  # three ids then fit one number
        key = (at[:-2] * v + at[1:-1]) * v + at[2:]
    else:
        pair = np.unique(at[:-2] * v + at[1:-1], return_inverse=True)[1]
        key = pair * v + at[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    for d in range(3):
        cover[d : n - 2 + d] |= twice
    return int(cover.sum())


def measures(text: str | None) -> tuple[bytes, list[bytes], tuple[int, int, int, int, int]]:
    """The text's bytes and words, and n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return raw, words, (0, 0, sum(map(raw.count, (bytes((b,)) for b in _SYMBOLS))), 0, 0)
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    duplicates = 0
    if b"\n" in raw:
        lines = Counter(raw.split(b"\n"))
        duplicates = sum(n - 1 for line, n in lines.items() if n > 1 and line.split())
    symbols = sum(raw.count(b) for b in _SYMBOLS)
    return raw, words, (len(words), len(text) - spaces, symbols, duplicates, repeated(words))


def common_form(word: bytes) -> bytes:
    """A word as the histograms of common words know it."""
    word = word.lower().strip(b".,;:?!'\"()")
    return word if len(word) <= WORD_BYTES else xxhash.xxh3_128_hexdigest(word).encode()


@dataclass
class Reference:
    """A language's histogram of classes, its common words' places, and their histogram with all other words at the end."""

    lang: str
    chars: np.ndarray
    places: dict[bytes, int]
    words: np.ndarray


def references(docs: DataFrame, share: float = SHARE) -> list[Reference]:
    """The references of all languages, counted over every labelled document.

    At most 1 / share common words a language come to the driver, however large
    the corpus. Where no language has enough documents, those without a label
    are one reference.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        chars: dict[str, np.ndarray] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            keys, n = [], []
            for (lang, w), k in words.items():
                keys.append((lang, "w" + w.decode("utf-8", "replace")))
                n.append(k)
            for lang, h in chars.items():
                keys += [(lang, f"c{i}") for i in range(CLASSES + 2)]
                n += h.astype(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(n, pa.int64())], names=["lang", "item", "n"])
            words.clear()
            chars.clear()

        for rows in batches:
            for text, lang in zip(rows.column(0), rows.column(1).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                found = raw.lower().split()
                own = chars.setdefault(lang, np.zeros(CLASSES + 2))
                own[:CLASSES] += char_histogram(raw)
                own[CLASSES] += len(found)
                own[CLASSES + 1] += 1
                for w, k in Counter(found).items():
                    if w := common_form(w):
                        words[lang, w] += k
                if len(words) >= FLUSH:
                    yield from handed()
        if words or chars:
            yield from handed()

    parts = docs.select(F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    totals = parts.mapInArrow(freed(count, lambda: None), "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    totals = cut(totals)
    of = lambda i: F.sum(F.when(F.col("item") == f"c{i}", F.col("n")))
    sizes = totals.groupBy("lang").agg(of(CLASSES).alias("words"), of(CLASSES + 1).alias("docs"))
    found = [r[0] for r in sizes.filter((F.col("lang") == "") | (F.col("docs") >= LANGUAGE_DOCS) & (F.col("words") >= LANGUAGE_WORDS)).select("lang").collect()]
    langs = [lang for lang in found if lang] or found
    if not langs:
        return []
    count_of = totals.filter(F.col("lang").isin(langs))
    whole = count_of.filter(F.col("item") == f"c{CLASSES}").select("lang", F.col("n").alias("whole"))
    kept = count_of.join(F.broadcast(whole), "lang").filter(F.col("item").startswith("c") | (F.col("n") >= share * F.col("whole"))).select("lang", "item", "n").collect()
    out = []
    items: dict[str, dict[str, int]] = {lang: {} for lang in sorted(langs)}
    for lang, item, n in kept:
        items[lang][item] = n
    for lang, own in items.items():
        common = sorted((k for k in own if k[0] == "w"), key=lambda k: (-own[k], k))
        counts = [own[k] for k in common]
        out.append(Reference(lang, np.array([own.get(f"c{i}", 0) for i in range(CLASSES)], float), {k[1:].encode(): i for i, k in enumerate(common)}, np.array([*counts, max(0, own.get(f"c{CLASSES}", 0) - sum(counts))], float)))
    return out


def distances(raw: bytes, words: list[bytes], refs: list[Reference]) -> tuple[float, float]:
    """Distances of classes and of common words to the reference whose sum is the least; 0 below the least lengths."""
    if not refs:
        return 0.0, 0.0
    chars = distance(char_histogram(raw)[None, :], np.stack([r.chars for r in refs])) if len(raw) >= LEAST_CHARS else np.zeros(len(refs))
    far = np.zeros(len(refs))
    if len(words) >= LEAST_COMMON:
        counts = Counter(words)
        forms: Counter = Counter()
        for w, n in counts.items():
            forms[common_form(w)] += n
        for k, r in enumerate(refs):
            h = np.zeros(len(r.words))
            for w, n in forms.items():
                i = r.places.get(w)
                if i is not None:
                    h[i] += n
            h[-1] = len(words) - h.sum()
            far[k] = distance(h, r.words)
    best = int((chars + far).argmin())
    return float(chars[best]), float(far[best])


def near(n_words: int, char: float, word: float) -> bool:
    """Whether both distances are within their limits for a text of so many words."""
    scatter = max(1, n_words) ** -0.5
    return char <= CHAR_FAR + CHAR_SHORT * scatter and word <= WORD_FAR + WORD_SHORT * scatter


def judge(docs: DataFrame, refs: list[Reference] | None = None) -> DataFrame:
    """One row per document: the base rules' measures, distances and the verdict.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, char_distance, word_distance. Documents
    labelled with a language that has no reference are kept whatever their
    distances; those without a label are held against all references. A null
    text has no words and fails, as an empty one does. Repeated rows are judged
    alike, each for itself. An empty table gives no rows; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(references(docs) if refs is None else refs)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held = {"", None, *(r.lang for r in known)}
        for rows in batches:
            out = []
            for doc, cell, lang in zip(rows.column(0).to_pylist(), rows.column(1), rows.column(2).to_pylist(), strict=True):
                raw, words, m = measures(cell.as_py())
                failed = m[0] < LEAST_WORDS or 100 * m[4] > REPEAT_PERCENT * m[0]
                char, word = distances(raw, words, known)
                out.append((doc, *m, failed, not failed and (lang not in held or near(m[0], char, word)), char, word))
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 10, kinds, strict=True)], names=list(names))

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang")).mapInArrow(run, ", ".join(f"{n} {'boolean' if n in ('base_failed', 'kept') else 'double' if n.endswith('distance') else 'long'}" for n in names))
