"""Target-distribution importance resampling over hashed n-grams, by CRC combination algebra.

A feature is a run of words joined by one space, its bucket the CRC-32 of these
bytes. The CRC of a word is computed once and kept; that of a longer run follows
from its words' CRCs alone: appending bytes to a text shifts its CRC by their
number, which is a matrix over GF(2), and adds theirs. No n-gram is ever
written out as a string.

Two passes over the texts: the first counts each bucket's features, one row of
counts a task; the second adds up each document's gains. Ranks come from sorted
ranges and their sizes, so no task sees more than a range.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, cut, freed

#: Words in a feature at most, buckets, words that a drawn document needs, percent of these that are drawn, and the seed of the draw.
WIDTH, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Words whose CRC a task remembers, and the longest of them in bytes.
WORDS, WORD_BYTES = 200_000, 40
#: Words of a text that are hashed in one go.
RUN = 1 << 18
#: Bytes of text that are turned to Python objects at once, unless a single text is longer.
SLICE = 8 << 20
#: The CRC's polynomial, bits reversed (fixed value).
POLYNOMIAL = 0xEDB88320

# letters and digits as they are, capitals folded, bytes beyond ASCII kept: all else ends a word
_FOLD = bytes(b if b >= 128 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 32 for b in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


@lru_cache(maxsize=1)
def _shifts() -> list[np.ndarray]:
    """For 2^k appended zero bytes, k = 0 to 31: what each byte of a CRC contributes, 4 x 256 numbers."""

    def apply(columns: list[int], x: int) -> int:
        out = 0
        for i in range(32):
            if x >> i & 1:
                out ^= columns[i]
        return out

    def zero_bit(x: int) -> int:
        return (x >> 1) ^ (POLYNOMIAL if x & 1 else 0)

    columns = [1 << i for i in range(32)]
    for _ in range(8):
        columns = [zero_bit(c) for c in columns]
    out = []
    for _ in range(32):
        out.append(np.array([[apply(columns, b << (8 * part)) for b in range(256)] for part in range(4)], np.uint32))
        columns = [apply(columns, c) for c in columns]
    return out


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs as n appended bytes shift them: the product of the matrices of n's binary digits."""
    crc, n = crc.astype(np.uint32), n.astype(np.int64)
    for k in range(int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero(n >> k & 1)
        x, t = crc[at], _shifts()[k]
        crc[at] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
    return crc


def combined(crc: np.ndarray, size: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The CRCs of all runs of 1 to `width` words, from the words' CRCs and sizes in bytes."""
    yield crc
    if width == 1 or len(crc) < 2:
        return
    space = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    spaced = shifted(space, size) ^ crc
    run = crc
    for k in range(1, min(width, len(crc))):
        run = shifted(run[:-1], size[k:] + 1) ^ spaced[k:]
        yield run


class _Crcs(dict):
    """CRCs of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        h = zlib.crc32(word)
        if len(word) <= WORD_BYTES:
            if len(self) >= WORDS:
                self.clear()
            self[word] = h
        return h


@lru_cache(maxsize=1)
def _crcs() -> _Crcs:
    return _Crcs()


def features(raw: bytes | None, width: int) -> tuple[int, Iterator[np.ndarray]]:
    """The number of a text's words, and the CRCs of its features, part by part; a part overlaps the next by width - 1 words."""
    listed = words(raw or b"")

    def parts() -> Iterator[np.ndarray]:
        known = _crcs().__getitem__
        for lo in range(0, len(listed), RUN):
            near = listed[lo : lo + RUN + width - 1]
            crc = np.fromiter(map(known, near), np.uint32, len(near))
            size = np.fromiter(map(len, near), np.int64, len(near)) if width > 1 else crc
            for run in combined(crc, size, width):
                yield run[: min(RUN, len(listed) - lo)]

    return len(listed), parts()


def _texts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for batch in batches:
        for rows in by_bytes(batch, at, SLICE):
            yield rows, rows.column(at).cast(pa.binary()).to_pylist()


def bucket_counts(docs: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for _, texts in _texts(batches, 0):
            for raw in texts:
                for part in features(raw, width)[1]:
                    n += np.bincount(part % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["bucket", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(freed(run, _crcs().clear), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain, 1000 log-odds of the target over the documents with one feature added to each bucket. At most `buckets` rows of each side reach the driver."""
    both = []
    for side in (docs, target):
        n = [0] * buckets
        for at, c in bucket_counts(side, width, buckets).collect():
            n[at] = c
        both.append(n)
    s, t = both
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log((y + 1) * all_s / ((x + 1) * all_t))) for x, y in zip(s, t, strict=True)]


def resample(docs: DataFrame, target: DataFrame, width: int = WIDTH, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank.

    weight is the floored mean gain of the document's features, score adds
    Gumbel noise that seed and doc_id decide, and the highest scores among the
    documents of enough words, `percent` of these, are drawn: rank is 1, 2, 3 and
    so on, null for all others. Ties go to the smaller doc_id, a null one last.
    Null, empty and wordless texts have no features, weight 0, and are never
    drawn if a word is asked for. Repeated rows are drawn one by one. An empty
    table gives no rows, an empty target adds no counts; other columns are
    ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = docs.sparkSession.sparkContext.broadcast(np.array(gains(docs, target, width, buckets), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _texts(batches, 1):
            n_words, n, weight = [], [], []
            for raw in texts:
                count, parts = features(raw, width)
                total = size = 0
                for part in parts:
                    total += int(gain.value[part % np.uint32(buckets)].sum())
                    size += len(part)
                n_words.append(count)
                n.append(size)
                weight.append(total // size if size else 0)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, pa.int64()) for c in (n_words, n, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    weighed = docs.mapInArrow(freed(run, _crcs().clear), "doc_id long, n_words long, n_features long, weight long")
    scored = cut(weighed.withColumn("score", F.col("weight") + noise).withColumn("uid", F.monotonically_increasing_id()))
    return _ranked(scored, least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


def _ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """Rows (doc_id, n_words, score, uid and others) with rank.

    Scores are whole numbers between about -80000 and 100000, as logarithms of
    counts are, so their counts, which tell the last score that is drawn, fit
    the driver whatever the corpus. Rows from that score on are sorted in
    ranges, and a range's first rank follows from the sizes of those before it.
    """
    fit = scored.filter(F.col("n_words") >= least_words)
    by_score = sorted(fit.groupBy("score").count().collect(), reverse=True)
    want = percent * sum(n for _, n in by_score) // 100
    if not want:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    got, last = 0, 0
    for last, n in by_score:
        got += n
        if got >= want:
            break
    high = (F.col("n_words") >= least_words) & (F.col("score") >= last)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("uid"))
    placed = cut(scored.filter(high).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))  # a row for each range
    rank = F.col("_shift") + F.col("_in") + 1
    top = placed.withColumn("_part", part).withColumn("_in", inside).join(F.broadcast(shift), "_part").select(*scored.columns, F.when(rank <= want, rank).alias("rank"))
    return top.unionByName(scored.filter(~high).withColumn("rank", F.lit(None).cast("long")))


#: The same rows in DuckDB: CRCs of the distinct words, bit by bit.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS word FROM w),
c AS (SELECT word, list_transform(range(0, CAST(octet_length(encode(word)) AS BIGINT)), lambda i: CAST('0x' || hex(encode(word))[2 * i + 1:2 * i + 2] AS BIGINT)) AS bytes FROM (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM b))),
h AS (SELECT word, xor(4294967295, list_reduce(bytes, lambda a, x: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(a, x)), 4294967295)) % 10000 AS bucket FROM c),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN h USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM b JOIN h USING (word) GROUP BY bucket),
g AS (SELECT x.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT sum(n) FROM s) + 10000) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS BIGINT) AS gain FROM (SELECT DISTINCT bucket FROM h) x LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM dw JOIN h USING (word) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT w.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || w.doc_id), 1, 8) AS BIGINT) AS u FROM w LEFT JOIN m USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM r),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= 20)
SELECT z.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM k) THEN rank END AS rank FROM z LEFT JOIN k USING (doc_id)
"""
