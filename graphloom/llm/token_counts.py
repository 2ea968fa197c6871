"""Token counts without token ids.

Each distinct pre-token of the corpus is given to the tokenizer once; its
number of pieces joins the documents' pre-token frequencies, and their products
are summed per document. A bounded number of the most frequent pre-tokens is
broadcast, which keeps hot words out of the shuffle; all others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, freed
from .wordbpe import splits_on_space, tokenizer

#: Pre-tokens in the broadcast dictionary, and the longest of them in signs:
#: at most a few MB, however large the corpus.
HOT, HOT_CHARS = 120_000, 40
#: Chunks that a task remembers.
REMEMBERED = 250_000
#: Distinct pre-tokens that a task gathers before it hands them on.
FLUSH = 250_000


def vocabulary(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Every distinct pre-token with its number of documents' uses and of pieces.

    Each pre-token is tokenised once, after the partial counts have met.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)

        def handed(seen: Counter) -> pa.RecordBatch:
            pre: Counter = Counter()
            for chunk, n in seen.items():
                for p in tok.pre_tokens(chunk):
                    pre[p] += n
            return pa.RecordBatch.from_arrays([pa.array(pre.keys(), pa.string()), pa.array(pre.values(), pa.int64())], names=["pre", "uses"])

        seen: Counter = Counter()
        for rows in batches:
            for text in rows.column(0):
                seen.update(tok.chunks(text.as_py() or ""))
                if len(seen) >= FLUSH:
                    yield handed(seen)
                    seen = Counter()
        if seen:
            yield handed(seen)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        for rows in batches:
            n = [len(tok.encode_pre(p)) // 4 for p in rows.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n, pa.int32())], names=["pre", "uses", "pieces"])

    free = lambda: tokenizer(tokenizer_path).forget()
    parts = docs.select(F.col("text").cast("string")).mapInArrow(freed(gather, free), "pre string, uses long")
    return parts.groupBy("pre").agg(F.sum("uses").alias("uses")).mapInArrow(freed(pieces, free), "pre string, uses long, pieces int")


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 bytes and tokens. Repeated rows and ids are
    counted one by one. An empty table gives no rows; other columns are
    ignored. Special strings inside a text count as the library's default has
    it, one token each. Tokenizers whose pre-tokens depend on white space are
    refused: their chunks can't be counted apart.
    """
    if not splits_on_space(tokenizer_path):
        raise ValueError("count_tokens needs a tokenizer that drops white space")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = cut(vocabulary(docs, tokenizer_path))
    top = words.filter(F.length("pre") <= HOT_CHARS).orderBy(F.desc("uses"), "pre").limit(hot).select("pre", "pieces")
    known = {r[0]: r[1] for r in top.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with what the hot pre-tokens add up to, and one for each other pre-token of it."""
        tok, count = tokenizer(tokenizer_path), shared.value
        base, seen = TaskContext.get().partitionId() << 40, 0
        cache: dict[bytes, int | tuple[int, tuple[str, ...]]] = {}

        def look(chunk: bytes) -> int | tuple[int, tuple[str, ...]]:
            total, rare = 0, []
            for p in tok.pre_tokens(chunk):
                n = count.get(p)
                if n is None:
                    rare.append(p)
                else:
                    total += n
            got = (total, tuple(rare)) if rare else total
            if len(chunk) <= HOT_CHARS:
                if len(cache) >= REMEMBERED:
                    cache.clear()
                cache[chunk] = got
            return got

        for rows in batches:
            uid, ids, size, hot_sum, pre, freq = [], [], [], [], [], []
            for doc, cell in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                text, total, rare = cell.as_py() or "", 0, []
                for chunk in tok.chunks(text):
                    got = cache.get(chunk)
                    if got is None:
                        got = look(chunk)
                    if got.__class__ is int:
                        total += got
                    else:
                        total += got[0]
                        rare += got[1]
                me = base + seen
                seen += 1
                for p, n in Counter(rare).items():
                    uid.append(me)
                    ids.append(None)
                    size.append(0)
                    hot_sum.append(0)
                    pre.append(p)
                    freq.append(n)
                uid.append(me)
                ids.append(doc)
                size.append(len(text.encode("utf-8", "replace")))
                hot_sum.append(total)
                pre.append(f" {me}")  # no pre-token has a space: joins nothing, and no two rows share it
                freq.append(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid, pa.int64()), pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(hot_sum, pa.int64()), pa.array(pre, pa.string()), pa.array(freq, pa.int64())],
                names=["uid", "doc_id", "n_bytes", "n", "pre", "freq"],
            )

    rows = docs.mapInArrow(freed(frequencies, lambda: None), "uid long, doc_id long, n_bytes long, n long, pre string, freq long")
    joined = rows.join(words.select("pre", "pieces"), "pre", "left")
    per_doc = joined.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("n") + F.col("freq") * F.coalesce("pieces", F.lit(0))).alias("n_tokens"))
    return per_doc.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
