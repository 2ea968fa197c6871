"""Language identification by a convolutional network over bytes.

The network has filters of three widths over one-hot bytes, takes each filter's
maximum over a window of fixed length, and ends in a softmax layer. It is
trained with numpy on a bounded sample of labelled texts and then applied to
every window of every text. Since a filter over one-hot bytes is a sum of table
rows, inference looks byte pairs up instead of multiplying.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import unit_hash

#: Bytes in a window, filters of each width, and the widths.
LENGTH, FILTERS, WIDTHS = 256, 12, (2, 3, 4)
#: Labelled texts of each language that training may use, and bytes of each.
SAMPLE, SAMPLE_BYTES = 1200, 1024
EPOCHS, BATCH, RATE = 14, 64, 0.01
#: Texts' bytes handled in one go.
BLOCK = 1 << 20

_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character of the letter categories stands in the text; number signs such as ½ are none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


@dataclass
class Network:
    """Languages, one table (width, 256, filters) for each width, and the last layer."""

    langs: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def paired(self) -> list[list[tuple[int, bool, np.ndarray]]]:
        """For each width, what to add up: an offset, whether it is a pair, and the table's rows."""
        got = []
        for t in self.tables:
            parts = []
            for k in range(0, len(t) - 1, 2):
                parts.append((k, True, np.ascontiguousarray((t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1))))
            if len(t) % 2:
                parts.append((len(t) - 1, False, np.ascontiguousarray(t[-1])))
            got.append(parts)
        return got


def as_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def _forward(net: Network, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pooled features of windows (n, LENGTH), and where each maximum lies."""
    feats, where = [], []
    for t in net.tables:
        w = len(t)
        s = t[0][x[:, : x.shape[1] - w + 1]]
        for k in range(1, w):
            s += t[k][x[:, k : x.shape[1] - w + 1 + k]]
        at = s.argmax(axis=1)
        where.append(at)
        feats.append(np.take_along_axis(s, at[:, None, :], 1)[:, 0])
    return np.maximum(np.concatenate(feats, 1) + net.bias, 0), where


def train(texts: list[str], labels: list[str], seed: int = 7) -> Network:
    """Fit the network with Adam on windows cut from the texts.

    The rows are ordered first, so that the same sample gives the same network.
    """
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    xs, ys = [], []
    for text, lang in sorted(zip(texts, labels, strict=True)):
        raw = as_bytes(text)[:SAMPLE_BYTES]
        for i in range(0, max(1, len(raw) - LENGTH // 4), LENGTH):
            part = raw[i : i + LENGTH]
            if has_letter(part.decode("utf-8", "ignore")):
                xs.append(np.frombuffer(part.ljust(LENGTH, b"\0"), np.uint8))
                ys.append(langs.index(lang))
    f = len(WIDTHS) * FILTERS
    net = Network(langs, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(f, np.float32), rng.normal(0, 0.3, (f, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    for t in net.tables:
        t[:, 0] = 0  # the byte that fills short windows
    if len(langs) < 2 or not xs:
        return net
    x, y = np.stack(xs), np.array(ys)
    share = np.bincount(y, minlength=len(langs)) / len(y)
    weigh = (1 / np.maximum(share, 1e-3) / len(langs))[y].astype(np.float32)
    params = [*net.tables, net.bias, net.out, net.out_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        rate = RATE * (1 - epoch / EPOCHS)
        for s in range(0, len(order), BATCH):
            i = order[s : s + BATCH]
            b = x[i].copy()
            short = rng.random(len(i)) < 0.3  # windows of short texts
            for r in np.flatnonzero(short):
                b[r, rng.integers(12, LENGTH) :] = 0
            feats, where = _forward(net, b)
            logit = feats @ net.out + net.out_bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(i)), y[i]] -= 1
            p *= (weigh[i] / len(i))[:, None]
            back = (p @ net.out.T) * (feats > 0)
            grads: list[np.ndarray] = []
            for k, t in enumerate(net.tables):
                g, own = np.zeros_like(t), back[:, k * FILTERS : (k + 1) * FILTERS]
                rows, cols = np.arange(len(i))[:, None], np.arange(FILTERS)[None, :]
                for d in range(len(t)):
                    np.add.at(g[d], (b[rows, where[k] + d], np.broadcast_to(cols, where[k].shape)), own)
                g[:, 0] = 0
                grads.append(g)
            grads += [back.sum(0), feats.T @ p, p.sum(0)]
            step += 1
            for q, g, a, c in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                c += 0.001 * (g * g - c)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
    return net


class Reader:
    """Applies a network to texts, a block of windows at a time."""

    def __init__(self, net: Network) -> None:
        self.net, self.parts = net, net.paired()

    def _windows(self, flat: np.ndarray) -> np.ndarray:
        """Log-probabilities of each window of a flat run of whole windows."""
        n = len(flat) // LENGTH
        pairs = flat[:-1].astype(np.intp)
        pairs <<= 8
        pairs |= flat[1:]
        feats = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        step = 128  # windows at once: their responses stay in the cache
        for a in range(0, n, step):
            z = min(n, a + step)
            for k, (w, parts) in enumerate(zip(WIDTHS, self.parts, strict=True)):
                s: np.ndarray | None = None
                lo, size = a * LENGTH, (z - a) * LENGTH
                for d, pair, rows in parts:
                    at = (pairs if pair else flat)[lo + d : lo + d + size]
                    if len(at) < size:  # the last window's end: those responses aren't used
                        at = np.concatenate([at, np.zeros(size - len(at), at.dtype)])
                    got = rows.take(at, axis=0)
                    s = got if s is None else np.add(s, got, out=s)
                feats[a:z, k * FILTERS : (k + 1) * FILTERS] = s.reshape(z - a, LENGTH, FILTERS)[:, : LENGTH - w + 1].max(1)
        logit = np.maximum(feats + self.net.bias, 0) @ self.net.out + self.net.out_bias
        logit -= logit.max(1, keepdims=True)
        return logit - np.log(np.exp(logit).sum(1, keepdims=True))

    def read(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and its probability for each text; `und` and 0 without letters."""
        total = np.zeros((len(texts), len(self.net.langs)))
        weight = np.zeros(len(texts))
        blocks, owner, sizes, held = [], [], [], 0

        def flush() -> None:
            nonlocal held
            if blocks:
                flat = np.frombuffer(b"".join(blocks), np.uint8)
                got, size = self._windows(flat), np.array(sizes, float)
                np.add.at(total, owner, got * size[:, None])
                np.add.at(weight, owner, size)
            blocks.clear()
            owner.clear()
            sizes.clear()
            held = 0

        for i, text in enumerate(texts):
            if not text or not has_letter(text):
                continue
            raw = as_bytes(text)
            for lo in range(0, len(raw), BLOCK):
                part = raw[lo : lo + BLOCK]
                n = -(-len(part) // LENGTH)
                blocks.append(part.ljust(n * LENGTH, b"\0"))
                owner += [i] * n
                sizes += [LENGTH] * (n - 1) + [len(part) - LENGTH * (n - 1)]
                held += n * LENGTH
                if held >= BLOCK:
                    flush()
        flush()
        mean = total / np.maximum(weight, 1)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True)) if mean.size else mean
        p = p / p.sum(1, keepdims=True) if mean.size else p
        best = p.argmax(1) if mean.size else np.zeros(len(texts), int)
        langs = [self.net.langs[b] if w else "und" for b, w in zip(best, weight, strict=True)]
        return langs, [float(p[i, b]) if weight[i] else 0.0 for i, b in enumerate(best)]


def fit(docs: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> Network | None:
    """Train on about `sample` labelled texts of each language; None without any.

    Rows whose label is null, or for which `usable` doesn't hold, are never
    looked at. Which rows are in the sample depends on a hash of the text, so
    no source and no run of ids decides it.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (usable if usable is not None else F.lit(True)))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, sample / n).otherwise(share)
    order = unit_hash(F.substring("text", 1, 200), 11)
    parts = lambda df: df.select(F.substring("text", 1, SAMPLE_BYTES).alias("text"), F.col("lang").cast("string"), order.alias("h")).dropDuplicates().orderBy("h", "lang", "text")
    rows = parts(known.filter(order < share)).limit(4 * sample * max(1, len(counts))).collect() or parts(known).limit(sample).collect()
    return train([r[0] for r in rows], [r[1] for r in rows]) if rows else None


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Add lang_pred and score to every row, from the row's whole text alone.

    A null text, an empty one and one without letters get `und` and 0, and so
    does every text without a network. Repeated rows get the same answer each.
    Columns named lang_pred or score are replaced; all others stay.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value) if shared.value is not None else None
        for rows in batches:
            lang, score = [], []
            for lo in range(0, rows.num_rows, 512):
                texts = rows.column(at).slice(lo, 512).to_pylist()
                got = reader.read(texts) if reader else (["und"] * len(texts), [0.0] * len(texts))
                lang += got[0]
                score += got[1]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*rows.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """Train on the labelled rows of docs and add lang_pred and score to all rows."""
    return predict(docs, fit(docs, usable, sample))
