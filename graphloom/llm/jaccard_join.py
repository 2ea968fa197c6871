"""Exact n-gram Jaccard join by parity sketches, and its connected components.

Two sets link when their Jaccard similarity is at least num / den. That bounds
their symmetric difference: at most d elements, where d follows from the sizes.

* The space of shingle hashes is cut into k blocks, and a block's parity sketch
  is the XOR of the hashes in it. With k = d + 1 + spare blocks, at least
  1 + spare blocks of a linked pair hold the same elements, so their sketches
  are equal (pigeonhole). Each size band has its own k.
* Blocks with few elements, or none, are alike by chance, and the more sets
  there are, the more of them. So each set leaves out its `spare` blocks of the
  fewest elements, ties by sketch. Blocks that two sets share have one place in
  that order, so a set leaves out the last of them only with all others, and
  those are more than `spare`: both sets of a linked pair keep it.
* Before verification, the Hamming distance of two bit sketches, in which each
  element flips one bit, must be at most d: it never exceeds the symmetric
  difference, so no linked pair is lost. Sketches grow with their sets; of two
  lengths, the longer one is folded to the shorter, which keeps parities.
* Sets that agree in a block are compared with the one of them that shares the
  most blocks, and after a first round of components, only across components.
  Groups of near copies thus cost about as many comparisons as they have
  members, and no component is missed.
* Links are counted afterwards, since each lies within a component: a
  component's whole sets meet in cells, and only counts leave them.

Equal sets are one class from the start: copies meet through their class only.
Elements are 64-bit hashes of shingles, and sets compare by them. Classes meet
under 64-bit names of which no two linked ones must be equal (for 1e11 linked
pairs, a chance of 5e-9); links join ids that are unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, freed

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Spare blocks for so many others: enough for nearly all that have no elements.
SPARE = 4
#: Size bands grow by this factor.
RATIO = 1.5
#: A set's first sketch, 256 bits in four numbers.
LOW = ("low0", "low1", "low2", "low3")
#: Every set has a sketch of 256 bits, and from so many elements on a second one of more bits than elements, 512 at least.
LONG = 100
#: Words' hashes that a task remembers, and the longest of these words in bytes.
WORDS, WORD_BYTES = 200_000, 40
#: Classes whose keys a task remembers having emitted.
REMEMBERED = 200_000
#: Members of a key that are compared with each other in one go; larger keys are split into pairs of half as many.
TOGETHER = 4096
#: Members up to which cells are compared many at a time.
TOGETHER_SMALL = 512
#: Pairs that first sketches leave possible, held at most before the second ones are compared.
PAIRS = 1 << 18
#: Pairs of one document that a task verifies, and bits of the table that thins out documents before they are joined.
FAN, BITS = 64, 1 << 24
#: Members, and elements of their sets, that a task counts the links of in one go; larger components are split into pairs of half as many.
CELL, ELEMENTS = 2048, 4_000_000
#: Elements that so many sets share are counted as pairs, more common ones by a product of matrices.
SHARED = 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= WORD_BYTES:
            if len(self) >= WORDS:
                self.clear()
            self[word] = h
        return h


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def _forget() -> None:
    _words().clear()


def row_key(docs: DataFrame) -> Column:
    """A number that a row's doc_id and text decide."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    Words are runs without white space, A-Z in lower case. A text with fewer
    words than `width` has its whole sequence as one shingle; one without words
    has none.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):  # order matters: each step mixes before the next word comes in
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    out.sort()
    keep = np.empty(len(out), bool)
    keep[0] = True
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out[keep]


class Plan:
    """Size bands and their numbers of blocks for a threshold num / den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    @staticmethod
    @lru_cache(maxsize=4096)
    def _edges(upto: int) -> list[int]:
        edges = [1]
        while edges[-1] <= upto:
            edges.append(max(edges[-1] + 1, int(edges[-1] * RATIO)))
        return edges

    def band(self, n: int) -> int:
        """The band [edge, next edge) that a size lies in."""
        edges = self._edges(1 << max(4, n.bit_length()))
        return int(np.searchsorted(edges, n, side="right")) - 1

    def bounds(self, band: int) -> tuple[int, int]:
        edges = [1]
        while len(edges) < band + 2:
            edges.append(max(edges[-1] + 1, int(edges[-1] * RATIO)))
        return edges[band], edges[band + 1]

    def most(self, a: int, b: int) -> int:
        """The largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def blocks(self, band: int) -> tuple[int, int]:
        """Number of blocks and of spare ones for pairs whose smaller set is in the band."""
        small = self.bounds(band)[1] - 1
        d = self.most(small, small * self.den // self.num)
        spare = 2 + d // SPARE if d else 0
        return d + 1 + spare, spare

    def roles(self, n: int) -> list[int]:
        """Bands of smaller sets that a set of n elements can be linked with."""
        least = -(-n * self.num // self.den)
        return list(range(self.band(max(1, least)), self.band(n) + 1))


@lru_cache(maxsize=64)
def _band_blocks(num: int, den: int, band: int) -> tuple[int, int]:
    return Plan(num, den).blocks(band)


def block_keys(h: np.ndarray, plan: Plan) -> np.ndarray:
    """The keys under which a set is looked for: parity sketches of its blocks."""
    out = []
    top = (h >> np.uint64(32)).astype(np.int64)
    for band in plan.roles(len(h)):
        k, spare = _band_blocks(plan.num, plan.den, band)
        at = (top * k) >> 32
        edge = np.searchsorted(at, np.arange(k + 1))
        size = np.diff(edge)
        run = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(_mix(h))])
        parity = run[edge[1:]] ^ run[edge[:-1]]
        block = np.arange(k, dtype=np.uint64)
        keys = _mix(_mix(parity + np.uint64(band + 1)) + block)
        out.append(keys[np.lexsort((keys, size))[spare:]])
    return np.concatenate(out)


def bit_sketch(h: np.ndarray, bits: int) -> bytes:
    """A sketch of `bits` bits in which each element flips one."""
    pos = (_mix(h + np.uint64(0x1234567)) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(pos, minlength=bits) & 1).astype(np.uint8)).tobytes()


def high_sketch(h: np.ndarray) -> bytes | None:
    return bit_sketch(h, 1 << max(9, len(h).bit_length())) if len(h) >= LONG else None


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch in 64-bit words as the shorter one of the same set, of so many words."""
    return sketch if len(sketch) == words else np.bitwise_xor.reduce(sketch.reshape(-1, words))


def _scan(docs: DataFrame, width: int, plan: Plan) -> DataFrame:
    """One row per row (doc_id, row, text): set size, class, sketches, block keys (null where this task has emitted them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for rows in (batch.slice(lo, 1024) for batch in batches for lo in range(0, batch.num_rows, 1024)):
            n, cls, low, high, keys = [], [], [[], [], [], []], [], []
            for cell in rows.column(2):
                h = shingle_set(cell.as_py(), width)
                n.append(len(h))
                if not len(h):
                    for c in (cls, *low, high, keys):
                        c.append(None)
                    continue
                name = xxhash.xxh3_128_digest(h.tobytes())
                cls.append(name)
                if name in seen:
                    for c in (*low, high, keys):
                        c.append(None)
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(name)
                for c, x in zip(low, np.frombuffer(bit_sketch(h, 256), np.int64).tolist(), strict=True):
                    c.append(x)
                high.append(high_sketch(h))
                keys.append(block_keys(h, plan).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), *(pa.array(x, pa.int64()) for x in low), pa.array(high, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "row", "n", "cls", *LOW, "high", "keys"],
            )

    return docs.mapInArrow(freed(run, _forget), f"doc_id long, row long, n long, cls binary, {', '.join(f'{c} long' for c in LOW)}, high binary, keys array<long>")


def _meetings(keyed: DataFrame) -> DataFrame:
    """For each key that several classes share, its classes beside the key's first one.

    Rows come sorted by key and class, so a key needs no more memory than its
    first class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_cls = first = None
        for rows in batches:
            key, cls = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            if last_key is not None:
                key, cls = np.concatenate([[last_key], key]), np.concatenate([[last_cls], cls])
            same = key[1:] == key[:-1]
            begin = np.concatenate([[True], ~same])
            start = np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0))
            lead = cls[start]
            if last_key is not None:
                lead[start == 0] = first
            new = np.concatenate([[False], same & (cls[1:] != cls[:-1])])
            last_key, last_cls, first = key[-1], cls[-1], lead[-1]
            yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(lead[new]), pa.array(cls[new])], names=["key", "first", "other"])

    return keyed.mapInArrow(run, "key long, first long, other long")


def _far(high: list[bytes], i: np.ndarray, j: np.ndarray, most: np.ndarray, scale: int) -> np.ndarray:
    """Which pairs of rows (i, j) have second sketches whose distance, times scale, is more than `most`."""
    width, far = np.array([len(x) for x in high]), np.zeros(len(i), bool)
    both = width[i] * width[j] > 0
    for a, b in set(zip(width[i][both].tolist(), width[j][both].tolist(), strict=True)):
        least, alike = min(a, b) // 8, np.flatnonzero((width[i] == a) & (width[j] == b))
        for part in np.array_split(alike, -(-len(alike) * (a + b) // (1 << 20))):
            x, y = (np.frombuffer(b"".join([high[k] for k in side[part].tolist()]), np.uint64).reshape(len(part), -1, least) for side in (i, j))
            differ = np.bitwise_xor.reduce(x, axis=1) ^ np.bitwise_xor.reduce(y, axis=1)
            far[part] = np.bitwise_count(differ).sum(1, dtype=np.int64) * scale > most[part]
    return far


def possible_pairs(size: np.ndarray, short: np.ndarray, label: np.ndarray, n: np.ndarray, low: np.ndarray, high: list[bytes], plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (first, other) of rows of one cell that labels, sizes and sketches leave possible, each once. size has the rows of each cell in turn.

    Cells of at most TOGETHER_SMALL rows are compared all at once: each row with
    the next one of its cell, then with the one after that, and so on. A row of
    a larger cell is compared with all that follow it there.
    """
    end = np.cumsum(size)
    after = np.repeat(end, size) - np.arange(len(short)) - 1
    small = np.repeat(size <= TOGETHER_SMALL, size)
    left, right, found = [], [], []

    def kept(i: np.ndarray, j: np.ndarray) -> None:
        fit = (label[i] != label[j]) & (short[i] != short[j])
        fit &= np.minimum(n[i], n[j]) * plan.den >= np.maximum(n[i], n[j]) * plan.num
        i, j = i[fit], j[fit]
        near = np.bitwise_count(low[i] ^ low[j]).sum(1, dtype=np.int64) * (plan.den + plan.num) <= (n[i] + n[j]) * (plan.den - plan.num)
        left.append(i[near])
        right.append(j[near])
        if sum(map(len, left)) > PAIRS:
            told()

    def once(first: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The places of pairs, each once."""
        order = np.lexsort((other, first))
        a, b = first[order], other[order]
        return order[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]]

    def told() -> None:
        i, j = np.concatenate(left), np.concatenate(right)
        left.clear()
        right.clear()
        first, other = np.minimum(short[i], short[j]), np.maximum(short[i], short[j])
        at = once(first, other)  # a pair of many cells is looked at once
        at = at[~_far(high, i[at], j[at], (n[i[at]] + n[j[at]]) * (plan.den - plan.num), plan.den + plan.num)]
        found.append((first[at], other[at]))

    step, rows = 1, np.flatnonzero(small & (after > 0))
    while len(rows):
        kept(rows, rows + step)
        step += 1
        rows = rows[after[rows] >= step]
    for row in np.flatnonzero(~small & (after > 0)).tolist():
        j = row + 1 + np.flatnonzero(label[row + 1 : row + 1 + after[row]] != label[row])
        if len(j):
            kept(np.full(len(j), row), j)
    if left:
        told()
    if not found:
        return short[:0], short[:0]
    first, other = (np.concatenate([f[k] for f in found]) for k in range(2))
    at = once(first, other)
    return first[at], other[at]


def _compared(members: DataFrame, plan: Plan) -> DataFrame:
    """The pairs of a cell's members of different labels that sizes and sketches leave possible: (first, other).

    Rows (cell, short, label, n, LOW, high) come sorted by cell. A cell has at
    most TOGETHER members, about. All cells that end in a batch are compared in
    memory; only pairs that may be linked leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, short, label, n, low, high = (np.empty(0, np.int64),) * 4 + (np.empty((0, 4), np.uint64), [])

        def handed(upto: int) -> pa.RecordBatch:
            edge = np.flatnonzero(np.concatenate([[True], cells[1:upto] != cells[: upto - 1], [True]]))
            first, other = possible_pairs(np.diff(edge), short[:upto], label[:upto], n[:upto], low[:upto], high[:upto], plan)
            return pa.RecordBatch.from_arrays([pa.array(first), pa.array(other)], names=["first", "other"])

        for rows in batches:
            if not rows.num_rows:
                continue
            cells, short, label, n = (np.concatenate([held, rows.column(k).to_numpy()]) for k, held in enumerate((cells, short, label, n)))
            low = np.concatenate([low, np.stack([rows.column(k).to_numpy().view(np.uint64) for k in range(4, 8)], 1)])
            high += [x or b"" for x in rows.column(8).to_pylist()]
            last = int(np.flatnonzero(cells != cells[-1])[-1]) + 1 if cells[0] != cells[-1] else 0  # the last cell may go on
            if last:
                yield handed(last)
                cells, short, label, n, low, high = cells[last:], short[last:], label[last:], n[last:], low[last:], high[last:]
        if len(cells):
            yield handed(len(cells))

    return members.select("cell", "short", "label", "n", *LOW, "high").mapInArrow(run, "first long, other long")


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of the edges (a, b) can reach: (node, label).

    Min-label hooking with pointer jumping; each round is a few joins, and the
    number of rounds grows with the logarithm of the components' size.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        jump = label.alias("x").join(label.alias("y"), F.col("x.label") == F.col("y.node"), "left").select(F.col("x.node").alias("node"), F.col("x.label").alias("old"), F.coalesce("y.label", "x.label").alias("up"))
        jump = cut(jump)
        seen = both.join(jump.select(F.col("node").alias("b"), F.col("up").alias("val")), "b").groupBy("a").agg(F.min("val").alias("val"))
        seen = seen.join(jump, seen.a == jump.node).select("node", "old", "val")
        targets = seen.select("node", "val").union(seen.select(F.col("old").alias("node"), "val")).union(jump.select("node", F.col("up").alias("val")))
        new = targets.groupBy("node").agg(F.min("val").alias("label"))
        new = cut(new.join(label.select("node", F.col("label").alias("was")), "node").select("node", "label", (F.col("label") < F.col("was")).alias("moved")))
        label = new.select("node", "label")
        if not new.filter("moved").limit(1).count():
            return label


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The number of elements that each two of the sets share; the diagonal is not filled."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    size = np.diff(np.append(begin, len(flat)))
    each = np.repeat(size, size)
    few = (each > 1) & (each <= SHARED)
    at, who = np.repeat(np.arange(len(size)), size)[few], owner[few]
    for d in range(1, min(SHARED, len(at))):
        same = at[d:] == at[:-d]
        if not same.any():
            break
        np.add.at(out.reshape(-1), who[:-d][same] * m + who[d:][same], 1)
    many = each > SHARED
    at = np.repeat(np.cumsum(size > SHARED) - 1, size)[many]
    who = owner[many]
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 2048):
        a, b = np.searchsorted(at, (lo, lo + 2048))
        x = np.zeros((m, 2048), np.float32)
        x[who[a:b], at[a:b] - lo] = 1
        out += np.triu(x @ x.T, 1).astype(np.int64)
    return out + out.T


def _counted(cells: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """How many links each class has in each cell: (cls, n_links).

    Rows (label, lo, hi, own, cls, text) come sorted by (label, lo, hi, cls). Where lo and hi differ, only
    members whose own parts differ are compared, so that each two meet in one cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, names, sets = None, [], [], []

        def handed() -> pa.RecordBatch:
            n, own = np.array([len(x) for x in sets]), np.array(part)
            linked = overlaps(sets) * (den + num) >= (n[:, None] + n[None, :]) * num
            np.fill_diagonal(linked, False)
            if at[1] != at[2]:
                linked &= own[:, None] != own[None, :]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(linked.sum(1, dtype=np.int64))], names=["cls", "n_links"])

        for rows in (batch.slice(lo, 256) for batch in batches for lo in range(0, batch.num_rows, 256)):
            for label, lo, hi, own, cls, text in zip(*(rows.column(k).to_pylist() for k in range(6)), strict=True):
                if (label, lo, hi) != at:
                    if len(sets) > 1:
                        yield handed()
                    at, part, names, sets = (label, lo, hi), [], [], []
                if names and names[-1] == cls:  # a repeated row
                    continue
                h = shingle_set(text, width)
                if xxhash.xxh3_128_digest(h.tobytes()) == cls:  # else another row with that id
                    part.append(own)
                    names.append(cls)
                    sets.append(h)
        if len(sets) > 1:
            yield handed()

    met = cells.repartition("label", "lo", "hi").sortWithinPartitions("label", "lo", "hi", "cls")
    return met.select("label", "lo", "hi", "own", "cls", "text").mapInArrow(freed(run, _forget), "cls binary, n_links long").groupBy("cls").agg(F.sum("n_links").alias("n_links"))


def _joined(docs: DataFrame, width: int, plan: Plan) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """What jaccard_components and keep_one build on: rows, classes, links, labels of linked classes, and texts.

    Rows are (doc_id, row, n, cls). A class has a unique id, node, which is what links and labels hold, the least
    doc_id and the least row of its rows. The last frame is the documents as (doc_id, row, text).
    """
    num, den = plan.num, plan.den
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row"), F.col("text").cast("string").alias("text"))
    scan = cut(_scan(docs, width, plan))
    sets = scan.filter(F.col("cls").isNotNull())
    # equal sets: the copies' rows meet after a partial aggregation in each task
    classes = cut(
        sets.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("n").alias("n"), *(F.max(c).alias(c) for c in LOW), F.max("high").alias("high"))
        .withColumn("short", F.xxhash64("cls")).withColumn("node", F.monotonically_increasing_id())
    )
    keyed = sets.filter(F.col("keys").isNotNull()).select(F.explode("keys").alias("key"), F.xxhash64("cls").alias("short"))
    meet = cut(_meetings(keyed.repartition("key").sortWithinPartitions("key", "short")))

    def possible(cells: DataFrame) -> DataFrame:
        """From rows (cell, short, label), the pairs of nodes that may be linked, with their classes."""
        told = cells.join(classes.select("short", "n", *LOW, "high"), "short")
        pairs = cut(_compared(told.repartition("cell").sortWithinPartitions("cell"), plan).distinct())
        for side, name in (("a", "first"), ("b", "other")):
            pairs = pairs.join(classes.select(F.col("short").alias(name), F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("cls").alias(f"{side}_cls"), F.col("row").alias(f"{side}_row")), name)
        return cut(pairs.filter("a <> b").select("a", "b", "a_cls", "b_cls", "a_row", "b_row", "a_n", "b_n"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that link, by their whole sets: a class's text meets those of its partners, FAN at a time."""
        fan = pairs.groupBy("a").agg(F.count("*").alias("fan"))
        pairs = pairs.join(fan, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("fan") / FAN)))
        cols = ["a", "salt", F.col("a_row").alias("row"), F.col("a_cls").alias("cls"), F.lit(None).cast("long").alias("b"), F.lit(0).cast("long").alias("total")]
        wanted = cut(pairs.select(*cols).distinct().union(pairs.select("a", "salt", "b_row", "b_cls", "b", (F.col("a_n") + F.col("b_n")).alias("total"))))
        met = wanted.join(texts_of(docs, wanted), "row").select("a", "salt", "b", "total", "cls", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, own = None, None
            for rows in (batch.slice(lo, 256) for batch in batches for lo in range(0, batch.num_rows, 256)):
                left, right = [], []
                for a, salt, b, total, cls, text in zip(*(rows.column(k).to_pylist() for k in range(6)), strict=True):
                    if (a, salt) != at:
                        at, own = (a, salt), None
                    if b is None and own is not None:
                        continue
                    h = shingle_set(text, width)
                    if xxhash.xxh3_128_digest(h.tobytes()) != cls:  # another row with that number
                        continue
                    if b is None:
                        own = h
                    elif own is not None:
                        both = np.concatenate([own, h])
                        both.sort(kind="stable")
                        if int((both[1:] == both[:-1]).sum()) * (den + num) >= total * num:
                            left.append(a)
                            right.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

        return cut(met.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(freed(run, _forget), "a long, b long").distinct())

    def chunked(members: DataFrame) -> DataFrame:
        """Cells of at most TOGETHER members, about, in which any two members of a key meet."""
        n = F.ceil(F.col("size") * 2 / TOGETHER)
        own = F.pmod(F.xxhash64("short", F.lit(31)), n)
        cells = F.when(F.col("size") <= TOGETHER, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda x: F.least(x, own) * n + F.greatest(x, own)))
        return members.select(F.explode(cells).alias("part"), "key", "short", "label").select(F.when(F.col("part") == 0, F.col("key")).otherwise(F.xxhash64("key", "part")).alias("cell"), "short", "label")

    # first each key's classes against the one of them that shares the most keys, as an original does among its
    # edited copies: cells of one such class, labelled 0, and of others, labelled 1
    members = cut(meet.select("key", F.col("other").alias("short")).union(meet.select("key", "first").distinct()))
    shares = members.groupBy("short").agg(F.count("*").alias("shares"))
    lead = members.join(shares, "short").groupBy("key").agg(F.max(F.struct("shares", "short")).alias("lead")).select("key", F.col("lead.short").alias("first"))
    members = cut(members.join(lead, "key").filter("short <> first").select("key", "short", "first"))
    # only where sizes and first sketches leave a link possible
    few = classes.select("short", "n", *LOW)
    of = lambda name: few.select(F.col("short").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", *LOW)))
    stars = members.select("first", F.col("short").alias("other")).distinct().join(of("other"), "other").join(of("first"), "first")
    far = sum((F.bit_count(F.col(f"first_{c}").bitwiseXOR(F.col(f"other_{c}"))) for c in LOW[1:]), F.bit_count(F.col("first_low0").bitwiseXOR(F.col("other_low0"))))
    near = far * (den + num) <= (F.col("first_n") + F.col("other_n")) * (den - num)
    stars = cut(stars.filter(near & (F.least("first_n", "other_n") * den >= F.greatest("first_n", "other_n") * num)).select("first", "other"))
    stars = stars.join(stars.groupBy("first").agg(F.count("*").alias("size")), "first")
    stars = stars.withColumn("cell", F.xxhash64("first", F.pmod(F.xxhash64("other", F.lit(31)), F.ceil(F.col("size") / TOGETHER))))
    links = verified(possible(stars.select("cell", F.col("first").alias("short"), F.lit(0).cast("long").alias("label")).distinct().union(stars.select("cell", "other", F.lit(1).cast("long")))))
    label = components(links)
    # then the other classes that share a key but not the component
    names = classes.join(label, "node", "left").select("short", F.coalesce("label", "node").alias("label"))
    members = cut(members.select("key", "short").join(names, "short"))
    # keys of equal members, as those of one shared passage, are one: a second count of members' hashes tells sets of them apart
    mixed = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), *(f(F.xxhash64("short", F.lit(k))).alias(f"same{k}") for k, f in ((41, F.bit_xor), (43, F.bit_xor), (47, F.bit_xor)))).filter("lo <> hi")
    mixed = mixed.groupBy("size", "same41", "same43", "same47").agg(F.min("key").alias("key")).select("key", "size")
    more = verified(possible(chunked(members.join(mixed, "key"))))
    if more.limit(1).count():
        links = cut(links.union(more).distinct())
        label = components(links)
    return scan.select("doc_id", "row", "n", "cls"), classes, links, label, docs


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts (row, text) of about the wanted rows, once each: a table of at most BITS / 64 rows thins the others out before they are shuffled."""
    place = F.pmod(F.xxhash64("row", F.lit(29)), F.lit(BITS))
    bits = wanted.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    texts = docs.select("row", "text", place.alias("at")).withColumn("word", F.shiftright("at", 6))
    return texts.join(F.broadcast(bits), "word").filter(F.call_function("getbit", "bits", (F.col("at") % 64).cast("int")) == 1).select("row", "text").dropDuplicates(["row"])


def _degrees(classes: DataFrame, links: DataFrame, label: DataFrame, docs: DataFrame, width: int, plan: Plan) -> DataFrame:
    """Links of each class (cls, n_links). Where all of a component's pairs are links already, that is its size less 1; the others' sets meet anew."""
    members = classes.join(label, "node").select("label", "node", "cls", "n", "row")
    pairs = links.select(F.least("a", "b").alias("node"), F.greatest("a", "b").alias("b")).distinct().join(label, "node").groupBy("label").agg(F.count("*").alias("pairs"))
    sizes = members.groupBy("label").agg(F.count("*").alias("size"), F.sum("n").alias("total")).join(pairs, "label")
    members = cut(members.join(sizes, "label").withColumn("whole", F.col("pairs") * 2 == F.col("size") * (F.col("size") - 1)))
    whole = members.filter("whole").select("cls", (F.col("size") - 1).alias("n_links"))
    left = members.filter(~F.col("whole"))
    parts = F.when((F.col("size") <= CELL) & (F.col("total") <= ELEMENTS), 1).otherwise(F.greatest(F.ceil(F.col("size") * 2 / CELL), F.ceil(F.col("total") * 2 / ELEMENTS))).cast("long")
    left = left.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("cls", F.lit(31)), "parts"))
    wanted = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("label", F.least("own", "part").alias("lo"), F.greatest("own", "part").alias("hi"), "own", "cls", "row")
    met = wanted.join(texts_of(docs, left.select("row").distinct()), "row")
    return cut(_counted(met, width, plan.num, plan.den).union(whole))


def _named(rows: DataFrame, classes: DataFrame, label: DataFrame) -> DataFrame:
    """Rows (doc_id, row, n, cls) with comp, their component's number, and component_id, its least doc_id."""
    linked = classes.join(label, "node").select("cls", "label", "doc_id")
    ids = linked.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = linked.join(ids, "label").select("cls", F.col("label").alias("comp"), "component_id")
    own = classes.select("cls", "node", F.col("doc_id").alias("least"))
    of_class = own.join(named, "cls", "left").select("cls", F.coalesce("comp", "node").alias("comp"), F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(of_class, "cls", "left").select("doc_id", "row", "n", "cls", "comp", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, count: bool = True) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and, if asked to count, n_links.

    Documents link when den * |A & B| >= num * |A | B| for their sets of
    distinct word shingles; component_id is the smallest doc_id that links
    lead to, the document's own included. n_links counts all links of the
    document's class to other classes.

    Null and empty texts and texts without words have no set, 0 shingles, no
    links, and their own id. Repeated rows come out once each and share a class.
    Rows without a doc_id are never anyone's component_id; theirs is that of
    their component, null if no other row there has an id. Rows that share a
    doc_id but not the text are documents of their own. An empty table gives no
    rows; other columns are ignored.
    """
    plan = Plan(num, den)
    rows, classes, links, label, texts = _joined(docs, width, plan)
    found = _named(rows, classes, label).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "cls")
    if not count:
        return found.drop("cls")
    links_of = _degrees(classes, links, label, texts, width, plan)
    return found.join(links_of, "cls", "left").select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of each component of near-copies one row: that of its least doc_id.

    Rows are told apart by doc_id and text, so that rows which share an id but
    not the text stand for themselves. Of several rows with the component's
    id one stays, the same in each run; where no row of a component has an id,
    one of them stays too. Rows without words have no copies: all of them stay.
    Null ids and texts, empty tables and columns of any name are fine.
    """
    rows, classes, _, label, _ = _joined(docs, width, Plan(num, den))
    found = cut(_named(rows, classes, label).filter("n > 0").select("doc_id", "row", "comp", "component_id"))
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("comp", "doc_id", "row").agg(F.count("*").alias("times"))
    kept = cut(first.join(first.groupBy("comp").agg(F.min("row").alias("least")), "comp").select("doc_id", "row", "times", (F.col("row") == F.col("least")).alias("stays")))
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "row").union(kept.filter(~F.col("stays")).select("doc_id", "row")).distinct()
    key = "row"
    while key in docs.columns:
        key += "_"
    told = docs.withColumn(key, row_key(docs))

    def joined(left: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
        return left.join(keys, left["doc_id"].cast("long").eqNullSafe(keys["_id"]) & (left[key] == keys["_row"]), how)

    left = joined(told, gone, "left_anti")
    again = kept.filter("stays and times > 1")
    if again.limit(1).count():
        left = joined(left, again, "left_anti").unionByName(joined(left, again, "left_semi").dropDuplicates(["doc_id", key]))
    return left.select(*docs.columns)
