"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Documents are tokenised and packed in one pass over the scan: no shuffle, no
row leaves its task until it is part of a finished piece. A long document is
cut into full windows; what remains of each document is dealt to the windows of
its batch by differencing, which keeps the windows' sums nearly equal. When the
largest sum is over the capacity, the batch gets one window more.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed
from .wordbpe import tokenizer

#: Tokens in a window, and the id that ends each document.
WINDOW, END_ID = 2048, 1
#: Windows that one differencing run fills, at least; a task's last run may have twice as many.
BATCH_WINDOWS = 64
#: A batch is closed at this share of its windows' room, so that near-equal sums fit at the first try.
FILL = 0.992
#: What remains of a document is cut into pieces of at most this many tokens.
PIECE = 512

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Deal items to `ways` sets by multiway largest differencing.

    Every partial partition is a row of set sums. The two with the largest
    spread are merged, the largest sums of one with the smallest of the other,
    until one partition is left. Equal spreads keep the items' order.
    """
    if not sizes:
        return [[] for _ in range(ways)]
    sums: dict[int, np.ndarray] = {}
    sets: dict[int, np.ndarray] = {}
    joined: list[tuple[int, int]] = []  # node n + i joins two nodes; below n a node is an item, -1 is empty
    n = len(sizes)
    heap: list[tuple[int, int]] = []
    for i, x in enumerate(sizes):
        row = np.zeros(ways, np.int64)
        row[-1] = x
        node = np.full(ways, -1, np.int64)
        node[-1] = i
        sums[i], sets[i] = row, node
        heap.append((-x if ways > 1 else 0, i))
    heapq.heapify(heap)
    key = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        row = sums.pop(a) + sums.pop(b)[::-1]
        left, right = sets.pop(a), sets.pop(b)[::-1]
        node = np.where(left < 0, right, left)
        both = np.flatnonzero((left >= 0) & (right >= 0))
        node[both] = n + len(joined) + np.arange(len(both))
        joined += zip(left[both].tolist(), right[both].tolist(), strict=True)
        order = np.argsort(row, kind="stable")
        row = row[order]
        sums[key], sets[key] = row, node[order]
        heapq.heappush(heap, (int(row[0] - row[-1]), key))
        key += 1
    out = []
    for top in sets[heap[0][1]].tolist():
        items, stack = [], [top] if top >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += joined[x - n]
        out.append(sorted(items))
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows, counted up from the sum, whose differencing fits the capacity."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = difference(sizes, ways)
        if max(sum(sizes[i] for i in w) for w in dealt) <= capacity:
            return [w for w in dealt if w]
        ways += 1


class _Packer:
    """Gathers a task's pieces and packs a batch whenever enough are there."""

    def __init__(self, task: int, window: int, batch: int, piece: int) -> None:
        self.window, self.batch, self.piece = window, int(batch * window * FILL), piece
        self.next_id, self.waiting, self.sum = task << 40, [], 0
        self.out: list[tuple] = []

    def _sequence(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, length, crc, total in pieces:
            self.out.append((doc, start, length, crc, total, self.next_id, offset))
            offset += length
        self.next_id += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        full = total - total % self.window
        parts = [(s, self.window) for s in range(0, full, self.window)]
        if rest := total - full:
            cuts = -(-rest // self.piece)
            edges = [full + rest * i // cuts for i in range(cuts + 1)]
            parts += [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        for start, length in parts:
            piece = (doc, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), total)
            if length == self.window:
                self._sequence([piece])
            else:
                self.waiting.append(piece)
                self.sum += length
        if self.sum >= 2 * self.batch:
            self._pack(self.batch)

    def _pack(self, most: int) -> None:
        cut = size = 0
        while cut < len(self.waiting) and size + self.waiting[cut][2] <= most:
            size += self.waiting[cut][2]
            cut += 1
        now, self.waiting = self.waiting[:cut], self.waiting[cut:]
        self.sum -= size
        for w in windows([p[2] for p in now], self.window):
            self._sequence([now[i] for i in w])

    def last(self) -> None:
        if self.waiting:
            self._pack(self.sum)

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) or [()] * 7
        self.out = []
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, batch: int = BATCH_WINDOWS, piece: int = PIECE) -> DataFrame:
    """Pack every document's ids, each followed by end_id, into windows.

    Returns one row per piece. Null and empty texts are one end id. Repeated
    rows and ids are packed as often as they stand there; a null doc_id stays
    null. An empty table gives no rows; other columns are ignored. Each id is
    in one piece; a window's pieces lie from offset 0 without gaps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(tokenizer_path), int(end_id).to_bytes(4, "little")
        packer = _Packer(TaskContext.get().partitionId(), window, batch, piece)
        for rows in batches:
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                packer.add(doc, tok.ids(text.as_py() or "") + end)
            yield packer.take()
        packer.last()
        yield packer.take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(freed(run, lambda: tokenizer(tokenizer_path).forget()), PIECES)
