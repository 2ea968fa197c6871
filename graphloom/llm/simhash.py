"""Near-copies by SimHash fingerprints, compared through tables of pivot distances.

* A fingerprint is the bitwise majority of its text's shingle hashes. Equal ones
  are one class from the start.
* Candidates: fingerprints are cut into BLOCKS blocks of bits, and at most d
  differing bits leave all but d blocks alone. So classes meet under each choice
  of BLOCKS - d blocks and their bits, which is what distances to references that
  differ in one bit of these blocks would tell.
* Classes that meet are never compared pair by pair at once. A cell of them
  first gets a table of Hamming distances to PIVOTS reference fingerprints. By
  the triangle inequality, two fingerprints within d of each other differ by at
  most d in every column. Sorted by the first pivot, only a range of rows is in
  question; each further pivot discards pairs by their difference, one byte a
  pair, and survivors are verified by their own Hamming distance.
* A cell hands on a forest: the links over which its classes were first
  reached. That keeps components and is never more than a row a member.

A key with more than CELL members is split into cells in which any two of its
members meet, so no task holds a hot group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut
from .jaccard_join import components

#: Words in a shingle, seed of its hash, and differing bits that still link.
WIDTH, SEED, BITS = 3, 42, 2
#: Blocks that the 64 bits are cut into.
BLOCKS = 4
#: Reference fingerprints.
PIVOTS = 32
#: Members of a key that are compared in one cell.
CELL = 8192
#: Shingles that are hashed in one go, and bytes of text that are turned to Python objects at once.
RUN, SLICE = 1 << 15, 8 << 20


def fingerprint(raw: bytes | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The unsigned fingerprint of a text: bit i is set if over half its shingles' XXH64 have it set.

    Shingles are runs of `width` words joined by a space, repeats included; a
    text of fewer words is one shingle, one without words has fingerprint 0.
    """
    words = (raw or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, RUN):
        hi = min(n, lo + RUN)
        runs = zip(*(words[lo + k : hi + k] for k in range(width)), strict=True) if len(words) >= width else [words]
        h = np.fromiter((digest(b" ".join(run), seed) for run in runs), "<u8", hi - lo)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of each row; fp holds the fingerprint's 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in by_bytes(batch, 1, SLICE):
                fp = np.fromiter((fingerprint(raw, width, seed) for raw in rows.column(1).cast(pa.binary()).to_pylist()), np.uint64, rows.num_rows)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(b"pivot", k) for k in range(n)], np.uint64)


def distance_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """A row for each reference: its Hamming distance to every fingerprint."""
    return np.bitwise_count(fp[None, :] ^ refs[:, None]).astype(np.int8)


def forest(fp: np.ndarray, most: int, refs: np.ndarray) -> np.ndarray:
    """Links (two columns) that connect exactly what pairs of at most `most` differing bits connect."""
    first = np.bitwise_count(fp ^ refs[0])
    order = np.argsort(first, kind="stable")
    fp = fp[order]
    table = distance_table(fp, refs)
    lows, highs = np.searchsorted(table[0], table[0] - most, "left"), np.searchsorted(table[0], table[0] + most, "right")
    fresh = np.ones(len(fp), bool)
    out: list[np.ndarray] = []
    for start in range(len(fp)):
        stack = [start] if fresh[start] else []
        fresh[start] = False
        while stack:
            x = stack.pop()
            lo, hi = lows[x], highs[x]
            near = lo + np.flatnonzero(fresh[lo:hi] & (np.abs(table[1, lo:hi] - table[1, x]) <= most))
            for column in table[2:]:
                if not len(near):
                    break
                near = near[np.abs(column[near] - column[x]) <= most]
            near = near[np.bitwise_count(fp[near] ^ fp[x]) <= most]
            if len(near):
                fresh[near] = False
                stack += near.tolist()
                out.append(np.stack([np.full(len(near), fp[x]), fp[near]], 1))
    return np.concatenate(out) if out else np.empty((0, 2), np.uint64)


def block_keys(fp: Column, blocks: int, most: int) -> Column:
    """A key for each choice of blocks - most blocks: the choice's number and the blocks' bits."""
    edges = [64 * b // blocks for b in range(blocks + 1)]
    masks = [sum(((1 << hi) - 1) ^ ((1 << lo) - 1) for b, (lo, hi) in enumerate(pairwise(edges)) if b in kept) for kept in combinations(range(blocks), blocks - most)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.array(*(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(signed(m)).cast("long"))) for k, m in enumerate(masks)))


def _links(cells: DataFrame, most: int) -> DataFrame:
    """Forests of the cells (cell, fp): (a, b). Rows come sorted by cell and fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()
        at, held = None, []

        def handed() -> Iterator[pa.RecordBatch]:
            fp = np.unique(np.concatenate(held)).view(np.uint64)
            if len(fp) > 1 and len(got := forest(fp, most, refs)):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, k]).view(np.int64)) for k in (0, 1)], names=["a", "b"])

        for rows in batches:
            cell, fp = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for lo, hi in pairwise(edges):
                if lo == hi:
                    continue
                if held and cell[lo] != at:
                    yield from handed()
                    held = []
                at = cell[lo]
                held.append(fp[lo:hi])
        if held:
            yield from handed()

    return cells.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(run, "a long, b long")


def linked(classes: DataFrame, most: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints fp that keep the components of all pairs within `most` bits."""
    keyed = cut(classes.select("fp", F.explode(block_keys(F.col("fp"), blocks, most)).alias("key")))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    halves = F.ceil(F.col("size") * 2 / CELL)
    own = F.pmod(F.xxhash64("fp", F.lit(31)), halves)
    others = F.filter(F.sequence(F.lit(0).cast("long"), halves - 1), lambda x: x != own)
    parts = F.when(F.col("size") <= CELL, F.array(F.lit(0).cast("long"))).otherwise(F.transform(others, lambda x: 1 + F.least(x, own) * halves + F.greatest(x, own)))
    members = keyed.join(sizes, "key").select("key", "fp", F.explode(parts).alias("part"))
    return _links(members.select(F.when(F.col("part") == 0, F.col("key")).otherwise(F.xxhash64("key", "part")).alias("cell"), "fp"), most)


def simhash_components(docs: DataFrame, width: int = WIDTH, seed: int = SEED, most: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that links reach.

    Fingerprints link at `most` or fewer differing bits; documents of equal
    fingerprints always do. Null, empty and wordless texts have fingerprint zero
    and link like any other. Repeated rows come out once each. Rows without a
    doc_id are never anyone's component_id; theirs is that of their component,
    null if no row there has an id. An empty table gives no rows; other columns
    are ignored.
    """
    if not 0 <= most < blocks:
        raise ValueError("there have to be more blocks than differing bits")
    rows = cut(fingerprints(docs, width, seed))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(linked(classes, most, blocks).distinct())
    of = classes.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "least")
    ids = of.groupBy("label").agg(F.min("least").alias("component_id"))
    named = cut(of.join(ids, "label").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
