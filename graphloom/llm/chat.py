"""Chat formatting: a hidden Markov model reads transcripts, then turns are rendered.

A transcript's lines are the observations; the states are the first line, and
a further line, of each role's turns. A line is observed by its speaker marker
("User:", "<|assistant|>", "[system]" and the like), its length, its last sign
and its kind, a first line also by the length of the row that it begins. How
turns of roles begin, follow each other and end conversations is counted by
turn, not by line, so that long turns weigh no more than short ones; how often
a line goes on, by line. All counts come from a bounded sample of turns with
known roles. How often a turn carries a marker is a parameter. Viterbi recovers
the roles of a whole conversation. The role column is no input of it.

A row of the table holds a part of a conversation: one turn, or a transcript
of many. A row always starts a turn; inside a row, a line can. Rows are dealt
to blocks by ranges of their order, so that no block holds more than a task can
take, however long a conversation is. Viterbi is a product of matrices in
(max, +): each block of a conversation that lies in several is reduced to one
small matrix, the blocks are chained by these, and then decoded one by one,
with the same result as in one piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, unit_hash

#: Speakers' names by role (fixed values).
SPEAKERS = {
    "system": "system sys instruction instructions context",
    "user": "user human customer client question q prompter me",
    "assistant": "assistant bot ai agent model answer a chatbot gpt",
}
ROLES = tuple(SPEAKERS)
#: Share of turns that carry a marker, of those with a wrong one, and of further lines that look like one.
MARKED, WRONG, QUOTED = 0.7, 1e-3, 1e-4
#: Share of lines inside a row that start a turn, and of these turns that lack a marker.
STARTS, BARE = 0.05, 1e-5
#: Rows that training may use, and signs of each.
SAMPLE_ROWS, SAMPLE_CHARS = 20_000, 20_000

_ROLE_OF = {n: i for i, r in enumerate(ROLES) for n in SPEAKERS[r].split()}
_NAMES = "|".join(sorted(_ROLE_OF, key=lambda n: (-len(n), n)))
_MARKER = re.compile(rf"\s*(?:<\|({_NAMES})\|>|<({_NAMES})>|\[({_NAMES})\]|[*_]{{2}}({_NAMES})(?::[*_]{{2}}|[*_]{{2}}\s*:)|(?:\#{{1,4}}\s*|>\s*)?({_NAMES})\s*:)[ \t]*", re.I)
_LENGTHS = (1, 20, 60, 120, 240, 480)
_KIND = re.compile(r"\s*(?:(```|    \S|[{}]|def |class |import )|([-*•]|\d+[.)])\s)")


def marker(line: str) -> tuple[int, str]:
    """The role that the line's marker names, -1 for none, and the line without the marker."""
    m = _MARKER.match(line)
    return (_ROLE_OF[next(filter(None, m.groups())).lower()], line[m.end() :]) if m else (-1, line)


def describe(line: str) -> tuple[int, int, int]:
    """A line's bucket of length, of its last sign, and its kind."""
    last = line.rstrip()[-1:]
    m = _KIND.match(line)
    return sum(len(line) >= x for x in _LENGTHS), 0 if not last else 1 if last in "?¿" else 2 if last in ".!…" else 3, 0 if not m else 1 if m[1] else 2


_ROWS_LENGTHS = (30, 60, 100, 150, 200, 250, 300, 350, 400, 500, 700, 1000, 2000)


def row_length(text: str) -> int:
    """A row's bucket of length."""
    return sum(len(text) >= x for x in _ROWS_LENGTHS)


SIZES = (len(_LENGTHS) + 1, 4, 3)
STATES = 2 * len(ROLES)  # 2 * role for a first line, and 1 more for a further one


@dataclass
class Model:
    """Log-probabilities: of a conversation's first state, of steps to a row's first line and inside a row, of the end,
    of features, of a row's length by role, and of a marker (none, or a role's) in each state."""

    start: np.ndarray
    turn: np.ndarray
    line: np.ndarray
    end: np.ndarray
    feature: list[np.ndarray]
    length: np.ndarray
    mark: np.ndarray = field(default_factory=lambda: marks())


def marks(marked: float = MARKED, wrong: float = WRONG, quoted: float = QUOTED) -> np.ndarray:
    out = np.empty((STATES, len(ROLES) + 1))
    for r in range(len(ROLES)):
        out[2 * r] = [1 - marked, *([wrong] * len(ROLES))]
        out[2 * r, 1 + r] = marked
        out[2 * r + 1] = [1.0, *([quoted] * len(ROLES))]
    return np.log(out)


def train(conversations: list[list[tuple[int, str]]], starts: float = STARTS) -> Model:
    """Count on conversations of (role, text) turns; every count starts at a small number."""
    k = len(ROLES)
    start, after, last = np.full(k, 0.02), np.full((k, k), 0.02), np.full(k, 0.02)
    turns = np.full(k, 0.06)
    feature = [np.full((STATES, n), 0.5) for n in SIZES]
    length = np.full((k, len(_ROWS_LENGTHS) + 1), 0.5)
    for conversation in conversations:
        before = None
        for role, text in conversation:
            turns[role] += 1
            if before is None:
                start[role] += 1
            else:
                after[before, role] += 1
            before = role
            length[role, row_length(text)] += 1
            for i, line in enumerate(text.split("\n")):
                for table, x in zip(feature, describe(line), strict=True):
                    table[2 * role + (i > 0), x] += 1
        if before is not None:
            last[before] += 1
    after = np.log(after / after.sum(1, keepdims=True))
    begin, row, inner = np.full(STATES, -np.inf), np.full((STATES, STATES), -np.inf), np.full((STATES, STATES), -np.inf)
    begin[::2] = np.log(start / start.sum())
    for r in range(k):
        for s in (2 * r, 2 * r + 1):
            row[s, ::2] = after[r]
            inner[s, ::2] = after[r] + np.log(starts)
            inner[s, 2 * r + 1] = np.log(1 - starts)
    end = np.repeat(np.log(last / turns), 2)
    return Model(begin, row, inner, end, [np.log(x / x.sum(1, keepdims=True)) for x in feature], np.log(length / length.sum(1, keepdims=True)))


@dataclass
class Line:
    text: str
    bare: str
    mark: int
    first: bool
    size: int


def lines_of(text: str | None) -> list[Line]:
    """A row's lines."""
    text = text or ""
    return [Line(line, (found := marker(line))[1], found[0], k == 0, row_length(text)) for k, line in enumerate(text.split("\n"))]


def scores(lines: list[Line], model: Model, last: bool = True) -> np.ndarray:
    """Each line's log-probability in each state; the last line's includes the conversation's end."""
    feats = np.array([describe(x.bare) for x in lines])
    out = sum(t[:, feats[:, i]].T for i, t in enumerate(model.feature))
    out += model.mark[:, [x.mark + 1 for x in lines]].T
    first = np.array([x.first for x in lines])
    one = first & np.append(first[1:], True)  # rows of one line have a length that their line tells already
    size = np.array([x.size for x in lines])
    out[np.ix_(first & ~one, range(0, STATES, 2))] += model.length[:, size[first & ~one]].T
    out[np.ix_(one, range(0, STATES, 2))] += 0.5 * model.length[:, size[one]].T
    plain = ~first & np.array([x.mark < 0 for x in lines])
    out[np.ix_(plain, range(0, STATES, 2))] += np.log(BARE / (1 - MARKED))
    out[first, 1::2] = -np.inf
    if last:
        out[-1] += model.end
    return out


def steps(lines: list[Line], model: Model) -> list[np.ndarray]:
    """The steps' log-probabilities to each line."""
    return [model.turn if x.first else model.line for x in lines]


def reduce(emit: np.ndarray, step: list[np.ndarray]) -> np.ndarray:
    """The best log-probability from each state before the lines to each state of their last line; without lines, of staying."""
    best = np.where(np.eye(STATES, dtype=bool), 0, -np.inf)
    for e, s in zip(emit, step, strict=True):
        best = (best[:, :, None] + s[None]).max(1) + e
    return best


def viterbi(emit: np.ndarray, step: list[np.ndarray], model: Model, before: int | None = None, end: int | None = None) -> list[int]:
    """The best states, given the state before the first line and that of the last one where they are known; ties take the first state."""
    best = emit[0] + (model.start if before is None else step[0][before])
    came = np.zeros(emit.shape, np.int8)
    for i in range(1, len(emit)):
        to = best[:, None] + step[i]
        came[i] = to.argmax(0)
        best = to.max(0) + emit[i]
    state = int(best.argmax()) if end is None else end
    out = [state]
    for i in range(len(emit) - 1, 0, -1):
        state = int(came[i, state])
        out.append(state)
    return out[::-1]


def render(role: str, text: str) -> str:
    """A turn in canonical form."""
    return f"<|{role}|>\n{text}\n<|end|>\n"


def learn(turns: DataFrame, sample: int = SAMPLE_ROWS) -> Model:
    """Train on the known roles of about `sample` rows, taken by whole conversations."""
    known = turns.filter(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("text").isNotNull())
    share = min(1.0, sample / max(1, known.count()))
    rows = known.filter(unit_hash(F.col("conv_id").cast("string"), 17) < share).select("conv_id", "turn", "role", F.substring("text", 1, SAMPLE_CHARS)).limit(4 * sample).collect()
    by: dict = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2], r[3])):
        by.setdefault(conv, []).append((ROLES.index(role), text))
    return train(list(by.values()))


_ROWS = "conv_id long, turn long, part int, role string, role_given string, n_lines int, n_chars int, text string, rendered string"
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first `width` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != key:
                if rows:
                    yield key, rows
                key, rows = row[:width], []
            rows.append(row)
    if rows:
        yield key, rows


def _decoded(rows: list[tuple], model: Model, before: int | None = None, end: int | None = None) -> Iterator[tuple]:
    """The turns of rows (conv_id, turn, role, text), given the states at the block's ends where other blocks have them."""
    own = [lines_of(r[3]) for r in rows]
    lines = [x for part in own for x in part]
    states = viterbi(scores(lines, model, end is None), steps(lines, model), model, before, end)
    at = 0
    for row, part in zip(rows, own, strict=True):
        mine = states[at : at + len(part)]
        at += len(part)
        begins = [i for i in range(len(part)) if i == 0 or mine[i] % 2 == 0]
        for number, (a, b) in enumerate(zip(begins, [*begins[1:], len(part)], strict=True)):
            role = ROLES[mine[a] // 2]
            first = part[a].bare if part[a].mark == mine[a] // 2 else part[a].text
            text = "\n".join([first, *(x.text for x in part[a + 1 : b])])
            yield row[0], row[1], number, role, row[2], b - a, len(text), text, render(role, text)


def _linked(key: tuple, table: pa.Table) -> pa.Table:
    """The states before and at the end of each of a conversation's blocks, from the blocks' matrices."""
    order = np.argsort(table.column("block").to_numpy(), kind="stable")
    cells = np.frombuffer(b"".join(table.column("cells").take(pa.array(order)).to_pylist())).reshape(len(order), 1 + 3 * STATES, STATES)
    first, inside, across, ended = cells[0, 0], cells[0, 1 : 1 + STATES], cells[:, 1 + STATES : 1 + 2 * STATES], cells[-1, 1 + 2 * STATES :]
    forward = [(first[:, None] + inside).max(0)]
    for m in [*across[1:-1], ended]:
        forward.append((forward[-1][:, None] + m).max(0))
    ends = np.zeros((len(order), 2), np.int64)
    state = int(forward[-1].argmax())
    for i in range(len(order) - 1, -1, -1):
        ends[i, 1] = state
        if i:
            state = int((forward[i - 1] + (ended if i == len(order) - 1 else across[i])[:, state]).argmax())
            ends[i, 0] = state
    ends[0, 0] = -1
    return pa.table({"conv_id": pa.array([key[0].as_py()] * len(order), pa.int64()), "block": table.column("block").take(pa.array(order)), "before": pa.array(ends[:, 0]), "end": pa.array(ends[:, 1])})


def format_chats(turns: DataFrame, model: Model | None = None, blocks: int | None = None) -> DataFrame:
    """One row per recovered turn: conv_id, turn, part, role, role_given, n_lines, n_chars, text, rendered.

    turn is the row's turn number, part counts the turns found inside the row
    from 0. role is what Viterbi finds from the conversation's lines; the role
    column only trains the model and is passed on as role_given. text is the
    turn without its marker, rendered its canonical form. A null text is an
    empty one. Rows repeated in all of conv_id, turn, role and text count once;
    other rows of one turn stand in an order that their hashes decide. A row
    without conv_id or turn is a conversation of its own. An empty table gives
    no rows; other columns are ignored. `blocks` sets the number of ranges that
    rows are dealt to, else Spark does.
    """
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower(F.trim(F.col("role").cast("string"))).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = turns.sparkSession.sparkContext.broadcast(model or learn(turns))
    # copies of a row meet after a partial aggregation; then ranges of the rows' order are the blocks
    turns = turns.withColumn("place", F.xxhash64("role", "text")).dropDuplicates(["conv_id", "turn", "place", "role", "text"])
    order = ["conv_id", "turn", "place"]
    dealt = turns.repartitionByRange(blocks, *order) if blocks else turns.repartitionByRange(*order)
    dealt = cut(dealt.withColumn("block", F.spark_partition_id().cast("long")))
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    whole, alone = dealt.filter(placed), dealt.filter(~placed)
    long = whole.groupBy("conv_id").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).filter("lo < hi").select("conv_id")

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=[x.split()[0] for x in _ROWS.split(", ")])

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Decodes runs of rows (conv_id, block, turn, role, text, before, end) with equal conv_id and block; a row without conv_id or turn is a run."""
        held: list[tuple] = []
        for key, rows in _groups(batches, 2):
            for run in [rows] if key[0] is not None and rows[0][2] is not None else [[r] for r in rows]:
                before, end = run[0][5:7]
                held += _decoded([(r[0], *r[2:5]) for r in run], shared.value, None if before is None or before < 0 else before, end)
            if len(held) >= 2000:
                yield out(held)
                held = []
        if held:
            yield out(held)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's scores of a start with it, and its matrices from its first line, from the state before it, and to the end."""
        model = shared.value
        for (conv, number), rows in _groups(batches, 2):
            lines = [x for r in rows for x in lines_of(r[4])]
            step, emit, last = steps(lines, model), scores(lines, model, False), scores(lines, model)
            cells = np.vstack([model.start + emit[0], reduce(emit[1:], step[1:]), reduce(emit, step), reduce(last, step)])
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([number], pa.int64()), pa.array([cells.tobytes()], pa.binary())], names=["conv_id", "block", "cells"])

    def in_order(df: DataFrame) -> DataFrame:
        more = [c for c in df.columns if c in ("before", "end")]
        return df.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "place", "role", "text").select("conv_id", "block", "turn", "role", "text", *more)

    matrices = in_order(whole.join(long, "conv_id", "left_semi")).mapInArrow(reduced, "conv_id long, block long, cells binary")
    ends = matrices.groupBy("conv_id").applyInArrow(_linked, "conv_id long, block long, before long, end long")
    main = in_order(whole.join(ends, ["conv_id", "block"], "left")).mapInArrow(conversations, _ROWS)
    none = F.lit(None).cast("long")
    single = alone.select("conv_id", "block", "turn", "role", "text", none.alias("before"), none.alias("end")).mapInArrow(conversations, _ROWS)
    return main.unionByName(single)
