"""Chat formatting: a hidden Markov model recovers the roles of transcript turns, then turns are rendered.

States are the roles. A turn shows a speaker marker (if any) and line features; emissions are products
of smoothed frequencies. Decoding is Viterbi in blocks: each block of a conversation is summed up by
its best-path matrix between border states, borders are decided over those matrices, and blocks are
then decoded on their own, so that one endless conversation is not one task's work.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm.common import settle, shuffle_parts, small_batches

ROLES = ("system", "user", "assistant")
# Marker words and the role they usually stand for.
MARKERS = {
    "system": "system", "instructions": "system", "context": "system", "user": "user", "human": "user", "q": "user", "question": "user",
    "customer": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "a": "assistant", "answer": "assistant", "agent": "assistant",
}
_MARK = re.compile(r"^[\s>#*\[(<|-]*([A-Za-z]{1,12})[\])>|*]*\s*:\s*")
N_MARKS, N_SIZES, N_LINES = 5, 8, 4


def observe(text: str | None) -> tuple[int, int, int, str]:
    """Marker class (0 none, 1-3 a role's, 4 some other), length class, line class, text without the marker."""
    text = text or ""
    found = _MARK.match(text)
    word = found.group(1).lower() if found else None
    mark = 0 if word is None else 1 + ROLES.index(MARKERS[word]) if word in MARKERS else 4
    body = text[found.end() :] if mark in (1, 2, 3) else text
    return mark, min(N_SIZES - 1, int(np.log2(len(body) + 1) / 1.6)), min(N_LINES - 1, body.count("\n")), body


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    marks: np.ndarray
    sizes: np.ndarray
    lines: np.ndarray

    def emit(self, mark: int, size: int, lines: int) -> np.ndarray:
        return self.marks[:, mark] + self.sizes[:, size] + self.lines[:, lines]


def _logs(counts: dict[tuple, int], shape: tuple[int, ...]) -> np.ndarray:
    table = np.full(shape, 0.5)
    for at, n in counts.items():
        table[at] += n
    return np.log(table / table.sum(axis=-1, keepdims=True))


_SEEN = "state int, mark int, size int, lines int"


def fit(turns: DataFrame) -> Model:
    """Frequencies over all labelled turns (conv_id, turn, role, text). Turns of other roles are not counted.

    Only tables of roles and classes leave Spark.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [observe(t) for t in batch.column(1).to_pylist()]
            state = [ROLES.index(r) if r in ROLES else None for r in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(state, pa.int32())] + [pa.array([r[i] for r in rows], pa.int32()) for i in range(3)], names=["state", "mark", "size", "lines"]
            )

    seen = turns.select("role", "text").mapInArrow(run, _SEEN).where("state is not null").groupBy("state", "mark", "size", "lines").count().collect()
    state = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")) - 1
    # Distinct, so that rows repeated under one key cannot multiply in the join.
    pairs = turns.where(state >= 0).select("conv_id", "turn", state.alias("state")).distinct()
    both = pairs.select("conv_id", F.col("turn").alias("at"), F.col("state").alias("from")).join(
        pairs.select("conv_id", (F.col("turn") - 1).alias("at"), F.col("state").alias("to")), ["conv_id", "at"]
    ).groupBy("from", "to").count().collect()
    first = pairs.where("turn = 0").groupBy("state").count().collect()
    count = lambda keys: {k: sum(r["count"] for r in seen if (r.state, r[keys]) == k) for k in {(r.state, r[keys]) for r in seen}}
    k = len(ROLES)
    return Model(
        _logs({(r.state,): r["count"] for r in first}, (k,)), _logs({(r["from"], r["to"]): r["count"] for r in both}, (k, k)),
        _logs(count("mark"), (k, N_MARKS)), _logs(count("size"), (k, N_SIZES)), _logs(count("lines"), (k, N_LINES)),
    )


def best_matrix(emit: np.ndarray, step: np.ndarray) -> np.ndarray:
    """[i, j]: best log score of a block that begins in state i and ends in state j (emissions included)."""
    out = np.full((len(step), len(step)), -np.inf)
    np.fill_diagonal(out, emit[0])
    for e in emit[1:]:
        out = (out[:, :, None] + step[None]).max(axis=1) + e
    return out


def viterbi(emit: np.ndarray, start: np.ndarray, step: np.ndarray, last: int | None = None) -> list[int]:
    """Best states; ties go to the earlier role. ``last`` fixes the final state."""
    score, back = start + emit[0], []
    for e in emit[1:]:
        through = score[:, None] + step
        back.append(through.argmax(axis=0))
        score = through.max(axis=0) + e
    path = [int(score.argmax()) if last is None else last]
    for choice in reversed(back):
        path.append(int(choice[path[-1]]))
    return path[::-1]


def _grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    held, at = [], None
    for batch in small_batches(batches, 4096):
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:keys] != at and held:
                yield at, held
                held = []
            at = row[:keys]
            held.append(row)
    if held:
        yield at, held


def parse(turns: DataFrame, model: Model, block: int = 256) -> DataFrame:
    """conv_id, turn, role, rendered for every turn (conv_id, turn, text).

    Turns follow by ``turn``, ties by text. A null conv_id or turn is a value of its own; a null
    text is empty. Rendering: ``<|role|>``, line break, text without its marker, ``<|end|>``.
    """
    parts = (model.start, model.step, model.marks, model.sizes, model.lines)

    def emissions(rows: list[tuple], m: Model) -> np.ndarray:
        return np.array([m.emit(*observe(r[3])[:3]) for r in rows])

    def matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, out = Model(*parts), []
        for (conv, at), rows in _grouped(batches, 2):
            out.append((conv, at, best_matrix(emissions(rows, m), m.step).ravel().tolist()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.float64())))], names=["conv_id", "block", "matrix"])

    def borders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, out, k = Model(*parts), [], len(ROLES)
        for (conv,), rows in _grouped(batches, 1):
            score, back = m.start, []
            for i, row in enumerate(rows):
                enter = score if not i else (score[:, None] + m.step).max(axis=0)
                through = enter[:, None] + np.array(row[2]).reshape(k, k)
                back.append((None if not i else (score[:, None] + m.step).argmax(axis=0), through.argmax(axis=0)))
                score = through.max(axis=0)
            last = int(score.argmax())
            for row, (before, first) in zip(reversed(rows), reversed(back)):
                out.append((conv, row[1], int(first[last]), last))
                last = int(before[first[last]]) if before is not None else last
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["conv_id", "block", "first", "last"])

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*parts)
        for (conv, _), rows in _grouped(batches, 2):
            start = np.full(len(ROLES), -np.inf)
            start[rows[0][4]] = 0.0
            path = viterbi(emissions(rows, m), start, m.step, rows[0][5])
            roles = [ROLES[s] for s in path]
            yield pa.RecordBatch.from_arrays([
                pa.array([conv] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(roles),
                pa.array([f"<|{role}|>\n{observe(r[3])[3]}\n<|end|>" for role, r in zip(roles, rows)]),
            ], names=["conv_id", "turn", "role", "rendered"])

    n = shuffle_parts(turns.sparkSession)
    cut = turns.select(
        F.col("conv_id").cast("long"), F.floor(F.col("turn") / block).cast("long").alias("block"), F.col("turn").cast("long"), F.coalesce("text", F.lit("")).alias("text")
    )
    sorted_cut = cut.repartition(n, "conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "text")
    summed = settle(sorted_cut.mapInArrow(matrices, "conv_id long, block long, matrix array<double>"))
    decided = settle(summed.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(borders, "conv_id long, block long, first int, last int"))
    same = F.col("conv_id").eqNullSafe(F.col("d_conv")) & F.col("block").eqNullSafe(F.col("d_block"))
    joined = cut.join(decided.select(F.col("conv_id").alias("d_conv"), F.col("block").alias("d_block"), "first", "last"), same)
    ready = joined.select("conv_id", "block", "turn", "text", "first", "last").repartition(n, "conv_id", "block")
    return ready.sortWithinPartitions("conv_id", "block", "turn", "text").mapInArrow(decode, "conv_id long, turn long, role string, rendered string")


def raw_transcripts(turns: DataFrame, unmarked: int = 3) -> DataFrame:
    """Transcript lines as they come from the wild: markers in several styles, one in ``unmarked`` without.

    Style and absence follow a hash of the conversation and turn.
    """
    h = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(unmarked))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (style + 1).cast("int"))
    mark = F.when(F.col("role") == "user", pick(("User: ", "### Human: ", "Q: ", "[customer]: "))).when(
        F.col("role") == "assistant", pick(("Assistant: ", "### AI: ", "A: ", "[agent]: "))
    ).when(F.col("role") == "system", pick(("System: ", "### Instructions: ", "Context: ", "[system]: "))).otherwise("")
    return turns.withColumn("text", F.concat(F.when(h == 0, "").otherwise(mark), F.coalesce("text", F.lit(""))))


def format_chats(turns: DataFrame) -> DataFrame:
    """Learn from conversations whose crc32(conv_id) mod 3 is not 1, parse all; adds ``held_out``."""
    held = lambda c: F.coalesce(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 3 == 1, F.lit(False))
    raw = raw_transcripts(turns)
    model = fit(raw.where(~held(F.col("conv_id"))))
    return parse(raw.select("conv_id", "turn", "text"), model).withColumn("held_out", held(F.col("conv_id")))
