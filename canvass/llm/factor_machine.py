"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): every pair of
features interacts through its low-rank factors, at a cost linear in the features present.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import small_batches

BUCKETS = 1 << 14
_SYMBOLS, _MARKS = list(b"#*$%&|<>"), list(b"!?.,;:-")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
STATS = (
    "log_words", "log_chars", "mean_word", "symbols", "marks", "digits", "upper", "distinct_words", "repeated_next",
    "short_words", "words_per_line", "line_repeats", "long_words", "empty",
)


_SLOT: dict[str, int] = {}


def _slots(words: list[str]) -> np.ndarray:
    if len(_SLOT) > 400_000:
        _SLOT.clear()
    _SLOT.update((w, zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS) for w in set(words) if w not in _SLOT)
    return np.fromiter(map(_SLOT.__getitem__, words), np.int64, len(words))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words (slots, values of unit length) and structure statistics of a whole text."""
    text = text or ""
    words = text.split() if text.isascii() and "\x1c" not in text else _WORD.findall(text)
    n, chars = len(words), len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0), np.array([0.0] * (len(STATS) - 1) + [1.0])
    order = _slots(words)
    slots, counts = np.unique(order, return_counts=True)
    values = np.log1p(counts)
    values = values / np.sqrt((values * values).sum())
    byte = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip()]
    return slots, values, np.array([
        np.log1p(n), np.log1p(chars), sizes.mean(), byte[_SYMBOLS].sum() / n, byte[_MARKS].sum() / n, byte[48:58].sum() / chars,
        byte[65:91].sum() / chars, len(slots) / n, (order[1:] == order[:-1]).mean() if n > 1 else 0.0, (sizes <= 2).mean(),
        n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), (sizes > 12).mean(), 0.0,
    ])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # hashed words, then statistics
    factors: np.ndarray  # one row per feature
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, text: str | None, metadata: list[float]) -> tuple[np.ndarray, np.ndarray]:
        slots, values, stats = features(text)
        dense = np.clip((np.r_[stats, metadata] - self.mean) / self.scale, -5, 5)
        return np.r_[slots, BUCKETS + np.arange(len(dense))], np.r_[values, dense]

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        total = v.sum(axis=0)
        return self.bias + float(self.weights[at] @ x) + 0.5 * float(total @ total - (v * v).sum())

    def score(self, text: str | None, metadata: list[float]) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.margin(*self.inputs(text, metadata)), -35, 35))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], rank: int = 6, epochs: int = 4, rate: float = 0.05, decay: float = 1e-5, seed: int = 11) -> Machine:
    """Adagrad on log loss over (slots, values, statistics, label). No rows: every score is 0.5."""
    n_dense = len(rows[0][2]) if rows else len(STATS)
    dense = np.array([r[2] for r in rows]).reshape(-1, n_dense)
    mean = dense.mean(axis=0) if rows else np.zeros(n_dense)
    scale = np.maximum(dense.std(axis=0), 1e-6) if rows else np.ones(n_dense)
    rng = np.random.default_rng(seed)
    size = BUCKETS + n_dense
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.01, (size, rank)), mean, scale)
    g_bias, g_w, g_v = 1e-8, np.full(size, 1e-8), np.full((size, rank), 1e-8)
    ready = [(np.r_[s, BUCKETS + np.arange(n_dense)], np.r_[v, np.clip((d - mean) / scale, -5, 5)], y) for s, v, d, y in rows]
    for _ in range(epochs):
        for i in rng.permutation(len(ready)):
            at, x, y = ready[i]
            v = m.factors[at] * x[:, None]
            total = v.sum(axis=0)
            z = m.bias + m.weights[at] @ x + 0.5 * (total @ total - (v * v).sum())
            slip = 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))) - y
            if abs(slip) < 1e-3:
                continue
            dw = slip * x + decay * m.weights[at]
            dv = slip * x[:, None] * (total - v) + decay * m.factors[at]
            g_bias += slip * slip
            g_w[at] += dw * dw
            g_v[at] += dv * dv
            m.bias -= rate * slip / np.sqrt(g_bias)
            m.weights[at] -= rate * dw / np.sqrt(g_w[at])
            m.factors[at] -= rate * dv / np.sqrt(g_v[at])
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1, F.lit(False))


def _metadata(columns: tuple[str, ...], batch: pa.RecordBatch, first: int) -> list[list[float]]:
    values = [[np.log1p(max(0.0, float(v or 0))) for v in batch.column(first + i).to_pylist()] for i in range(len(columns))]
    return [list(x) for x in zip(*values)] if columns else [[] for _ in range(batch.num_rows)]


def train(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = (), most_rows: int = 6000) -> Machine:
    """Fit on at most ``most_rows`` labelled rows, drawn by a hash of doc_id from those not held out.

    Rows without a label or a document take no part. ``metadata`` names numeric columns of ``docs``.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # The most_rows smallest hashes; only (id, label) pairs are ordered, the bound caps what is kept.
    drawn = known.select("doc_id", F.col("quality").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most_rows)
    joined = docs.select("doc_id", "text", *metadata).join(F.broadcast(drawn), "doc_id").select("doc_id", "y", "text", *metadata)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = [features(t) for t in batch.column(2).to_pylist()]
            extra = _metadata(metadata, batch, 3)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()),
                pa.array([r[0].astype("<i4").tobytes() for r in rows], pa.binary()), pa.array([r[1].astype("<f4").tobytes() for r in rows], pa.binary()),
                pa.array([np.r_[r[2], e].astype("<f8").tobytes() for r, e in zip(rows, extra)], pa.binary()),
            ], names=["doc_id", "y", "slots", "values", "dense"])

    found = joined.mapInArrow(run, "doc_id long, y int, slots binary, values binary, dense binary").limit(most_rows).collect()
    rows = sorted(found, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, bytes(r.slots), r.y))
    return fit([
        (np.frombuffer(r.slots, "<i4").astype(np.int64), np.frombuffer(r["values"], "<f4").astype(np.float64), np.frombuffer(r.dense, "<f8"), r.y) for r in rows
    ])


def score(docs: DataFrame, machine: Machine, metadata: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a null text scores as an empty one."""
    parts = (machine.bias, machine.weights, machine.factors, machine.mean, machine.scale)
    shared = docs.sparkSession.sparkContext.broadcast(parts)  # fixed size: buckets x rank

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*shared.value)
        for batch in small_batches(batches):
            extra = _metadata(metadata, batch, 3)
            got = [m.score(t, e) for t, e in zip(batch.column(2).to_pylist(), extra)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text", *metadata)
    return kept.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ()) -> DataFrame:
    """Train on the labelled rows that are not held out, then score all documents."""
    return score(docs, train(docs, labels, metadata), metadata)
