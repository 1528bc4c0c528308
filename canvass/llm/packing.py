"""Harmonic packing of token ids into fixed-length sequences.

A piece of length r belongs to class k = capacity // r: k such pieces fit one sequence whatever
their exact lengths, so a worker fills the sequences of a class by counting to k and never looks
at the free space. Classes have few distinct numbers (63 for 1,024), so a worker holds at most one
open sequence per class. What stays open goes to a next level with far fewer workers, up to one
last worker whose rows are bounded by the number of classes and the fan-in; it closes by first fit.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import settle, small_batches
from canvass.llm.token_ids import encoder

PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, level int"
_ARROW = pa.schema([(n, pa.int64()) for n in PLACED.replace(" long", "").replace(" int", "").split(", ")[:-1]] + [("level", pa.int32())])


def cut_lengths(total: int, capacity: int = 1024, slack: int = 32) -> list[int]:
    """Piece lengths of a document of ``total`` ids.

    Full sequences first. A remainder stays whole when it wastes at most 1/``slack`` of its
    class's share of a sequence; else the largest share that it fills exactly is cut off.
    Each cut leaves less than 1/k of the piece, so there are few of them.
    """
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        k = capacity // rest
        share = capacity // k
        piece = rest if (share - rest) * slack <= share else capacity // (k + 1)
        out.append(piece)
        rest -= piece
    return out


class _Bins:
    """Open sequences of one worker, one per class."""

    def __init__(self, level: int, worker: int, capacity: int) -> None:
        self.next_id = (level << 56) | (worker << 32)
        self.level, self.capacity = level, capacity
        self.open: dict[int, list[tuple]] = {}

    def close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for piece in pieces:
            yield (*piece, self.next_id, at, self.level)
            at += piece[2]
        self.next_id += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        k = self.capacity // piece[2]
        mine = self.open.setdefault(k, [])
        mine.append(piece)
        if len(mine) == k:
            yield from self.close(self.open.pop(k))

    def left(self) -> Iterator[tuple]:
        for pieces in self.open.values():
            for piece in pieces:
                yield (*piece, None, None, self.level)

    def first_fit(self) -> Iterator[tuple]:
        """Decreasing first fit by free space; only for the last worker's bounded rest."""
        rest = sorted((p for ps in self.open.values() for p in ps), key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1]))
        bins: list[list[tuple]] = []
        free: list[tuple[int, int]] = []  # most free space first
        for piece in rest:
            if free and -free[0][0] >= piece[2]:
                space, at = heapq.heappop(free)
                bins[at].append(piece)
            else:
                space, at = -self.capacity, len(bins)
                bins.append([piece])
            heapq.heappush(free, (space + piece[2], at))
        for pieces in bins:
            yield from self.close(pieces)


def _rows(found: Iterable[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in found:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), _ARROW)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), _ARROW)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int = 0, capacity: int = 1024, fan_in: int = 32) -> DataFrame:
    """Pack every document's ids (with ``end`` after them) into sequences of ``capacity`` at most.

    One row per piece: which ids of which document, their crc32, and where they lie. A null or
    empty text is one piece, its end id. Null and repeated doc_ids are packed like any other
    row. No rows give no rows. Other columns of ``docs`` are not read.
    """

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = encoder(tokenizer), _Bins(0, TaskContext.get().partitionId(), capacity)

        def found() -> Iterator[tuple]:
            for batch in small_batches(batches):
                for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist(), end)):
                    total, at = len(ids) // 4, 0
                    for length in cut_lengths(total, capacity):
                        yield from bins.add((doc, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), total))
                        at += length
            yield from bins.left()

        yield from _rows(found())

    def merge(level: int, last: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bins = _Bins(level, TaskContext.get().partitionId(), capacity)

            def found() -> Iterator[tuple]:
                for batch in batches:
                    for piece in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                        yield from bins.add(piece)
                yield from bins.first_fit() if last else bins.left()

            yield from _rows(found())

        return run

    done = settle(docs.select("doc_id", "text").mapInArrow(first, PLACED))
    workers = max(1, docs.rdd.getNumPartitions())
    placed, level = done.where("sequence_id is not null"), 0
    while True:
        level, workers = level + 1, -(-workers // fan_in)
        left = done.where("sequence_id is null").repartition(workers)
        if workers > 1:
            left = left.sortWithinPartitions("doc_id", "start")
        done = settle(left.mapInArrow(merge(level, workers == 1), PLACED))
        placed = placed.unionByName(done.where("sequence_id is not null"))
        if workers == 1:
            return placed


def padding(placed: DataFrame, capacity: int = 1024) -> DataFrame:
    """Sequences, ids, and the padding a writer adds: none for a length that is a power of two."""
    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    exact = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    return used.agg(
        F.count(F.lit(1)).alias("sequences"), F.sum("used").alias("ids"),
        F.sum(F.when(exact, 0).otherwise(capacity - F.col("used"))).alias("padding"),
    )
