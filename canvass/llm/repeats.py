"""Windows of fixed length that recur across documents, found without moving the texts.

Every window of ``length`` tokens has an anchor: the least hash of the ``gram``-token runs in it. Equal
windows have equal anchors, and neighbouring windows mostly share one, so a text is a chain of short
segments, each the windows of one anchor. Segments are exchanged by anchor and whole-segment hash:

* an anchor met in one document only is done with: none of its windows recur;
* an anchor whose segments are all equal is settled: all its windows start first in the least doc_id;
* segments that differ under one anchor are refined by most-significant-digit passes over their windows.

So this is a radix order of the suffixes cut at ``length`` tokens, whose first two digits are the anchor
and the segment hash, and which goes deeper only where a bucket still holds different windows. Texts
travel as compressed parts of about a megabyte, each one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm.common import SHORT, WORD_BREAK_CHARS, conf_during, discard, settle, short_keys, shuffle_parts, small_batches

_U = np.uint64
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
LONGEST_RUN = 256  # windows of one segment; longer runs are cut, which only costs refinement
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x ^ _U(salt)) * _U(_BASE)
    x = (x ^ (x >> _U(32))) * _U(_MIX)
    return x ^ (x >> _U(29))


_GAP = np.isin(np.arange(256), list(WORD_BREAK_CHARS.encode()))
_LOT = 1 << 16  # words that are hashed at once


@dataclass(frozen=True)
class ByteWindows:
    length: int = 50
    gram: int = 16

    def tokens(self, bodies: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(b, np.uint8) for b in bodies]

    def pack(self, tok: np.ndarray) -> bytes:
        return tok.astype(np.uint8).tobytes()

    def unpack(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.uint8).astype(_U)

    def digits(self, tok: np.ndarray) -> Iterator[np.ndarray]:
        """Digits of the window that starts at each token: eight bytes at a time, the last ones overlapping."""
        eight = tok
        for width in (1, 2, 4):
            eight = (eight[: len(eight) - width] << _U(8 * width)) | eight[width:]
        size = min(8, self.length)
        for at in [*range(0, self.length - size, size), self.length - size]:
            yield eight[at:] if size == 8 else tok[at:]


@dataclass(frozen=True)
class WordWindows:
    length: int = 13
    gram: int = 5

    def tokens(self, bodies: list[bytes]) -> list[np.ndarray]:
        """One 64-bit hash per word; words are cut at the six white-space characters and no others.

        Words of up to 23 bytes are read as three numbers for all bodies at once; mixing is one-to-one in each of them.
        """
        raw = b"".join(bodies) + bytes(24)
        held = np.array([len(b) for b in bodies], np.int64)
        ends = np.cumsum(held)
        gap = _GAP[np.frombuffer(raw, np.uint8)]
        begin, end = np.zeros(len(raw), bool), gap.copy()
        begin[1:] = gap[:-1]  # behind white space, or a text's first byte
        begin[ends - held] = True
        end[ends] = True  # white space, or the next text
        at, edge = np.flatnonzero((begin & ~gap)[: len(raw) - 24]), np.flatnonzero(end)
        size = edge[np.searchsorted(edge, at, side="right")] - at
        out = np.empty(len(at), _U)
        for a in range(0, len(at), _LOT):
            some, sizes = at[a : a + _LOT], size[a : a + _LOT]
            keys = short_keys(raw, some, np.minimum(sizes, SHORT))
            out[a : a + _LOT] = mix(mix(mix(keys[:, 0], 21) ^ keys[:, 1], 22) ^ keys[:, 2], 23)
        for i in np.flatnonzero(size > SHORT).tolist():
            out[i] = xxhash.xxh3_64_intdigest(raw[at[i] : at[i] + size[i]])
        return np.split(out, np.searchsorted(at, ends[:-1])) if bodies else []

    def pack(self, tok: np.ndarray) -> bytes:
        return tok.astype("<u8").tobytes()

    def unpack(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, "<u8")

    def digits(self, tok: np.ndarray) -> Iterator[np.ndarray]:
        for at in range(self.length):
            yield tok[at:]


_WORDS: dict[bytes, int] = {}


@dataclass(frozen=True)
class HashedWords(WordWindows):
    """The same words by xxh3: hashes whose order and bits decide what near-duplicate search samples."""

    def tokens(self, bodies: list[bytes]) -> list[np.ndarray]:
        if len(_WORDS) > 400_000:
            _WORDS.clear()
        out = []
        for body in bodies:
            words = body.split()
            _WORDS.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words) if w not in _WORDS)
            out.append(np.fromiter(map(_WORDS.__getitem__, words), _U, len(words)))
        return out


@dataclass
class Part:
    """Documents of one part: ids, bodies, and all their tokens in a row."""

    ids: np.ndarray
    null: np.ndarray
    bodies: list[bytes]
    tok: np.ndarray
    ends: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.r_[0, self.ends[:-1]].astype(np.int64)


@dataclass
class Segments:
    start: np.ndarray  # first window, as a token number in the part
    count: np.ndarray  # windows
    doc: np.ndarray  # document number in the part
    anchor: np.ndarray
    content: np.ndarray


def write_parts(docs: DataFrame, size: int = 1 << 20) -> DataFrame:
    """Documents as rows of about ``size`` bytes of text. A document is never split: it must fit a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, bodies, held = TaskContext.get().partitionId() << 32, [], [], 0
        squeeze = zstandard.ZstdCompressor(level=1).compress

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "part": pa.array([number], pa.int64()), "ids": [np.array([i or 0 for i in ids], "<i8").tobytes()],
                "none": [np.array([i is None for i in ids], "u1").tobytes()],
                "ends": [np.cumsum([len(b) for b in bodies]).astype("<i8").tobytes()], "body": [squeeze(b"".join(bodies))],
            })

        for batch in small_batches(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = (text or "").encode("utf-8", "surrogatepass")
                ids.append(doc), bodies.append(body)
                held += len(body) + 32
                if held >= size:
                    yield row()
                    number, ids, bodies, held = number + 1, [], [], 0
        if ids:
            yield row()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return settle(plain.mapInArrow(run, "part long, ids binary, none binary, ends binary, body binary"))


def open_part(row: dict, spec) -> Part:
    ends = np.frombuffer(row["ends"], "<i8")
    body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=int(ends[-1]) + 1) if ends[-1] else b""
    bodies = [body[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    toks = spec.tokens(bodies)
    return Part(
        np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["none"], "u1").astype(bool), bodies,
        np.concatenate(toks).astype(_U), np.cumsum([len(t) for t in toks]).astype(np.int64),
    )


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if span < width else h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


def _pieces(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows cut after each ``LONGEST_RUN``."""
    if not len(count) or count.max() <= LONGEST_RUN:
        return start, count
    pieces = -(-count // LONGEST_RUN)
    at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(start, pieces) + at * LONGEST_RUN, np.minimum(LONGEST_RUN, np.repeat(count, pieces) - at * LONGEST_RUN)


def segments(part: Part, spec) -> Segments:
    tok, n = part.tok, len(part.tok) - spec.length + 1
    doc_of = np.repeat(np.arange(len(part.ends)), np.diff(np.r_[0, part.ends]))
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none, none)
    gram, width = mix(tok, 1), 1
    while width * 2 <= spec.gram:  # hashes of runs of twice the width from two of half
        gram = gram[:-width] * _U(pow(_BASE, width, 1 << 64)) + gram[width:]
        width *= 2
    if width < spec.gram:
        rest = spec.gram - width  # two overlapping runs cover the gram
        gram = gram[:-rest] * _U(_MIX) + gram[rest:]
    anchor = _least(mix(gram, 2), spec.length - spec.gram + 1)
    valid = doc_of[:n] == doc_of[spec.length - 1 :]
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    stop = ~valid
    stop[1:] &= valid[:-1]
    edges = np.flatnonzero(begin | stop)
    lasts = np.r_[edges[1:], n]
    own = begin[edges]
    start, count = edges[own], (lasts - edges)[own]
    start, count = _pieces(start, count)
    return Segments(start, count, doc_of[start], (anchor[start] >> _U(16)).astype(np.int64), _hash_spans(tok, start, start + count + spec.length - 1, 3))


def _hash_spans(tok: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of token runs, equal for equal runs wherever they lie."""
    sums = np.r_[_U(0), np.cumsum(mix(tok, salt) * _powers(_BASE, len(tok)), dtype=_U)]
    value = (sums[end] - sums[start]) * _powers(_INVERSE, len(tok) + 1)[start]
    return mix(value + (end - start).astype(_U) * _U(_MIX), salt).view(np.int64)


def _key(anchor: np.ndarray, content: np.ndarray) -> np.ndarray:
    return mix(anchor.astype(np.int64).view(_U), 5) ^ content.astype(np.int64).view(_U)


def _lists(batch: pa.RecordBatch, name: str, at: int) -> list[np.ndarray]:
    """Fields of the structs in a list column's row."""
    column = batch.column(batch.schema.get_field_index(name))
    if not column[at].is_valid:
        return []
    values = column[at].values
    return [values.field(i) for i in range(values.type.num_fields)]


def _emit_segments(spec):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = open_part(row, spec)
                s = segments(part, spec)
                keep = ~part.null[s.doc] if len(s.doc) else np.zeros(0, bool)
                ids, anchor, content = part.ids[s.doc[keep]], s.anchor[keep], s.content[keep]
                order = np.lexsort((ids, content, anchor))
                ids, anchor, content = ids[order], anchor[order], content[order]
                first = np.r_[True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])][: len(ids)]
                at = np.flatnonzero(first)
                last = np.r_[at[1:], len(ids)] - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (anchor[at], content[at], np.full(len(at), row["part"]), ids[at], ids[at] != ids[last[: len(at)]])],
                    names=["anchor", "content", "part", "doc", "several"],
                )

    return run


def _emit_mixed(spec):
    """Tokens of the segments that a part is asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                asked = _lists(batch, "asked", at)
                part = open_part(batch.slice(at, 1).drop_columns(["asked"]).to_pylist()[0], spec)
                s = segments(part, spec)
                anchor, content, first, big = (x.to_numpy(zero_copy_only=False) for x in asked)
                want = _key(anchor, content)
                order = np.argsort(want)
                keys, where = np.unique(_key(s.anchor, s.content), return_index=True)
                place = np.minimum(np.searchsorted(want[order], keys), len(want) - 1)
                hit = want[order][place] == keys
                found, of = where[hit], order[place[hit]]
                packed = [spec.pack(part.tok[a : a + c + spec.length - 1]) for a, c in zip(s.start[found].tolist(), s.count[found].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[of]), pa.array(content[of]), pa.array(first[of]), pa.array(big[of]), pa.array(packed, pa.binary())],
                    names=["anchor", "content", "first", "big", "tokens"],
                )

    return run


def radix_first(spec, group: np.ndarray, first: np.ndarray, tok: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each segment, the least ``first`` among the segments of its group that hold it;
    and where the windows of each segment end. ``tok`` has the segments' tokens, ``sizes`` their numbers.

    Most-significant-digit passes: windows are ordered by digit inside their bucket; a bucket of one
    window is done; what is left after the last digit are buckets of equal windows.
    """
    counts = sizes - spec.length + 1
    seg = np.repeat(np.arange(len(sizes)), counts)
    base = np.cumsum(sizes) - sizes
    start = base[seg] + np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = first[seg].copy()
    active = np.argsort(group[seg], kind="stable")
    bucket = group[seg][active]
    for digit in spec.digits(tok):
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[edge, len(bucket)])
        value = digit[start[active]]
        # Only buckets that this digit splits are put in order.
        split = np.add.reduceat(value != np.repeat(value[edge], sizes), edge) > 0
        some = np.flatnonzero(np.repeat(split, sizes))
        if len(some):
            order = some[np.lexsort((value[some], bucket[some]))]
            value[some], active[some] = value[order], active[order]
        new = np.r_[True, (value[1:] != value[:-1]) | (bucket[1:] != bucket[:-1])]
        bucket = np.cumsum(new) - 1
        many = np.bincount(bucket)[bucket] > 1
        active, bucket = active[many], bucket[many]
        if not len(active):
            break
    if len(active):
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        least = np.minimum.reduceat(out[active], edge)
        out[active] = np.repeat(least, np.diff(np.r_[edge, len(active)]))
    return out, np.cumsum(counts)


def _runs(first: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    at = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
    return at.tolist(), np.diff(np.r_[at, len(first)]).tolist(), first[at].tolist()


_FOUND = "anchor long, content long, offs array<int>, lens array<int>, firsts array<long>"


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["anchor", "content", "offs", "lens", "firsts"])


def _refine(spec, most: int = 8000):
    """Segments sorted by anchor; whole anchors are gathered until there are ``most`` segments."""

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        anchor, content, first = (table.column(i).to_numpy() for i in range(3))
        raw = table.column(3).to_pylist()
        width = len(spec.pack(np.zeros(1, _U)))
        sizes = np.array(list(map(len, raw))) // width
        tok = spec.unpack(b"".join(raw))
        group = np.cumsum(np.r_[0, anchor[1:] != anchor[:-1]])
        low, ends = radix_first(spec, group, first, tok, sizes)
        begins = np.zeros(len(low), bool)
        begins[np.r_[0, ends[:-1]]] = True
        at = np.flatnonzero(begins | np.r_[True, low[1:] != low[:-1]])
        owner = np.searchsorted(ends, at, side="right")
        edge = pa.array(np.r_[0, np.cumsum(np.bincount(owner, minlength=len(sizes)))].astype(np.int32))
        offs = (at - np.r_[0, ends[:-1]][owner]).astype(np.int32)
        lens = np.diff(np.r_[at, len(low)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(edge, pa.array(x)) for x in (offs, lens, low[at])]
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content), *lists], names=["anchor", "content", "offs", "lens", "firsts"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in small_batches(batches, 4096):
            if held and sum(b.num_rows for b in held) >= most:
                anchor = batch.column(0).to_numpy()
                same = int(np.argmax(anchor != held[-1].column(0)[-1].as_py())) if (anchor != held[-1].column(0)[-1].as_py()).any() else len(anchor)
                if same:
                    held.append(batch.slice(0, same))
                if same < batch.num_rows:
                    yield done(held)
                    held, batch = [], batch.slice(same)
                else:
                    continue
            held.append(batch)
        if held:
            yield done(held)

    return run


def _windows(spec):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 512):
            rows = list(zip(*[c.to_pylist() for c in batch.columns]))
            toks = [spec.unpack(r[3]) for r in rows]
            counts = np.array([len(t) - spec.length + 1 for t in toks])
            base = np.cumsum([len(t) for t in toks]) - np.array([len(t) for t in toks])
            seg = np.repeat(np.arange(len(rows)), counts)
            off = np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts)
            tok, start = np.concatenate(toks), base[seg] + off
            col = lambda i: np.array([r[i] for r in rows], np.int64)[seg]
            yield pa.RecordBatch.from_arrays([
                pa.array(x) for x in (col(0), col(1), col(2), off.astype(np.int32), _hash_spans(tok, start, start + spec.length, 11), _hash_spans(tok, start, start + spec.length, 13))
            ], names=["anchor", "content", "first", "off", "w1", "w2"])

    return run


def _join_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 512):
        out = []
        for row in batch.to_pylist():
            pairs = sorted((x["off"], x["low"]) for x in row["windows"])
            out.append((row["anchor"], row["content"], *_runs(np.array([p[1] for p in pairs], np.int64))))
        if out:
            yield _found_batch(out)


@dataclass
class Hits:
    """Recurring windows of one part: runs of windows and the least doc_id in which each run's windows start."""

    start: np.ndarray
    count: np.ndarray
    first: np.ndarray
    doc: np.ndarray

    def passages(self) -> Hits:
        """Runs that follow each other in a document and start first in the same one, as one; of ``LONGEST_RUN`` windows at most."""
        if not len(self.start):
            return self
        order = np.argsort(self.start, kind="stable")
        start, count, first, doc = (x[order] for x in (self.start, self.count, self.first, self.doc))
        new = np.r_[True, (start[1:] != start[:-1] + count[:-1]) | (first[1:] != first[:-1]) | (doc[1:] != doc[:-1])]
        at = np.flatnonzero(new)
        begin, n = _pieces(start[at], np.add.reduceat(count, at))
        of = at[np.searchsorted(start[at], begin, side="right") - 1]
        return Hits(begin, n, first[of], doc[of])


def _hits(batch: pa.RecordBatch, at: int, part: Part, spec) -> Hits:
    s = segments(part, spec)
    start, count, first, doc = [], [], [], []
    single = _lists(batch, "single", at)
    if single:
        anchor, least = (x.to_numpy(zero_copy_only=False) for x in single)
        order = np.argsort(anchor)
        place = np.minimum(np.searchsorted(anchor[order], s.anchor), len(anchor) - 1)
        hit = np.flatnonzero(anchor[order][place] == s.anchor)
        start.append(s.start[hit]), count.append(s.count[hit]), doc.append(s.doc[hit]), first.append(least[order][place[hit]])
    mixed = _lists(batch, "mixed", at)
    if mixed:
        want = _key(mixed[0].to_numpy(zero_copy_only=False), mixed[1].to_numpy(zero_copy_only=False))
        order = np.argsort(want)
        keys = _key(s.anchor, s.content)
        place = np.minimum(np.searchsorted(want[order], keys), len(want) - 1)
        hit = np.flatnonzero(want[order][place] == keys)
        row = order[place[hit]]
        offs, lens, firsts = mixed[2], mixed[3], mixed[4]
        edge = offs.offsets.to_numpy().astype(np.int64)
        flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (offs, lens, firsts)]
        edge = edge - edge[0]
        n = edge[row + 1] - edge[row]
        inner = np.repeat(edge[row], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start.append(np.repeat(s.start[hit], n) + flat[0][inner]), count.append(flat[1][inner])
        first.append(flat[2][inner]), doc.append(np.repeat(s.doc[hit], n))
    cat = lambda xs: np.concatenate(xs).astype(np.int64) if xs else np.zeros(0, np.int64)
    return Hits(cat(start), cat(count), cat(first), cat(doc))


Finish = Callable[[Part, Hits], pa.RecordBatch]


def with_repeats(docs: DataFrame, spec, finish: Finish, schema: str, most_local: int = 16_000, part_bytes: int = 1 << 20) -> DataFrame:
    """Run ``finish`` on every part of ``docs`` with the recurring windows of its documents.

    A window recurs for a document if a document with a smaller doc_id holds it too. Null doc_ids take
    no part in the order: nothing is found in them or through them. Anchors with more than
    ``most_local`` different segments are not refined in one task: their windows are aggregated one by one.
    """
    spark = docs.sparkSession
    n = shuffle_parts(spark)
    parts = write_parts(docs, part_bytes)
    with conf_during(spark, {_ARROW: "4"}):
        rows = parts.mapInArrow(_emit_segments(spec), "anchor long, content long, part long, doc long, several boolean")
        by_anchor, by_content = Window.partitionBy("anchor"), Window.partitionBy("anchor", "content")
        known = (
            rows.withColumn("least", F.min("doc").over(by_anchor)).withColumn("most", F.max("doc").over(by_anchor))
            .withColumn("shared", F.max("several").over(by_anchor))
            .withColumn("mixed", F.min("content").over(by_anchor) != F.max("content").over(by_anchor))
            .where((F.col("least") != F.col("most")) | F.col("shared"))
            .withColumn("first", F.when(F.col("mixed"), F.min("doc").over(by_content)).otherwise(F.col("least")))
            .withColumn("speaks", F.row_number().over(by_content.orderBy("part")) == 1)
            .withColumn("segments", F.sum(F.col("speaks").cast("long")).over(by_anchor))
        )
        recurring = settle(known.select("part", "anchor", F.when(F.col("mixed"), F.col("content")).alias("content"), "first", "mixed", "speaks", (F.col("segments") > most_local).alias("big")))
        asked = recurring.where("mixed and speaks").groupBy("part").agg(F.collect_list(F.struct("anchor", "content", "first", "big")).alias("asked"))
        spoken = settle(parts.join(asked, "part").mapInArrow(_emit_mixed(spec), "anchor long, content long, first long, big boolean, tokens binary"))
    columns = ["anchor", "content", "first", "tokens"]
    small = spoken.where("not big").select(*columns).repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_refine(spec), _FOUND)
    wide = settle(spoken.where("big").select(*columns).mapInArrow(_windows(spec), "anchor long, content long, first long, off int, w1 long, w2 long"))
    least = wide.groupBy("w1", "w2").agg(F.min("first").alias("low"))
    large = wide.join(least, ["w1", "w2"]).groupBy("anchor", "content").agg(F.collect_list(F.struct("off", "low")).alias("windows")).mapInArrow(_join_runs, _FOUND)
    found = settle(small.unionByName(large))
    discard(spoken, wide)
    single = recurring.where("not mixed").groupBy("part").agg(F.collect_list(F.struct("anchor", "first")).alias("single"))
    mixed = recurring.where("mixed").select("part", "anchor", "content").join(found, ["anchor", "content"]).groupBy("part").agg(
        F.collect_list(F.struct("anchor", "content", "offs", "lens", "firsts")).alias("mixed")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                part = open_part(batch.slice(at, 1).drop_columns(["single", "mixed"]).to_pylist()[0], spec)
                yield finish(part, _hits(batch, at, part, spec))

    asked_for = settle(single.join(mixed, "part", "full"))
    discard(recurring, found)
    with conf_during(spark, {_ARROW: "4"}):
        out = settle(parts.join(asked_for, "part", "left").mapInArrow(run, schema))
    discard(parts, asked_for)
    return out


def covered(part: Part, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Tokens inside any of the spans [start, end)."""
    change = np.zeros(len(part.tok) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0
