"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles.

A shingle is five consecutive words; its weight is its count in the text times the mean inverse document
frequency of its words, counted over all documents in hashed buckets of a fixed number. Samples are cut
into bands; documents that share a band meet its least document, and then all those of it that are not yet
in one class, block against block. Every link is verified by the weighted Jaccard similarity of the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import conf_during, discard, free_prefix, settle, shuffle_parts, small_batches
from canvass.llm.repeats import _ARROW, ByteWindows, HashedWords, mix, open_part, write_parts

WORDS = 5
BANDS, ROWS = 12, 3
LIKELY = 20  # of 36 samples that two texts share before they are compared
BLOCK = 1024  # members of a bucket that meet so many others of it in one row of work
BLOCK_BYTES = 1 << 22  # and the bytes of their texts; a longer text is a block by itself
FIRST = 8  # pairs of a node of a block that are verified at once, likest first
SLACK = 1e-3  # more than the rounding of similarities that are added up in single precision
FEATURES = 2048  # shingles that are added up at once
BUCKETS = 1 << 18
_U = np.uint64
_SPEC, _BYTES = HashedWords(), ByteWindows()


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draws by quantile: r and log c of the Gamma(2, 1) law, and an odd multiplier per sample."""
    def quantile(n: int) -> np.ndarray:
        p, low, high = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 60.0)
        for _ in range(60):
            mid = (low + high) / 2
            less = 1 - np.exp(-mid) * (1 + mid) < p
            low, high = np.where(less, mid, low), np.where(less, high, mid)
        return (low + high) / 2

    odd = mix(np.arange(1, BANDS * ROWS + 1, dtype=_U), 21) | _U(1)
    return quantile(1 << 12).astype(np.float32), np.log(quantile(1 << 16)).astype(np.float32), odd


_R, _LOG_C, _ODD = _tables()


def shingles(tok: np.ndarray, ends: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document, in order: document number, shingle, weight.

    A text of fewer than five words is one shingle of all its words; one without words has none.
    """
    doc, value, count, mean = counted(tok, ends, idf)
    return doc, value, count * mean


def counted(tok: np.ndarray, ends: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``shingles``, with the two factors of the weight: count in the text, mean inverse document frequency."""
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    sizes = ends - starts
    doc_of = np.repeat(np.arange(len(ends)), sizes)
    weight = idf[(tok % _U(BUCKETS)).astype(np.int64)].astype(np.float64)
    pad = np.r_[mix(tok, 31), np.zeros(WORDS, _U)]
    sums = np.r_[0.0, np.cumsum(weight)]
    at = np.arange(len(tok))
    size = np.minimum(WORDS, (ends - starts)[doc_of])
    own = at + size <= ends[doc_of]
    own &= (size == WORDS) | (at == starts[doc_of])
    at, size = at[own], size[own]
    value = size.astype(_U)
    for i in range(WORDS):
        value = value * _U(0x9E3779B97F4A7C15) + np.where(i < size, pad[at + i], _U(0))
    value, doc, mean = mix(value, 33), doc_of[at], (sums[at + size] - sums[at]) / np.maximum(size, 1)
    order = np.lexsort((value, doc))
    value, doc, mean = value[order], doc[order], mean[order]
    first = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])][: len(value)])
    count = np.diff(np.r_[first, len(value)])
    return doc[first], value[first], count, mean[first]


def sample(doc: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have shingles, and for each the hashes of its samples (documents x samples).

    Per sample and shingle: t = floor(log w / r + b), log a = log c - r (t - b) - r; the shingle with the
    least a is drawn, together with its t.
    """
    if not len(doc):
        return doc, np.zeros((0, len(_ODD)), _U)
    edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    out = np.zeros((len(edge), len(_ODD)), _U)
    log_w = np.log(weight).astype(np.float32)
    row = np.cumsum(np.r_[True, doc[1:] != doc[:-1]]) - 1
    for k, odd in enumerate(_ODD):
        h = value * odd
        r = _R[(h >> _U(52)).astype(np.int64)]
        b = ((h >> _U(20)) & _U(0xFFFF)).astype(np.float32) * np.float32(2**-16)
        t = np.floor(log_w / r + b)
        a = _LOG_C[((h >> _U(36)) & _U(0xFFFF)).astype(np.int64)] - r * (t - b + np.float32(1))
        least = np.flatnonzero(a == np.minimum.reduceat(a, edge)[row])
        drawn = least[np.r_[True, row[least][1:] != row[least][:-1]]]
        out[:, k] = mix(value[drawn] + t[drawn].astype(np.int64).astype(_U) * _U(0xD6E8FEB86659FD93), 41 + k)
    return doc[edge], out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sorted shingle vectors; 0 if either is empty."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    if not len(a[0]) or not len(b[0]):
        return 0.0
    same = b[0][at] == a[0]
    both = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of two blocks (x, y), or of one with itself, that have to be compared: side 0 or 1, node, label.

    They share enough samples with a node of another class, and no earlier band: two nodes are compared
    where they meet first. A row is a node, so there are no more rows than members, however many pairs.
    """

    def unpack(column: pa.Array, i: int) -> tuple[np.ndarray, ...]:
        cells = column[i].values
        sig = np.frombuffer(b"".join(cells.field("sig").to_pylist()), "<u2").reshape(-1, BANDS * ROWS)
        bands = cells.field("bands").flatten().to_numpy().reshape(-1, BANDS)
        return cells.field("node").to_numpy(), cells.field("label").to_numpy(), sig, bands

    names = ["band", "hash", "i", "j", "side", "node", "label"]
    for batch in batches:
        xs, ys = batch.columns[4:]
        for at in range(batch.num_rows):
            node, label, x, own = unpack(xs, at)
            itself = not ys[at].is_valid
            other, others, y, theirs = (node, label, x, own) if itself else unpack(ys, at)
            near = label[:, None] != others
            if not near.any():
                continue
            for k in range(batch.column(0)[at].as_py()):
                near &= own[:, k, None] != theirs[:, k]
            same = np.zeros(near.shape, np.int8)
            for a, b in zip(x.T, y.T):
                same += a[:, None] == b
            near &= same >= LIKELY
            a, b = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0)) if not itself else np.zeros(0, int)
            if len(a):
                key = [pa.array([batch.column(c)[at].as_py()] * (len(a) + len(b)), pa.int32() if c == 0 else pa.int64()) for c in range(4)]
                side = pa.array(np.repeat([0, 1], [len(a), len(b)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*key, side, pa.array(np.r_[node[a], other[b]], pa.int64()), pa.array(np.r_[label[a], others[b]], pa.int64())], names=names
                )


def similarities(x: Sequence[tuple], y: Sequence[tuple] | None) -> np.ndarray:
    """Weighted Jaccard similarity, but for rounding, of each text of ``x`` and each of ``y`` (None: of ``x`` again).

    Texts are (shingles, counts, means). A shingle's weight is its count times a mean that is the same in all
    texts, so the lesser of two weights adds the mean once for each count that both texts reach: a product of
    matrices of zeros and ones over (shingle, count).
    """

    def unfold(texts: Sequence[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        value, count, mean = (np.concatenate([t[i] for t in texts]) for i in range(3))
        row = np.repeat(np.repeat(np.arange(len(texts)), [len(t[0]) for t in texts]), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        weight = np.repeat(mean, count)
        return row, mix(np.repeat(value, count) + nth.astype(_U) * _U(0xD6E8FEB86659FD93), 35), weight, np.bincount(row, weight, len(texts))

    rows, keys, weights, sizes = unfold(x)
    rows2, keys2, _, sizes2 = unfold(y) if y is not None else (rows, keys, weights, sizes)
    if y is None:
        shared, seen = np.unique(keys, return_counts=True)
        shared = shared[seen > 1]
    else:
        shared = np.intersect1d(keys, keys2)

    def placed(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, keys)
        own = np.flatnonzero((at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == keys)) if len(shared) else np.zeros(0, int)
        own = own[np.argsort(at[own], kind="stable")]
        return at[own], rows[own], own

    at, row, own = placed(rows, keys)
    at2, row2, _ = placed(rows2, keys2)
    both = np.zeros((len(sizes), len(sizes2)))
    for low in range(0, len(shared), FEATURES):
        wide = min(FEATURES, len(shared) - low)
        a, b = (slice(*np.searchsorted(k, [low, low + wide])) for k in (at, at2))
        left, right = np.zeros((len(sizes), wide), np.float32), np.zeros((len(sizes2), wide), np.float32)
        left[row[a], at[a] - low] = weights[own[a]]
        right[row2[b], at2[b] - low] = 1
        both += left @ right.T
    if y is None:
        np.fill_diagonal(both, sizes)
    return both / np.maximum(sizes[:, None] + sizes2 - both, 1e-300)


def links_between(x: Sequence[tuple], y: Sequence[tuple] | None, label: np.ndarray, others: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs (place in x, place in y) of similarity ``threshold`` at least, as many as connect what all such pairs connect."""
    like = similarities(x, y)
    open_pairs = like >= threshold - SLACK
    if y is None:
        open_pairs = np.triu(open_pairs, 1)
        y = x
    _, root = np.unique(np.r_[label, others], return_inverse=True)
    out = []
    while True:
        open_pairs &= root[: len(x), None] != root[len(x) :]
        likest = np.where(open_pairs, like, -1.0)
        for a in np.flatnonzero(open_pairs.any(axis=1)).tolist():
            for b in np.argsort(-likest[a], kind="stable")[:FIRST].tolist():
                if not open_pairs[a, b]:
                    break
                open_pairs[a, b] = False
                one, two = root[a], root[len(x) + b]
                if one != two and weighted_jaccard(*[(t[0], t[1] * t[2]) for t in (x[a], y[b])]) >= threshold:
                    root[root == two] = one
                    out.append((a, b))
        if not open_pairs.any():
            return out


def _idf(parts: DataFrame) -> np.ndarray:
    """Inverse document frequency per word bucket, over all documents; at most BUCKETS rows reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for row in batch.to_pylist():
                part = open_part(row, _SPEC)
                slot = (part.tok % _U(BUCKETS)).astype(np.int64)
                doc = np.repeat(np.arange(len(part.ends)), np.diff(np.r_[0, part.ends]))
                seen += np.bincount(np.unique(doc * (BUCKETS + 1) + slot) % (BUCKETS + 1), minlength=BUCKETS + 1)
                seen[BUCKETS] += len(part.ends)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["slot", "n"])

    rows = parts.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS + 1)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return (np.log((1 + out[BUCKETS]) / (1 + out[:BUCKETS])) + 1).astype(np.float32)


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id of every row; class_id is the least doc_id of the class.

    Classes are the connected components of links: equal texts, and texts whose weighted Jaccard
    similarity is ``threshold`` or more. Texts without words only equal each other; a null text is
    empty. Rows that repeat a doc_id share its class; a null doc_id has a null class. Other columns are
    not read.

    Equal texts are one node from the start, so a text with a third of all rows is one. In each
    bucket the least node meets all others, spread over tasks; two nodes are compared if they share
    20 of their 36 samples at least, and only texts that are compared travel. Then the others of a
    bucket meet each other, linked or not, unless they are in one class by now: signatures block
    against block, then the texts of those nodes that have somebody to be compared with, all of a block
    against all of another in products of matrices. A block gives the links that connect its nodes, never
    its pairs. No bucket is capped. A pair at the threshold shares too few samples about once in 10,000 times, no
    band about once in 5,000.
    """
    spark = docs.sparkSession
    parts = write_parts(docs)
    with conf_during(spark, {_ARROW: "4"}):
        idf = spark.sparkContext.broadcast(_idf(parts))

        def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    part = open_part(row, _SPEC)
                    doc, drawn = sample(*shingles(part.tok, part.ends, idf.value))
                    bands = np.zeros((len(doc), BANDS), _U)
                    for i in range(ROWS):
                        bands = mix(bands + drawn[:, i::ROWS][:, :BANDS], 51)
                    # 120 bits of a text's hash tell texts apart
                    text = [xxhash.xxh3_128_digest(b) for b in part.bodies]
                    key = np.frombuffer(b"".join(text), "<i8").reshape(-1, 2)
                    lists: list = [None] * len(part.bodies)
                    sigs: list = [None] * len(part.bodies)
                    for i, d in enumerate(doc.tolist()):
                        lists[d] = bands[i].view(np.int64).tolist()
                        sigs[d] = drawn[i].astype("<u2").tobytes()
                    ids = pa.array([None if gone else x for x, gone in zip(part.ids.tolist(), part.null)], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["part"]] * len(lists), pa.int64()), ids, pa.array(key[:, 0]), pa.array(key[:, 1]),
                            pa.array(lists, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array([len(b) for b in part.bodies], pa.int64()),
                        ],
                        names=["part", "doc_id", "k1", "k2", "bands", "sig", "size"],
                    )

        signed = settle(parts.mapInArrow(sign, "part long, doc_id long, k1 long, k2 long, bands array<long>, sig binary, size long"))
    known = signed.where("doc_id is not null")
    nodes = settle(known.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "part", "bands", "sig", "size")).alias("x")).select("k1", "k2", F.col("x.doc_id").alias("node"), "x.part", "x.bands", "x.sig", "x.size"))
    members = nodes.select("node", "size", F.posexplode("bands").alias("band", "hash"))
    leaders = members.groupBy("band", "hash").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = settle(members.join(leaders, ["band", "hash"]))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """node, body (compressed) of the nodes asked for; ``wanted`` has node."""

        def show(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            squeeze = zstandard.ZstdCompressor(level=3).compress
            for batch in batches:
                for row in batch.to_pylist():
                    part, want = open_part(row, _BYTES), set(row["asked"])
                    found = {i: b for i, b, gone in zip(part.ids.tolist(), part.bodies, part.null) if i in want and not gone}
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(found), pa.int64()), pa.array([squeeze(b) for b in found.values()], pa.binary())], names=["node", "body"]
                    )

        asked = wanted.join(nodes.select("node", "part"), "node").groupBy("part").agg(F.collect_set("node").alias("asked"))
        with conf_during(spark, {_ARROW: "4"}):
            return settle(parts.join(asked, "part").mapInArrow(show, "node long, body binary"))

    def likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, BANDS * ROWS) for c in batch.columns[2:])
            yield batch.select(["lead", "node"]).filter(pa.array((x == y).sum(axis=1) >= LIKELY))

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor().decompress
        kept: dict[int, tuple] = {}

        def vector(node: int, body: bytes) -> tuple:
            if node not in kept:
                if len(kept) >= 64:
                    kept.clear()
                tok = _SPEC.tokens([plain(body)])[0]
                kept[node] = shingles(tok, np.array([len(tok)]), idf.value)[1:]
            return kept[node]

        for batch in small_batches(batches):
            lead, node, x, y = (c.to_pylist() for c in batch.columns)
            likeness = []
            for a, b, p, q in zip(lead, node, x, y):
                one = vector(a, p)
                tok = _SPEC.tokens([plain(q)])[0]
                likeness.append(weighted_jaccard(one, shingles(tok, np.array([len(tok)]), idf.value)[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(lead, pa.int64()), pa.array(node, pa.int64()), pa.array(likeness, pa.float64())], names=["lead", "node", "likeness"])

    def judge(pairs: DataFrame) -> DataFrame:
        """The links among pairs (lead, node), which are settled."""
        bodies = texts_of(pairs.select("node").union(pairs.select("lead")).distinct())
        texts = pairs.join(bodies.withColumnRenamed("body", "y"), "node").join(bodies.select(F.col("node").alias("lead"), F.col("body").alias("x")), "lead")
        judged = settle(texts.select("lead", "node", "x", "y").mapInArrow(verify, "lead long, node long, likeness double"))
        discard(bodies)
        return judged.where(F.col("likeness") >= threshold).select("lead", "node")

    def across(labels: DataFrame) -> DataFrame:
        """Members of the buckets that hold several classes, in blocks of about BLOCK; a bucket's lead has met all of it."""
        rest = settle(
            members.where("node <> lead").join(labels, "node", "left").select("band", "hash", "node", "size", F.coalesce("label", "node").alias("label"))
        )
        mixed = rest.groupBy("band", "hash").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_BYTES))
        mixed = mixed.where("low < high").select("band", "hash", F.greatest(blocks, F.lit(1)).alias("blocks"))
        cells = rest.drop("size").join(mixed, ["band", "hash"]).join(nodes.select("node", "sig", "bands"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        return settle(cells.groupBy("band", "hash", "blocks", "block").agg(F.collect_list(F.struct("node", "label", "sig", "bands")).alias("x")))

    def meetings(blocks: DataFrame) -> DataFrame:
        """band, hash, i, j, x, y: each block with itself (y is null), and each two blocks of a bucket."""
        own = blocks.select("band", "hash", F.col("block").alias("i"), F.col("block").alias("j"), "x", F.lit(None).cast(blocks.schema["x"].dataType).alias("y"))
        several = blocks.where("blocks > 1")
        if several.isEmpty():
            return own
        one = several.where("block + 1 < blocks").select("band", "hash", F.col("block").alias("i"), F.expr("explode(sequence(block + 1, blocks - 1))").alias("j"), "x")
        two = several.where("block > 0").select("band", "hash", F.expr("explode(sequence(0L, block - 1))").alias("i"), F.col("block").alias("j"), F.col("x").alias("y"))
        return own.unionByName(one.join(two, ["band", "hash", "i", "j"]))

    def connect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor().decompress

        def text(body: bytes) -> tuple:
            tok = _SPEC.tokens([plain(body)])[0]
            return counted(tok, np.array([len(tok)]), idf.value)[1:]

        for batch in batches:
            for i in range(batch.num_rows):
                cells = batch.column(0)[i].values
                side, node, label = (cells.field(f).to_numpy() for f in ("side", "node", "label"))
                texts = [text(b.as_py()) for b in cells.field("body")]
                x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                y = y if len(y) else x
                found = links_between([texts[k] for k in x], [texts[k] for k in y] if y is not x else None, label[x], label[y], threshold)
                ends = np.array([(node[x[a]], node[y[b]]) for a, b in found], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1, initial=2**63 - 1)), pa.array(ends.max(axis=1, initial=-(2**63)))], names=["lead", "node"])

    sigs = nodes.select("node", "sig")
    pairs = members.where("node <> lead").select("lead", "node").distinct().join(sigs.withColumnRenamed("sig", "y"), "node").join(
        sigs.select(F.col("node").alias("lead"), F.col("sig").alias("x")), "lead"
    )
    close = settle(pairs.select("lead", "node", "x", "y").mapInArrow(likely, "lead long, node long"))
    labels = components(judge(close))
    blocks = across(labels)
    with conf_during(spark, {_ARROW: "256"}):
        met = settle(meetings(blocks).select("band", "hash", "i", "j", "x", "y").mapInArrow(meet, "band int, hash long, i long, j long, side int, node long, label long"))
    discard(blocks)
    if not met.isEmpty():
        bodies = texts_of(met.select("node").distinct())
        grouped = met.join(bodies, "node").groupBy("band", "hash", "i", "j").agg(F.collect_list(F.struct("side", "node", "label", "body")).alias("x"))
        with conf_during(spark, {_ARROW: "4"}):
            more = settle(grouped.select("x").mapInArrow(connect, "lead long, node long"))
        discard(bodies)
        if not more.isEmpty():
            labels = merge(labels, more.distinct())
    discard(met)
    discard(parts)
    classed = nodes.select("k1", "k2", "node").join(labels, "node", "left").select("k1", "k2", F.coalesce("label", "node").alias("class_id"))
    return known.select("doc_id", "k1", "k2").join(classed, ["k1", "k2"]).select("doc_id", "class_id").unionByName(
        signed.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    )


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node it is connected to. Links (lead, node) hold both ends; labels go along
    links and are then looked up once more, so paths halve in each round."""
    both = settle(links.unionByName(links.select(F.col("node").alias("lead"), F.col("lead").alias("node"))).distinct())
    labels = settle(both.groupBy("node").agg(F.least(F.col("node"), F.min("lead")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("lead"), "label"), "lead").groupBy("node").agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        after = settle(
            moved.join(labels.select(F.col("node").alias("to"), F.col("label").alias("far")), "to", "left")
            .select("node", F.col("label").alias("was"), F.least("to", "far").alias("label"))
        )
        labels = after.select("node", "label")
        if after.where("was <> label").isEmpty():
            return labels


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels of ``components`` after further links, which are followed between classes only."""
    ends = links
    for end in ("lead", "node"):
        known = labels.select(F.col("node").alias(end), F.col("label").alias("__label"))
        ends = ends.join(known, end, "left").withColumn(end, F.coalesce("__label", end)).drop("__label")
    step = components(ends)
    moved = labels.join(step.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    fresh = step.join(labels.select("node"), "node", "left_anti")
    return settle(moved.select("node", F.coalesce("to", "label").alias("label")).unionByName(fresh.select("node", "label")))


def keep_first(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its class, or null. Rows that repeat a doc_id go or stay together."""
    gone = f"{free_prefix(docs)}gone"
    others = near_duplicates(docs, threshold).where("doc_id <> class_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(others, F.col("doc_id") == F.col(gone), "left_anti")
