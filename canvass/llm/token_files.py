"""Token ids as files: each document a zstandard frame under one shared dictionary, with an offset index.

``<name>.frames`` holds one frame per document. ``<name>.index`` holds, little-endian: 8 bytes of
magic, 32 bytes sha256 of the dictionary, then as unsigned 64-bit the number of documents and the bytes
per id; then per document an id (signed 64-bit), a byte that is 1 if the id is null, the number of ids
(64-bit), and n + 1 frame offsets (64-bit). The dictionary lies beside them under its hash.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.llm.common import settle, shuffle_parts, small_batches
from canvass.llm.token_ids import encoder
from canvass.session import shared_dir

MAGIC = b"IDFRAME1"
_MANIFEST = "shard int, name string, docs long, ids long, bytes long"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _stored(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


class Frames:
    """One written file pair, opened for single documents."""

    def __init__(self, folder: str, name: str, dictionary: bytes) -> None:
        store, path = _open(folder)
        with store.open_input_stream(f"{path}/{name}.index") as f:
            raw = f.read()
        if raw[:8] != MAGIC or raw[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name}: not an index of this dictionary")
        n, self.width = np.frombuffer(raw, "<u8", 2, 40).tolist()
        self.doc_id = np.frombuffer(raw, "<i8", n, 56)
        self.null = np.frombuffer(raw, "u1", n, 56 + 8 * n)
        self.n_ids = np.frombuffer(raw, "<u8", n, 56 + 9 * n).astype(np.int64)
        self.offset = np.frombuffer(raw, "<u8", n + 1, 56 + 17 * n).astype(np.int64)
        self.data = store.open_input_file(f"{path}/{name}.frames")
        self.decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def ids(self, at: int) -> np.ndarray:
        """Ids of one document: one seek, one frame."""
        self.data.seek(int(self.offset[at]))
        frame = self.data.read(int(self.offset[at + 1] - self.offset[at]))
        return np.frombuffer(self.decompress(frame), "<u2" if self.width == 2 else "<u4").astype("<u4")


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def train_dictionary(docs: DataFrame, tokenizer: str, end: int, width: int, sample_docs: int = 1000, sample_bytes: int = 8192, size: int = 32768) -> bytes:
    """A zstandard dictionary from the first ``sample_bytes`` of about ``sample_docs`` documents' ids.

    The sample is drawn by a hash of id and length and bounded by both parameters; only the
    training sees it. Too few samples give no dictionary: plain frames.
    """
    share = min(1.0, sample_docs / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids = encoder(tokenizer)(batch.column(0).to_pylist(), end)
            yield pa.RecordBatch.from_pydict({"ids": pa.array([_stored(x, width)[:sample_bytes] for x in ids], pa.binary())})

    rows = docs.where(drawn).select("text").mapInArrow(run, "ids binary").limit(2 * sample_docs).collect()
    samples = sorted(bytes(r.ids) for r in rows)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end: int = 1, width: int = 2, level: int = 3) -> tuple[DataFrame, bytes]:
    """Write all documents' ids in ascending doc_id order; returns the manifest and the dictionary.

    ``width`` is 2 for vocabularies below 65,536 ids, else 4. A null or empty text has the end id
    only; null doc_ids come first; repeated doc_ids follow each other. Extra columns are not read.
    Files get a name per attempt, and only what a finished task reported is in the manifest, so a
    lost or repeated task leaves at most files that nothing names.
    """
    spark = docs.sparkSession
    raw = train_dictionary(docs, tokenizer, end, width)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, compress = encoder(tokenizer), zstandard.ZstdCompressor(level=level, dict_data=_dictionary(raw)).compress
        store, path = _open(folder)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{os.urandom(6).hex()}"
        ids_of, counts, offsets, out = [], [], [0], None
        for batch in small_batches(batches):
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}.frames")
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist(), end)):
                frame = compress(_stored(ids, width))
                out.write(frame)
                ids_of.append(doc), counts.append(len(ids) // 4), offsets.append(offsets[-1] + len(frame))
        if out is None:
            return
        out.close()
        n = len(ids_of)
        with store.open_output_stream(f"{path}/{name}.index") as f:
            f.write(MAGIC + hashlib.sha256(raw).digest() + np.array([n, width], "<u8").tobytes())
            f.write(np.array([d or 0 for d in ids_of], "<i8").tobytes() + np.array([d is None for d in ids_of], "u1").tobytes())
            f.write(np.array(counts, "<u8").tobytes() + np.array(offsets, "<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "docs": [n], "ids": [sum(counts)], "bytes": [offsets[-1]]})

    store, path = _open(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/dictionary-{hashlib.sha256(raw).hexdigest()}") as f:
        f.write(raw)
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id")
    return settle(ordered.mapInArrow(run, _MANIFEST)), raw


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                frames = Frames(folder, row["name"], dictionary)
                starts = row["start"] + np.cumsum(frames.n_ids) - frames.n_ids
                crc, lengths = [], []
                for at in range(len(frames.doc_id)):
                    ids = frames.ids(at)
                    crc.append(zlib.crc32(ids.tobytes())), lengths.append(len(ids))
                doc_id = pa.array([None if gone else d for d, gone in zip(frames.doc_id.tolist(), frames.null)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [doc_id, pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    spread = placed.repartition(shuffle_parts(spark), "shard", "name")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end: int = 1) -> DataFrame:
    """Write, then read back."""
    folder = f"{shared_dir(docs.sparkSession)}/llm-ids-{os.urandom(8).hex()}"
    manifest, dictionary = write_token_files(docs, folder, tokenizer, end)
    return read_token_files(docs.sparkSession, folder, manifest, dictionary)
