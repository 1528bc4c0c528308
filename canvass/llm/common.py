"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import gc
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.session import shared_dir

# The white space that separates words, as Java, RE2 and Python patterns read it.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD_BREAK_CHARS = " \t\n\x0b\x0c\r"

SHORT = 23  # bytes that ``short_keys`` can hold beside their number
_MASKS = np.array([[(1 << 8 * min(8, max(0, n - at))) - 1 for n in range(SHORT + 1)] for at in (0, 8, 16)], np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text: runs of characters that are not white space. A null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def free_prefix(df: DataFrame) -> str:
    """A prefix for added columns that no column of ``df`` begins with, whatever the case."""
    own = "__own_"
    while any(c.lower().startswith(own) for c in df.columns):
        own += "_"
    return own


def settle(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write a step to the shared folder and read it back.

    The lineage ends there, so a lost executor repeats one step at most. Shuffle files of
    the steps before are dropped when the JVM collects their handles; a long chain of steps
    asks for that here, or they would fill the disks until the next full collection.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{os.urandom(8).hex()}"
    _collect_garbage(spark)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    _collect_garbage(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def _collect_garbage(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*steps: DataFrame) -> None:
    """Delete settled steps that no later plan reads."""
    for df in steps:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches, so that what a task builds from one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@contextlib.contextmanager
def conf_during(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs that run inside the block."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def short_keys(raw: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of up to ``SHORT`` bytes as three numbers, equal for equal runs only: the size is in the last one's highest byte.

    ``raw`` has 24 bytes more than the runs need.
    """
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    out = np.empty((len(at), 3), np.uint64)
    for i in range(3):
        out[:, i] = eight[at + 8 * i] & _MASKS[i][size]
    out[:, 2] |= size.astype(np.uint64) << np.uint64(56)
    return out
