"""Numbering, prefix sums and size checks that hold when one key owns most of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.session import materialise

HASH_BITS = 12


def hash_order(seed: int, *columns: str | Column) -> Column:
    """A stable pseudo-random order: same value for the same row on every run and partitioning."""
    return F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in columns])


def hash_uniform(seed: int, *columns: str | Column) -> Column:
    """Uniform in (0, 1), taken from 52 bits of the row hash."""
    bits = F.shiftrightunsigned(hash_order(seed, *columns), 12)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def number_by_hash(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    *,
    tie: Sequence[str],
    out: str = "rn",
    limit: Column | None = None,
) -> DataFrame:
    """Dense numbers 1..n inside each key, in hash order, without one task per key.

    Rows fall into 4096 hash buckets per key; bucket totals give each bucket its first
    number, so the window only ever sorts one bucket. With ``limit`` whole buckets past
    the limit are dropped before any row is sorted.
    """
    keys = list(keys)
    rows = df.withColumn("__order", order).withColumn(
        "__bucket", F.shiftright("__order", 64 - HASH_BITS)
    )
    totals = rows.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    joined = rows.join(starts, [*keys, "__bucket"])
    if limit is not None:
        joined = joined.where(F.col("__start") < limit)
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__order", *tie)
    numbered = joined.withColumn(out, (F.col("__start") + F.row_number().over(inside)).cast("long"))
    if limit is not None:
        numbered = numbered.where(F.col(out) <= limit)
    return numbered.drop("__order", "__bucket", "__start")


def prefix_sums(
    df: DataFrame,
    order: Sequence[str | Column],
    sums: Mapping[str, str | Column],
    *,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sums in a global order, split over range partitions.

    Range partitions keep the order between tasks, their totals (one row per key and
    partition) give the carry-in, and the window only sums inside one partition.
    The range split is written out first: its bounds are sampled and must not move
    between the totals and the rows.
    """
    spark = df.sparkSession
    keys = list(keys)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = materialise(
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *order_cols).withColumn(
            "__part", F.spark_partition_id()
        )
    )
    values = {out: (F.col(c) if isinstance(c, str) else c) for out, c in sums.items()}
    totals = split.groupBy(*keys, "__part").agg(
        *[F.sum(c).alias(f"__total_{out}") for out, c in values.items()]
    )
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        "__part",
        *[
            F.coalesce(F.sum(f"__total_{out}").over(before), F.lit(0)).alias(f"__carry_{out}")
            for out in values
        ],
    )
    inside = (
        Window.partitionBy(*keys, "__part")
        .orderBy(*order_cols)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = split.join(carry, [*keys, "__part"])
    for out, value in values.items():
        joined = joined.withColumn(out, F.col(f"__carry_{out}") + F.sum(value).over(inside))
    return joined.drop("__part", *[f"__carry_{out}" for out in values])


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Size check that stops counting just past the bound."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast a dimension only after counting it; otherwise leave the join to Spark."""
    return F.broadcast(df) if has_at_most(df, rows) else df


def join_dimension(rows: DataFrame, dimension: DataFrame, on: str | Sequence[str], how: str = "inner", most: int = 100_000) -> DataFrame:
    """Broadcast the dimension only after counting it, otherwise merge; ``rows`` are never broadcast.

    AQE goes by compressed bytes: many small rows look small to it and are large in a hashed relation.
    """
    return rows.join(F.broadcast(dimension) if has_at_most(dimension, most) else dimension.hint("merge"), on, how)


def explode_count(df: DataFrame, amount: Column, out: str, block: int = 4096) -> DataFrame:
    """Repeat each row ``amount`` times, numbered from 1.

    Blocks are exploded first and spread over tasks, so that one row asking for billions of
    copies neither builds a huge array nor keeps one task busy. The number of tasks is given: the
    blocks are few and small, and AQE, which sees only their bytes, would put them into one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = df.withColumn("__amount", amount.cast("long")).where(F.col("__amount") > 0).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__amount") - 1) / block))).alias("__block")
    )
    first = F.col("__block") * block
    return blocks.repartition(parts, "__block", *df.columns[:1]).select(
        *df.columns, F.explode(F.sequence(first + 1, F.least(first + block, F.col("__amount")))).alias(out)
    )
