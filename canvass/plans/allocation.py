"""Spreading amounts over values, and pairing rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.functions.parsing import half_even
from canvass.scale import has_at_most, prefix_sums


#: Up to this many values in all, one window per request is cheaper than range partitions; results are the same.
WINDOW_ROWS = 200_000


def weighted_requests(counts: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Spread ``requested`` over the values of each key by their frequency ``n``.

    Every value in turn gets max(1, round(requested * n / total)), never more than what is
    left; the last one takes the rest. Amounts before the cut-off depend on weights alone, so
    a running sum replaces the loop: over range partitions with carried totals, so that a
    request with very many values is spread over tasks. ``order`` must not have ties inside a key.
    """
    # One struct of the keys: equal also where a key is null.
    rows = counts.withColumn("__key", F.struct(*keys))
    totals = rows.groupBy("__key").agg(F.sum("n").alias("__total"), F.count(F.lit(1)).alias("__values"))
    rows = rows.join(totals, "__key").where(F.col("__total") > 0)
    raw = F.greatest(F.lit(1.0), half_even(F.col("requested") * F.col("n") / F.col("__total")))
    rows = rows.withColumn("__raw", raw)
    if has_at_most(counts, WINDOW_ROWS):
        upto = Window.partitionBy("__key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("__upto", F.sum("__raw").over(upto)).withColumn("__at", F.count(F.lit(1)).over(upto))
    else:
        rows = prefix_sums(rows, order, {"__upto": "__raw", "__at": F.lit(1)}, keys=["__key"])
    left = F.greatest(F.col("requested") - (F.col("__upto") - F.col("__raw")), F.lit(0.0))
    return (
        rows.withColumn("amount", F.when(F.col("__at") == F.col("__values"), left).otherwise(F.least("__raw", left)).cast("long"))
        .where(F.col("amount") > 0).drop("__key", "__total", "__values", "__raw", "__upto", "__at")
    )


def pair_rows(removed: DataFrame, chosen: DataFrame, id_column: str = "response_id") -> DataFrame:
    """i-th removed row with the i-th chosen row, both in id order; surplus rows stay unpaired."""
    left = prefix_sums(removed.select(id_column), [id_column], {"i": F.lit(1)})
    right = prefix_sums(chosen.select(id_column), [id_column], {"i": F.lit(1)})
    return left.select("i", F.col(id_column).alias("removed_id")).join(
        right.select("i", F.col(id_column).alias("replacement_id")), "i"
    ).drop("i")
