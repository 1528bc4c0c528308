"""What the pool must contain: one table of (given values, injected values, amount).

Small inputs come as tables of scores; frequencies come from aggregates over the source.
All request kinds end in the same columns, so that one sampling plan serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.parsing import half_even
from canvass.plans.allocation import weighted_requests

# Floors and factors of directed requests.
SHARE_FACTOR, SHARE_FLOOR = 3, 20
CONDITIONAL_FACTOR, CONDITIONAL_FLOOR = 3, 30
EXTRA_MEAN_FLOOR = 4


def expanded_scores(planned: DataFrame, observed: DataFrame) -> DataFrame:
    """(key, score, required): planned counts, and 1 for every other observed score.

    Both inputs carry key and score; ``planned`` also required.
    """
    return observed.select("key", "score").distinct().join(planned, ["key", "score"], "full").select(
        "key", "score", F.coalesce("required", F.lit(1)).cast("long").alias("required")
    )


def score_requests(scores: DataFrame, pool_size: Column) -> DataFrame:
    """max(required, ceil(pool * required / total)) rows per score."""
    totals = scores.groupBy("key").agg(F.sum("required").alias("total"))
    amount = F.greatest(F.col("required"), F.ceil(pool_size * F.col("required") / F.col("total")))
    return scores.join(totals, "key").where(F.col("required") > 0).withColumn("amount", amount.cast("long")).drop("total")


def extra_mean_requests(primary: DataFrame, extra: DataFrame, pool_size: Column) -> DataFrame:
    """Every extra score with every primary score of the same key, at most the pool each."""
    amount = F.greatest(
        F.least(F.greatest("required", "extra_required") * 2, pool_size), F.lit(EXTRA_MEAN_FLOOR)
    )
    side = extra.select("key", F.col("score").alias("extra_score"), F.col("required").alias("extra_required"))
    return primary.join(side, "key").withColumn("amount", amount.cast("long"))


def share_requests(scores: DataFrame, supports: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows inside and outside each target's member set, per score, spread over observed values.

    ``supports``: key, target_id, members_needed, others_needed. ``counts``: key, target_id,
    value, is_member, n. A side without observed values asks for nothing.
    """
    sides = counts.groupBy("key", "target_id", "is_member").agg(F.sum("n").alias("side_rows"))
    needed = F.when(F.col("is_member"), F.col("members_needed")).otherwise(F.col("others_needed"))
    capacity = F.greatest(F.least("required", needed), F.lit(1))
    per_side = (
        scores.join(supports, "key").join(sides, ["key", "target_id"])
        .withColumn("requested", F.greatest(capacity * SHARE_FACTOR, F.lit(SHARE_FLOOR)))
        .select("key", "target_id", "score", "is_member", "requested")
    )
    spread = per_side.join(counts, ["key", "target_id", "is_member"])
    return weighted_requests(spread, ["key", "target_id", "score", "is_member"], [F.col("value")])


def conditional_requests(scores: DataFrame, supports: DataFrame, counts: DataFrame) -> DataFrame:
    """Population rows with and without the option, per score, spread over observed pairs.

    ``supports``: key, target_id, value (0 asks for no option rows, 1 for no others).
    ``counts``: key, target_id, left, right, has_option, n.
    """
    wanted = F.when(F.col("has_option"), F.col("value") > 0).otherwise(F.col("value") < 1)
    sides = counts.select("key", "target_id", "has_option").distinct()
    per_side = (
        scores.join(supports, "key").join(sides, ["key", "target_id"]).where(wanted)
        .withColumn("requested", F.greatest(F.col("required") * CONDITIONAL_FACTOR, F.lit(CONDITIONAL_FLOOR)))
        .select("key", "target_id", "score", "has_option", "requested")
    )
    spread = per_side.join(counts, ["key", "target_id", "has_option"])
    return weighted_requests(
        spread, ["key", "target_id", "score", "has_option"], [F.desc("n"), F.col("left"), F.col("right")]
    )


def schema_requests(scores: DataFrame, injected: DataFrame, factor: int, floor: int) -> DataFrame:
    """Rows that get a form-backed value nobody has chosen yet.

    ``injected``: key, target_id, value, needed. The directed total of a score is shared by
    the target's unseen values.
    """
    sizes = injected.groupBy("key", "target_id").agg(F.count(F.lit(1)).alias("values"))
    total = F.greatest(F.least("required", "needed") * factor, F.lit(floor))
    return scores.join(injected, "key").join(sizes, ["key", "target_id"]).withColumn(
        "amount", F.greatest(F.lit(1), F.ceil(total / F.col("values"))).cast("long")
    )


def normalised_score(score: Column, minimum: Column, maximum: Column) -> Column:
    """Generated scores to the ordinal domain: half-even rounding, then clipping."""
    return F.least(F.greatest(half_even(score), minimum), maximum).cast("int")
