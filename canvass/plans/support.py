"""What a draft can reach: closed forms over one row of source totals per target.

Every function takes a DataFrame with one row per (draft, target), adds the plan columns and
an ``issue`` code. They never look at responses again, so all drafts are planned in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.parsing import half_up

_SCAN_BLOCK = 4096


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def mean_support(df: DataFrame) -> DataFrame:
    """Best reachable mean, and the two adjacent scores the additions must have.

    Input: source_count, answered_count, score_sum, final_count, value, minimum, maximum.
    """
    c = F.col
    additions = (c("final_count") - c("source_count")).cast("long")
    issue = (
        F.when(c("source_count") == 0, "empty_source_scope")
        .when(c("final_count") < c("source_count"), "final_count_below_source")
        .when(~c("value").between(c("minimum"), c("maximum")), "mean_out_of_range")
        .when((c("answered_count") == 0) & (additions == 0), "mean_zero_denominator")
    )
    df = df.withColumn("additions", additions).withColumn("issue", issue)
    ok = c("issue").isNull()
    final_denominator = c("answered_count") + c("additions")
    wanted = c("value") * final_denominator - c("score_sum")
    df = df.withColumn(
        "synthetic_sum",
        F.when(
            ok, clamp(half_up(wanted), c("additions") * c("minimum"), c("additions") * c("maximum"))
        ).cast("long"),
    )
    spread = ok & (c("additions") > 0)
    df = df.withColumn("low_score", F.when(spread, F.floor(c("synthetic_sum") / c("additions"))).cast("long"))
    df = df.withColumn("high_count", F.when(spread, c("synthetic_sum") - c("low_score") * c("additions")))
    df = df.withColumn("low_count", F.when(spread, c("additions") - c("high_count")))
    achieved = (c("score_sum") + c("synthetic_sum")) / F.nullif(final_denominator, F.lit(0))
    return df.withColumn("achieved", F.when(ok, achieved)).withColumn(
        "absolute_error", F.abs(c("achieved") - c("value"))
    )


def share_support(df: DataFrame) -> DataFrame:
    """Members the additions must bring. Input: source_count, source_denominator,
    source_numerator, final_count, value, has_members."""
    c = F.col
    additions = (c("final_count") - c("source_count")).cast("long")
    final_denominator = c("source_denominator") + c("additions")
    df = df.withColumn("additions", additions).withColumn(
        "issue",
        F.when(c("source_count") == 0, "empty_source_scope")
        .when(c("final_count") < c("source_count"), "final_count_below_source")
        .when(~c("value").between(0, 1), "share_out_of_range")
        .when(~c("has_members"), "share_member_support")
        .when(final_denominator <= 0, "share_zero_denominator"),
    )
    ok = c("issue").isNull()
    members = clamp(
        half_up(c("value") * final_denominator), c("source_numerator"), c("source_numerator") + c("additions")
    )
    df = df.withColumn("final_members", F.when(ok, members).cast("long"))
    df = df.withColumn("synthetic_members", c("final_members") - c("source_numerator"))
    df = df.withColumn("achieved", F.when(ok, c("final_members") / F.nullif(final_denominator, F.lit(0))))
    return df.withColumn("absolute_error", F.abs(c("achieved") - c("value")))


def count_support(df: DataFrame) -> DataFrame:
    """Members still needed. Input: source_count, source_members, final_count, value."""
    additions = F.greatest(F.col("final_count") - F.col("source_count"), F.lit(0))
    needed = clamp(F.col("value") - F.col("source_members"), F.lit(0), additions)
    return df.withColumn("needed_members", needed.cast("long")).withColumn(
        "needed_nonmembers", F.greatest(additions - F.col("needed_members"), F.lit(0)).cast("long")
    )


def nearest_numerator(denominator: Column, population: Column, numerator: Column, value: Column) -> Column:
    """struct(err, num): feasible numerator closest to the wanted share, ties to the smaller."""
    low, high = numerator, numerator + denominator - population
    wanted = value * denominator
    options = [low, high, clamp(F.floor(wanted), low, high), clamp(F.ceil(wanted), low, high)]
    return F.array_min(
        F.array(
            *[
                F.struct(F.abs(n / denominator - value).alias("err"), n.cast("long").alias("num"))
                for n in options
            ]
        )
    )


def _windows(groups: DataFrame) -> Column:
    """The stretches of denominators that can hold the least total error: array of (lo, hi).

    Between two breakpoints (where a target's wanted numerator enters the feasible range) each
    error either falls with the denominator, or is the distance of ``value * denominator`` to a whole
    number over the denominator. With values of k decimals these distances repeat every 10^k
    denominators, so a denominator is never better than the one 10^k further on: the last 10^k of
    every stretch are enough, whatever its length. Values without such a period scan everything.
    """
    c, whole = F.col, lambda x: F.abs(x - F.rint(x)) < 1e-7
    decimals = F.array_min(F.filter(
        F.sequence(F.lit(0), F.lit(6)), lambda k: F.forall("targets", lambda t: whole(t["value"] * F.pow(F.lit(10.0), k)))
    ))
    period = F.pow(F.lit(10.0), decimals).cast("long")
    enters = lambda wanted, share: F.when(share > 0, F.least(F.floor(wanted / share), c("stop").cast("double")).cast("long"))
    ends = F.array_distinct(F.array_compact(F.concat(
        F.transform("targets", lambda t: enters(t["source_numerator"].cast("double"), t["value"])),
        F.transform("targets", lambda t: enters((c("source_population") - t["source_numerator"]).cast("double"), 1 - t["value"])),
        F.array(c("stop")),
    )))
    near = F.filter(
        F.transform(ends, lambda e: F.struct(F.greatest(c("start"), e - period).alias("lo"), F.least(c("stop"), e + 1).alias("hi"))),
        lambda w: w["lo"] <= w["hi"],
    )
    scanned = F.aggregate(near, F.lit(0).cast("long"), lambda n, w: n + w["hi"] - w["lo"] + 1)
    all_of_it = F.array(F.struct(c("start").alias("lo"), c("stop").alias("hi")))
    return F.when(period.isNull() | (scanned > c("stop") - c("start")), all_of_it).otherwise(near)


def _scan_denominators(groups: DataFrame) -> DataFrame:
    """The denominators of every group that can be best, exploded in blocks so that a long
    stretch is spread over tasks and never sits in one array."""
    start = F.greatest(F.lit(1).cast("long"), F.col("source_population").cast("long"))
    stop = (F.col("source_population") + F.col("available")).cast("long")
    ranged = groups.withColumn("start", start).withColumn("stop", stop).where(F.col("start") <= F.col("stop"))
    stretches = ranged.select("*", F.inline(_windows(ranged)))
    blocks = stretches.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) / _SCAN_BLOCK))).alias("block")
    )
    first = F.col("lo") + F.col("block") * _SCAN_BLOCK
    return blocks.select(
        "*", F.explode(F.sequence(first, F.least(first + _SCAN_BLOCK - 1, F.col("hi")))).alias("denominator")
    )


def conditional_support(df: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Best denominator per group of targets that share a population and a checkbox question.

    Input, one row per target: ``keys`` of the group, target_id, source_population,
    source_numerator, value, available (population additions the draft allows). A
    denominator that can be best is scored for all targets of its group; the least total error
    wins, ties (to 12 decimals, beyond which sums of doubles differ by chance) to the larger one.
    """
    keys = list(keys)
    per_group = df.groupBy(*keys).agg(
        F.max("source_population").alias("source_population"), F.max("available").alias("available"),
        F.collect_list(F.struct("target_id", "source_numerator", "value")).alias("targets"),
    )
    scanned = _scan_denominators(per_group)
    error = F.aggregate(
        F.array_sort("targets"), F.lit(0.0),
        lambda acc, t: acc + nearest_numerator(
            F.col("denominator"), F.col("source_population"), t["source_numerator"], t["value"]
        )["err"],
    )
    best = scanned.select(*keys, "denominator", error.alias("total_error")).groupBy(*keys).agg(
        F.min_by(
            F.struct("denominator", "total_error"),
            F.struct(F.round("total_error", 12), -F.col("denominator")),
        ).alias("best")
    )
    planned = df.join(best, keys, "left")
    hit = nearest_numerator(
        F.col("best.denominator"), F.col("source_population"), F.col("source_numerator"), F.col("value")
    )
    return planned.select(
        *keys, "target_id", *carry, "source_population", "source_numerator", "value",
        F.col("best.denominator").alias("denominator"),
        F.when(F.col("best").isNotNull(), hit["num"]).alias("numerator"),
        F.when(F.col("best").isNotNull(), hit["err"]).alias("absolute_error"),
        F.col("best.total_error").alias("total_error"),
        F.when(F.col("best").isNull(), "conditional_population_empty").alias("issue"),
    )


def static_issues(df: DataFrame) -> DataFrame:
    """Checks a solver makes before it starts: ranges, member support, unique ids.

    Input: draft_id, target_id, kind, value, final_count, members, options (member counts; null
    where the kind has none).
    """
    c = F.col
    code = (
        F.when((c("kind") == "count") & ~c("value").between(0, c("final_count")), "count_out_of_range")
        .when((c("kind") == "count") & (c("members") == 0), "count_member_support")
        .when((c("kind") == "share") & ~c("value").between(0, 1), "share_out_of_range")
        .when((c("kind") == "share") & (c("members") == 0), "share_member_support")
        .when((c("kind") == "conditional_share") & ~c("value").between(0, 1), "conditional_share_out_of_range")
        .when((c("kind") == "conditional_share") & (c("members") == 0), "conditional_population_support")
        .when((c("kind") == "conditional_share") & (c("options") == 0), "conditional_option_support")
    )
    own = df.withColumn("code", code).where(c("code").isNotNull()).select("draft_id", "target_id", "code")
    family = F.when(c("kind") == "conditional_share", "conditional").when(c("kind") == "mean", "mean").otherwise("categorical")
    repeated = (
        df.groupBy("draft_id", "target_id", family.alias("family")).agg(F.count(F.lit(1)).alias("n"))
        .where((c("n") > 1) & (c("family") != "mean"))
        .select(
            "draft_id", "target_id",
            F.when(c("family") == "conditional", "duplicate_conditional_share_target")
            .otherwise("duplicate_categorical_target").alias("code"),
        )
    )
    return own.unionByName(repeated)
