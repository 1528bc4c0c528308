"""Checks on a finished table: achieved metrics, duplicates, clones, drift, quality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.parsing import valid_score
from canvass.scale import prefix_sums


def epoch_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def fingerprints(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per distinct content; null equals null, as a grouping key treats it."""
    return df.groupBy(*columns).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("origin") == "synthetic", 1).otherwise(0)).alias("synthetic"),
        F.sum(F.when(F.col("origin") == "original", 1).otherwise(0)).alias("original"),
    )


def row_diagnostics(final: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Duplicates, concentration and source clones from one aggregate over row content.

    All three only need how often a content occurs on each side, so the clone check needs
    no join: a synthetic row is a clone when its content also occurs among the originals.
    A hot content collapses in the map-side combine.
    """
    prints = fingerprints(final, columns)
    share = lambda n: F.when(F.col("synthetic_rows") > 0, n / F.col("synthetic_rows")).otherwise(F.lit(0.0))
    return prints.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.max("synthetic"), F.lit(0)).alias("max_fingerprint_count"),
        F.coalesce(F.sum(F.when(F.col("original") > 0, F.col("synthetic"))), F.lit(0)).alias("source_clones"),
        F.coalesce(F.sum("synthetic"), F.lit(0)).alias("synthetic_rows"),
    ).select(
        "duplicate_rows", "max_fingerprint_count",
        share(F.col("max_fingerprint_count")).alias("max_fingerprint_share"),
        "source_clones", share(F.col("source_clones")).alias("source_clone_rate"),
    )


def source_clones(final: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The synthetic rows whose content equals some original row (null-safe)."""
    synthetic = final.where(F.col("origin") == "synthetic").alias("s")
    source = final.where(F.col("origin") == "original").select(*columns).distinct().alias("o")
    same = reduce(
        lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}")) for c in columns]
    )
    return synthetic.join(source, same, "left_semi")


def _ecdf(final: DataFrame, column: str) -> DataFrame:
    """Counts per distinct instant and side, with running counts in time order."""
    counts = (
        final.select(epoch_micros(F.col(column)).alias("at"), "origin")
        .groupBy("at")
        .agg(
            F.sum(F.when(F.col("origin") == "original", 1).otherwise(0)).alias("source_n"),
            F.sum(F.when(F.col("origin") == "synthetic", 1).otherwise(0)).alias("synthetic_n"),
        )
    )
    return prefix_sums(counts, ["at"], {"source_cum": "source_n", "synthetic_cum": "synthetic_n"})


def timestamp_ks(final: DataFrame, column: str = "submitted_at") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and the shift of the exact medians, in seconds.

    Both come from one table of running counts; the median is where the running count
    passes the middle ranks, so no task ever holds all values.
    """
    cum = _ecdf(final, column)
    totals = cum.agg(F.max("source_cum").alias("source_total"), F.max("synthetic_cum").alias("synthetic_total"))
    rows = cum.join(F.broadcast(totals))  # one row of totals

    def middle(side: str) -> list[Column]:
        cum_col, n, total = F.col(f"{side}_cum"), F.col(f"{side}_n"), F.col(f"{side}_total")
        low, high = F.floor((total + 1) / 2), F.floor((total + 2) / 2)
        hit = lambda r: (n > 0) & (cum_col >= r) & (cum_col - n < r)
        return [
            F.max(F.when(hit(low), F.col("at"))).alias(f"{side}_low"),
            F.max(F.when(hit(high), F.col("at"))).alias(f"{side}_high"),
        ]

    gap = F.abs(F.col("source_cum") / F.col("source_total") - F.col("synthetic_cum") / F.col("synthetic_total"))
    return rows.where((F.col("source_total") > 0) & (F.col("synthetic_total") > 0)).agg(
        F.max(gap).alias("ks_statistic"), *middle("source"), *middle("synthetic")
    ).select(
        "ks_statistic",
        (
            ((F.col("synthetic_low") + F.col("synthetic_high")) / 2
             - (F.col("source_low") + F.col("source_high")) / 2) / F.lit(1e6)
        ).alias("median_delta_seconds"),
    )


def achieved_means(final: DataFrame, targets: Sequence[tuple[str, str, float, int, int]]) -> DataFrame:
    """Per (id, column, requested, minimum, maximum): mean, error, denominator, invalid scores."""
    aggs = []
    for i, (_, column, _, low, high) in enumerate(targets):
        score = F.col(column).cast("double")
        aggs += [
            F.avg(score).alias(f"m{i}"), F.count(score).alias(f"n{i}"),
            F.count_if(score.isNotNull() & ~valid_score(score, F.lit(low), F.lit(high))).alias(f"v{i}"),
        ]
    one = final.agg(*aggs, F.count(F.lit(1)).alias("final_count"))
    rows = F.array(
        *[
            F.struct(
                F.lit(tid).alias("target_id"), F.lit(float(want)).alias("requested"),
                F.col(f"m{i}").alias("achieved"), F.abs(F.col(f"m{i}") - F.lit(float(want))).alias("absolute_error"),
                F.col(f"n{i}").alias("denominator_count"), F.col(f"v{i}").alias("invalid_scores"),
                F.col("final_count"),
            )
            for i, (tid, _, want, _, _) in enumerate(targets)
        ]
    )
    return one.select(F.inline(rows))


def out_of_scope(final: DataFrame, start: str | None, end: str | None, column: str = "submitted_at") -> DataFrame:
    """How many final rows lie outside the frozen time window."""
    ts = F.col(column)
    low = ts < F.lit(start).cast("timestamp_ntz") if start else F.lit(False)
    high = ts > F.lit(end).cast("timestamp_ntz") if end else F.lit(False)
    return final.agg(F.count_if(low).alias("before_scope"), F.count_if(high).alias("after_scope"))


def quality(final: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Own composite of column shapes and pair trends, original against synthetic.

    Shape: 1 - TVD (categorical) or 1 - KS (numeric). Trend: 1 - TVD of the pair table, or
    1 - |difference of correlations| / 2 for two numeric columns. Every table comes from
    one exploded aggregate; the score is the mean of the two section means.
    """
    pairs = [p for p in combinations([*categorical, *numeric], 2) if not set(p) <= set(numeric)]
    none = F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string")
    cells = F.array(
        *[F.struct(F.lit(f"shape:{c}").alias("m"), text(c).alias("a"), none.alias("b")) for c in categorical],
        *[F.struct(F.lit(f"shape:{c}").alias("m"), text(c).alias("a"), none.alias("b")) for c in numeric],
        *[F.struct(F.lit(f"trend:{a}:{b}").alias("m"), text(a).alias("a"), text(b).alias("b")) for a, b in pairs],
    )
    counts = final.select("origin", F.explode(cells).alias("c")).groupBy("c.m", "c.a", "c.b").agg(
        F.sum(F.when(F.col("origin") == "original", 1).otherwise(0)).alias("r"),
        F.sum(F.when(F.col("origin") == "synthetic", 1).otherwise(0)).alias("s"),
    )
    totals = final.agg(
        F.sum(F.when(F.col("origin") == "original", 1).otherwise(0)).alias("rt"),
        F.sum(F.when(F.col("origin") == "synthetic", 1).otherwise(0)).alias("st"),
        *[
            F.corr(
                F.when(F.col("origin") == side, F.col(a).cast("double")),
                F.when(F.col("origin") == side, F.col(b).cast("double")),
            ).alias(f"corr_{side}_{a}_{b}")
            for a, b in combinations(numeric, 2) for side in ("original", "synthetic")
        ],
    )
    numeric_shapes = [f"shape:{c}" for c in numeric]
    with_totals = counts.join(F.broadcast(totals.select("rt", "st")))  # one row of totals
    tvd = (
        with_totals.where(~F.col("m").isin(numeric_shapes) if numeric_shapes else F.lit(True))
        .groupBy("m")
        .agg((F.lit(1.0) - F.sum(F.abs(F.col("r") / F.col("rt") - F.col("s") / F.col("st"))) / 2).alias("score"))
    )
    parts = [tvd]
    if numeric:
        ordered = prefix_sums(
            counts.where(F.col("m").isin(numeric_shapes)).withColumn("x", F.col("a").cast("double")),
            ["x"], {"rc": "r", "sc": "s"}, keys=["m"],
        ).join(F.broadcast(totals.select("rt", "st")))  # one row of totals
        parts.append(
            ordered.groupBy("m").agg(
                (F.lit(1.0) - F.max(F.abs(F.col("rc") / F.col("rt") - F.col("sc") / F.col("st")))).alias("score")
            )
        )
        for a, b in combinations(numeric, 2):
            diff = F.abs(F.col(f"corr_original_{a}_{b}") - F.col(f"corr_synthetic_{a}_{b}"))
            parts.append(totals.select(F.lit(f"trend:{a}:{b}").alias("m"), (F.lit(1.0) - diff / 2).alias("score")))
    scores = reduce(DataFrame.unionByName, parts).select(
        F.substring_index("m", ":", 1).alias("section"), F.col("m").alias("metric"), "score"
    )
    sections = scores.groupBy("section").agg(F.avg("score").alias("score"))
    overall = sections.agg(F.avg("score").alias("score"))
    return scores.unionByName(
        sections.select("section", F.lit("section").alias("metric"), "score")
    ).unionByName(overall.select(F.lit("overall").alias("section"), F.lit("score").alias("metric"), "score"))


def set_fingerprint(df: DataFrame, columns: Sequence[str], *keys: str) -> DataFrame:
    """Order-free digest of a row set: count, sum and xor of 64-bit row hashes.

    Equal sets give equal digests on any partitioning; only three numbers per task move.
    """
    h = F.xxhash64(*[F.col(c) for c in columns])
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(h.cast("decimal(38,0)")).alias("hash_sum"),
        F.bit_xor(h).alias("hash_xor"),
    )


def row_digest(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)
