"""Choosing candidates (and source rows to replace) so that the targets are met.

A row matters only through its signature: its denominator and numerator of every target.
Spark counts rows per run and signature; the number of cells depends on the targets and not on the
data, and choosing rows becomes choosing how many to take from each cell. Runs are keyed: each
run's cells are one small group, so any number of runs is worked out in one job, spread over
tasks (:mod:`canvass.plans.takes`). Rows are then drawn from the cells in hash order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.plans import takes as T
from canvass.plans import vectors as V
from canvass.plans.pool import Job, drop_misrouted
from canvass.scale import hash_order, number_by_hash

TOLERANCE = 1e-9


class Infeasible(RuntimeError):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Spec:
    """What the search needs to know of a target."""

    value: float
    weight: float
    kind: str


def specs(job: Job) -> list[Spec]:
    out = []
    for t in job.targets:
        weight = 1.0 / max(float(t.maximum - t.minimum), 1.0) if t.kind == "mean" else 1.0
        out.append(Spec(float(t.value), weight, t.kind))
    return out


@dataclass(frozen=True)
class RunSpec:
    """One run's search: targets in the order of the signature columns, what is there already (denominator and
    numerator of each), rows to take, whether counts must hold, and whether source rows may go."""

    wanted: tuple[Spec, ...]
    base: tuple[float, ...]
    rows: int
    hard_counts: bool = True


def _whole(values: Sequence[float]) -> tuple[int, list[int]]:
    """A factor that makes all values whole, and the whole values."""
    exact = [Fraction(float(v)).limit_denominator(10**6) for v in values]
    factor = math.lcm(*[v.denominator for v in exact]) if exact else 1
    return factor, [int(v * factor) for v in exact]


def run_problem(pdf: pd.DataFrame, names: Sequence[str], spec: RunSpec) -> T.Problem:
    """The search over one run's cells. A kept source row is worth one in the second place."""
    ratios, exacts = [], []
    for i, s in enumerate(spec.wanted):
        den, num = pdf[names[2 * i]], pdf[names[2 * i + 1]]
        factor, whole = _whole([*num, spec.base[2 * i + 1]])
        if s.kind == "count":
            exacts.append(T.Exact(int(s.value), tuple(whole[:-1]), whole[-1], spec.hard_counts))
            continue
        ratios.append(T.Ratio(
            T.as_ratio(s.value) * factor, T.as_ratio(s.weight) / factor, tuple(int(d) for d in den), tuple(whole[:-1]),
            int(spec.base[2 * i]), whole[-1],
        ))
    return T.Problem(spec.rows, tuple(int(c) for c in pdf["cap"]), tuple(ratios), tuple(exacts), tuple(-int(k) for k in pdf["keep"]))


def _signatures(df: DataFrame, targets) -> tuple[DataFrame, list[str]]:
    names = []
    for i, t in enumerate(targets):
        den, num = V.vectors(t)
        df = df.withColumn(f"__d{i}", den.cast("double")).withColumn(f"__n{i}", num.cast("double"))
        names += [f"__d{i}", f"__n{i}"]
    return df, names


def solve_runs(cells: DataFrame, names: Sequence[str], runs: Mapping[str, RunSpec]) -> DataFrame:
    """``take``, ``status`` and ``error`` for the cells (run, keep, signature, cap) of every run.

    ``keep`` is 1 for source cells, 0 for candidates. Status: found, short (fewer rows than needed),
    none (the counts cannot hold), long (the search gave up; nothing unproven is returned).
    """
    names, runs = list(names), dict(runs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["keep", *names]).reset_index(drop=True)
        spec = runs[pdf["run"].iloc[0]]
        if int(pdf["cap"].sum()) < spec.rows:
            return pdf.assign(take=0, status="short", error=None)
        try:
            choice = T.choose(run_problem(pdf, names, spec))
        except T.SearchTooLong:
            return pdf.assign(take=0, status="long", error=None)
        if choice is None:
            return pdf.assign(take=0, status="none", error=None)
        return pdf.assign(take=list(choice.takes), status="found", error=float(choice.error))

    schema = ", ".join(["run string", "keep int", *[f"{n} double" for n in names], "cap long", "take long", "status string", "error double"])
    return cells.groupBy("run").applyInPandas(run, schema)


def _cells(df: DataFrame, names: Sequence[str], keep: int) -> DataFrame:
    """Rows per run and signature."""
    return df.groupBy("run", *names).agg(F.count(F.lit(1)).alias("cap")).select("run", F.lit(keep).alias("keep"), *names, "cap")


def _draw(df: DataFrame, names: list[str], takes: DataFrame, row_id: str, seed: int) -> DataFrame:
    """``take`` rows of every run's cells in hash order; a cell that holds most rows is numbered in buckets."""
    by = ["run", *names]
    rows = df.join(takes.select(*by, "take"), by).where(F.col("take") > 0)
    return number_by_hash(
        rows, by, hash_order(seed, row_id), tie=[row_id], limit=F.col("take")
    ).drop("rn", "take", *names)


def _totals(source: DataFrame, job: Job) -> tuple[int, list[float]]:
    row = V.totals(source, job.targets).first()
    base = [float(row[f"{side}{i}"] or 0) for i in range(len(job.targets)) for side in ("d", "n")]
    return int(row["rows"]), base


def select_for_targets(
    source: DataFrame, candidates: DataFrame, job: Job, *, enforce_counts: bool = True
) -> DataFrame:
    """The candidate rows to append; every source row stays."""
    source_rows, base = _totals(source, job)
    additions = job.final_count - source_rows
    if additions < 0:
        raise Infeasible("final_count_below_source", "the final count is below the immutable source count")
    pool = drop_misrouted(candidates, job.rules)
    if additions == 0:
        return pool.limit(0)
    signed, names = _signatures(pool, job.targets)
    if not names:
        return number_by_hash(signed, [], hash_order(job.seed, "cand_id"), tie=["cand_id"], limit=F.lit(additions)).drop("rn")
    signed = signed.withColumn("run", F.lit(_ONE))
    takes, status, _ = _solved(signed.sparkSession, solve_runs(
        _cells(signed, names, 0), names, {_ONE: RunSpec(tuple(specs(job)), tuple(base), additions, enforce_counts)}
    ))
    if status == "short":
        raise Infeasible("candidate_support", "the pool holds fewer rows than the additions need")
    if status != "found":
        raise Infeasible("solver_infeasible", "no selection meets the exact counts")
    return _draw(signed, names, takes, "cand_id", job.seed).drop("run")


_ONE = "run"


def _solved(spark: SparkSession, solved: DataFrame) -> tuple[DataFrame, str, float]:
    """A single run's takes, status and error. One row per signature: bounded by the targets, so they travel with the plan."""
    rows = solved.collect()
    status = rows[0]["status"] if rows else "short"
    if status == "long":
        raise Infeasible("search_too_long", "the least error could not be proven")
    return spark.createDataFrame(rows, solved.schema), status, rows[0]["error"] if rows else None


def select_for_mean(source: DataFrame, candidates: DataFrame, mean: V.MeanTarget, plan: dict[int, int], seed: int = 1) -> DataFrame:
    """Single mean: the planned number of rows of each score, straight from the closed form."""
    spark = source.sparkSession
    takes = spark.createDataFrame(
        [(float(s), int(n)) for s, n in plan.items()], "__score double, take long"
    )
    rows = candidates.withColumn("__score", V.answered_score(mean.column)).join(F.broadcast(takes), "__score")
    return number_by_hash(rows, ["__score"], hash_order(seed, "cand_id"), tie=["cand_id"], limit=F.col("take")).drop(
        "rn", "take", "__score"
    )


@dataclass(frozen=True)
class Replacement:
    """status not_required / impossible / available; kept source rows and chosen candidates."""

    status: str
    removed_count: int = 0
    kept: DataFrame | None = None
    chosen: DataFrame | None = None


def plan_replacements(source: DataFrame, candidates: DataFrame, job: Job, append_error: float) -> Replacement:
    """Fewest source rows to replace for the least error, when that beats appending alone."""
    pool = drop_misrouted(candidates, job.rules)
    (signed, names), (own, _) = _signatures(pool, job.targets), _signatures(source, job.targets)
    signed, own = signed.withColumn("run", F.lit(_ONE)), own.withColumn("run", F.lit(_ONE))
    takes, status, error = _solved(source.sparkSession, solve_runs(
        _cells(own, names, 1).unionByName(_cells(signed, names, 0)), names,
        {_ONE: RunSpec(tuple(specs(job)), (0.0,) * len(names), job.final_count)},
    ))
    if status != "found":
        return Replacement("impossible")
    if error >= append_error - TOLERANCE:
        return Replacement("not_required")
    removed = takes.where("keep = 1").agg(F.sum(F.col("cap") - F.col("take"))).first()[0]
    return Replacement(
        "available", int(removed or 0),
        _draw(own, names, takes.where("keep = 1"), "response_id", job.seed).drop("run"),
        _draw(signed, names, takes.where("keep = 0"), "cand_id", job.seed).drop("run"),
    )


def support_violations(outcome: DataFrame, plans: dict[str, dict], job: Job) -> DataFrame:
    """Targets whose achieved error is above the best their own support plan allows.

    Conditionals of one population and question are judged by their summed error.
    """
    group = {t.id: str(i) for i, t in enumerate(job.targets)}
    seen: dict[tuple, str] = {}
    for t in job.conditionals:
        group[t.id] = seen.setdefault((t.population_column, t.population_members, t.option_column), group[t.id])
    limits: dict[str, float] = {}
    for t in job.targets:
        if t.kind != "count":
            limits[group[t.id]] = limits.get(group[t.id], 0.0) + plans[t.id]["error"]
    spark = outcome.sparkSession
    bound = spark.createDataFrame(
        [(t.id, group[t.id], limits[group[t.id]]) for t in job.targets if t.kind != "count"],
        "target_id string, bound_group string, allowed double",
    )
    return outcome.join(bound, "target_id").groupBy("bound_group", "allowed").agg(
        F.sum("absolute_error").alias("achieved_error"),
        F.array_join(F.array_sort(F.collect_list("target_id")), ",").alias("target_ids"),
    ).where(F.col("achieved_error") > F.col("allowed") + TOLERANCE)
