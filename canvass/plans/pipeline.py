"""End-to-end augmentation: plan, generate, select, check, and propose replacements."""

from __future__ import annotations

from dataclasses import dataclass, replace as with_changes

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.operators import evaluate as E
from canvass.operators.compose import compose
from canvass.operators.scope import Scope, in_scope
from canvass.plans import finished as FIN
from canvass.plans import selection as SEL
from canvass.plans import support as S
from canvass.plans import vectors as V
from canvass.plans.pool import CandidateShortage, Job, generate_pool
from canvass.scale import hash_order, number_by_hash
from canvass.session import materialise

RETRY_CODES = ("candidate_support", "candidate_target_support", "solver_infeasible")


@dataclass(frozen=True)
class Augmentation:
    """``final`` keeps every source row; ``replacement_final`` is the alternative, if one is better."""

    synthetic: DataFrame
    final: DataFrame
    outcome: DataFrame
    edit_status: str
    removed_count: int = 0
    replacement_final: DataFrame | None = None
    replacement_outcome: DataFrame | None = None


def support_plans(source: DataFrame, job: Job) -> dict[str, dict]:
    """Best reachable error of every target, from one row of source totals."""
    totals = V.totals(source, job.targets).first()
    rows, spark = int(totals["rows"]), source.sparkSession
    index = {id(t): i for i, t in enumerate(job.targets)}
    den = lambda t: float(totals[f"d{index[id(t)]}"] or 0)
    num = lambda t: float(totals[f"n{index[id(t)]}"] or 0)
    plans: dict[str, dict] = {}

    def planned(table, schema, plan):
        out = plan(spark.createDataFrame(table, schema)).collect()
        for r in out:
            if r["issue"]:
                raise SEL.Infeasible(r["issue"], f"target {r['target_id']}")
        return out

    if job.means:
        table = [(m.id, rows, int(den(m)), num(m), job.final_count, float(m.value), m.minimum, m.maximum) for m in job.means]
        for r in planned(
            table, "target_id string, source_count long, answered_count long, score_sum double, final_count long, "
            "value double, minimum int, maximum int", S.mean_support,
        ):
            scores = {r["low_score"]: r["low_count"], (r["low_score"] or 0) + 1: r["high_count"]}
            plans[r["target_id"]] = {
                "error": r["absolute_error"], "scores": {s: n for s, n in scores.items() if s is not None and n}
            }
    if job.shares:
        table = [
            (t.id, rows, int(den(t)), int(num(t)), job.final_count, float(t.value), bool(t.members)) for t in job.shares
        ]
        for r in planned(
            table, "target_id string, source_count long, source_denominator long, source_numerator long, "
            "final_count long, value double, has_members boolean", S.share_support,
        ):
            plans[r["target_id"]] = {"error": r["absolute_error"], "members": r["synthetic_members"]}
    for t in job.counts:
        needed = min(max(t.value - int(num(t)), 0), max(job.final_count - rows, 0))
        plans[t.id] = {"error": 0.0, "members": needed}
    if job.conditionals:
        by_population = {(t.column, t.members): plans[t.id]["members"] for t in job.shares}
        table = [
            (
                f"{t.population_column}|{sorted(t.population_members)}|{t.option_column}", t.id, int(den(t)), int(num(t)),
                float(t.value),
                by_population.get((t.population_column, t.population_members), job.final_count - rows),
            )
            for t in job.conditionals
        ]
        for r in planned(
            table, "grp string, target_id string, source_population long, source_numerator long, value double, "
            "available long", lambda df: S.conditional_support(df, ["grp"]),
        ):
            plans[r["target_id"]] = {"error": r["absolute_error"]}
    return plans


def _with_ids(rows: DataFrame, label: str, seed: int) -> DataFrame:
    numbered = number_by_hash(rows, [], hash_order(seed, "cand_id"), tie=["cand_id"], out="__rn")
    return numbered.withColumn(
        "response_id", F.concat_ws(":", F.lit(label), F.lit(seed), F.col("__rn"))
    ).drop("__rn", "cand_id", "request_id").withColumn("origin", F.lit("synthetic"))


def augment(source: DataFrame, job: Job, form: FIN.FormCheck | None = None) -> Augmentation:
    """``source``: flat table with response_id, the job's score and cell columns and its time column.

    Finished rows are checked before they are handed out (:mod:`canvass.plans.finished`); with ``form``
    generated rows are also rebuilt as responses and led through the form's routing.
    """
    wanted = [
        "response_id", *([job.time_column] if job.time_column else []), *job.scores, *job.categorical
    ]
    # Planning, fitting, requests and checks all scan these few columns, so they are written once.
    source = materialise(
        source.select(*dict.fromkeys(wanted)).withColumn("response_id", F.col("response_id").cast("string"))
    )
    rows = source.count()
    additions = job.final_count - rows
    plans = support_plans(source, job)
    original = source.withColumn("origin", F.lit("original"))
    chosen = pool = None
    for attempt in (1, 2):
        try:
            pool = generate_pool(source, job, additions, job.default_pool_size(additions) * attempt, plans)
            picked = SEL.select_for_targets(source, pool, job)
            chosen = materialise(_with_ids(picked, "synthetic", job.seed))
            outcome = V.outcomes(original.unionByName(chosen), job.targets) if job.targets else None
            worse = SEL.support_violations(outcome, plans, job).take(1) if job.targets else []
            if worse:
                raise SEL.Infeasible("candidate_target_support", f"targets {worse[0]['target_ids']} miss their best value")
            break
        except CandidateShortage as short:
            if attempt == 2:
                raise SEL.Infeasible("candidate_support", str(short)) from short
        except SEL.Infeasible as issue:
            if attempt == 1 and issue.code in RETRY_CODES:
                continue
            if not (job.counts and issue.code == "solver_infeasible"):
                raise
            # Exact counts cannot hold by appending; relax them so that a replacement can be weighed.
            picked = SEL.select_for_targets(source, pool, job, enforce_counts=False)
            chosen = materialise(_with_ids(picked, "synthetic", job.seed))
            outcome = V.outcomes(original.unionByName(chosen), job.targets)
    final = original.unionByName(chosen)
    relaxed = bool(job.counts) and outcome.where("kind = 'count' and absolute_error > 0").take(1)
    FIN.stop_on(FIN.finished_findings(final, source, job, planned=outcome, plans=None if relaxed else plans, form=form))
    if not job.targets:
        return Augmentation(chosen, final, outcome, "not_required")
    error = V.selection_error(outcome).first()[0]
    if error <= SEL.TOLERANCE:
        return Augmentation(chosen, final, outcome, "not_required")
    plan = SEL.plan_replacements(source, pool, job, error)
    if plan.status == "impossible" and error == float("inf"):
        raise SEL.Infeasible("solver_infeasible", "exact counts hold neither by appending nor by replacing")
    if plan.status != "available":
        return Augmentation(chosen, final, outcome, plan.status)
    kept = plan.kept.withColumn("origin", F.lit("original"))
    ranked = number_by_hash(plan.chosen, [], hash_order(job.seed, "cand_id"), tie=["cand_id"], out="__rn")
    is_replacement = F.col("__rn") <= plan.removed_count
    named = ranked.withColumn(
        "response_id",
        F.when(is_replacement, F.concat_ws(":", F.lit("replacement"), F.lit(job.seed), F.col("__rn")))
        .otherwise(F.concat_ws(":", F.lit("synthetic"), F.lit(job.seed), F.col("__rn") - plan.removed_count)),
    ).drop("__rn", "cand_id", "request_id").withColumn("origin", F.lit("synthetic"))
    alternative = materialise(kept.unionByName(named))
    reached = V.outcomes(alternative, job.targets)
    FIN.stop_on(FIN.finished_findings(alternative, source, job, removed_count=plan.removed_count, planned=reached, form=form))
    return Augmentation(chosen, final, outcome, "available", plan.removed_count, alternative, reached)


def report(result: Augmentation, job: Job) -> DataFrame:
    """One row about a finished run: sizes, duplicates, clones, drift."""
    content = [x for x in result.final.columns if x not in ("response_id", "origin")]
    sizes = result.final.agg(
        F.count(F.lit(1)).alias("final_count"), F.count_if(F.col("origin") == "synthetic").alias("synthetic_count")
    )
    # One-row tables side by side.
    row = sizes.join(E.row_diagnostics(result.final, content))
    if job.time_column:
        row = row.join(E.timestamp_ks(result.final, job.time_column))
    return row.withColumn("edit_status", F.lit(result.edit_status)).withColumn("replaced", F.lit(result.removed_count))


def augment_batch(base: DataFrame, rules: dict[str, tuple[Scope, Job]]) -> DataFrame:
    """Run disjoint rules over one base table and compose the results.

    The final count of a rule's job is what its scope holds plus the additions the caller set.
    """
    scopes = {rule: scope for rule, (scope, _) in rules.items()}
    names = list(scopes)
    claims = sum((F.when(scopes[r].predicate(), 1).otherwise(0) for r in names), F.lit(0))
    if base.where(claims > 1).take(1):
        raise SEL.Infeasible("target_conflict", "rules overlap on source responses")
    children = None
    for rule, (scope, job) in rules.items():
        scoped = in_scope(base, scope)
        done = augment(scoped, job).final.withColumn("rule_id", F.lit(rule))
        children = done if children is None else children.unionByName(done)
    keep = [x for x in children.columns if x not in ("rule_id", "origin")]
    base_rows = base.withColumn("response_id", F.col("response_id").cast("string")).select(*keep).withColumn(
        "origin", F.lit("original")
    )
    return compose(base_rows, scopes, children)


def job_with_additions(job: Job, source: DataFrame, share: float) -> Job:
    """The same job with a final count of source rows plus a share of them."""
    rows = source.count()
    return with_changes(job, final_count=rows + max(1, int(rows * share)))
