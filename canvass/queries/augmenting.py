"""Generation, selection and replacement over the whole flat survey."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.operators.scope import Scope
from canvass.plans import copula
from canvass.plans import finished as FIN
from canvass.plans import pipeline as PL
from canvass.plans import pool as PO
from canvass.plans import requests as RQ
from canvass.plans import selection as SEL
from canvass.plans import support as S
from canvass.plans import vectors as V
from canvass.queries import field, planning
from canvass.queries.answers import A_CELLS, HEAVY_CELLS, flags_cell, flat, option_cell
from canvass.queries.field import SURVEY_SQL, ctes
from canvass.queries.planning import MEAN_PLAN_SQL, TB
from canvass.queries.registry import query
from canvass.session import materialise

c = F.col
S_SQL = ctes(SURVEY_SQL)
SHARE = V.ShareTarget("share", "q_q_status", frozenset({option_cell("F")}), 0.36)
UNSEEN = V.ShareTarget("unseen", "q_q_status", frozenset({option_cell("X")}), 0.02)
JOB = PO.Job(
    final_count=0,
    means=(V.MeanTarget("mean", "score_q_score", 3.1, 1, 5),),
    shares=(SHARE,),
    conditionals=(V.ConditionalTarget("cond", "q_q_segment", HEAVY_CELLS, "q_q_flags", A_CELLS, 0.8),),
    categorical=("q_q_status", "q_q_segment", "q_q_flags"),
    seed=20,
)
_STORED: dict[tuple, object] = {}


def _stored(spark, sf_dir, name, make):
    """One stored result per session and folder, shared by the queries below."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]


def source(spark, sf_dir):
    return _stored(spark, sf_dir, "source", lambda: materialise(
        flat(spark, sf_dir).select("response_id", "submitted_at", "score_q_score", *JOB.categorical)
    ))


def job(spark, sf_dir, base=JOB):
    return PL.job_with_additions(base, source(spark, sf_dir), 0.1)


def _additions(spark, sf_dir):
    return job(spark, sf_dir).final_count - source(spark, sf_dir).count()


def model(spark, sf_dir):
    return _stored(spark, sf_dir, "model", lambda: copula.fit(
        source(spark, sf_dir), JOB.scores, JOB.categorical, JOB.time_column
    ))


def pool(spark, sf_dir):
    def make():
        j, n = job(spark, sf_dir), _additions(spark, sf_dir)
        plans = PL.support_plans(source(spark, sf_dir), j)
        return PO.generate_pool(source(spark, sf_dir), j, n, 5 * n, plans, model(spark, sf_dir))

    return _stored(spark, sf_dir, "pool", make)


@query("gen02")
def joint_model(spark, sf_dir):
    """Levels of every discrete column with their normal scores."""
    return model(spark, sf_dir).levels


@query("gen03")
def joint_sample(spark, sf_dir):
    """As many unconditioned rows as the source has; their marginals."""
    m, none = model(spark, sf_dir), F.create_map().cast("map<string,string>")
    asked = source(spark, sf_dir).agg(F.count(F.lit(1)).alias("amount")).select(F.lit("all").alias("request_id"), none.alias("given"), "amount")
    rows = copula.sample(m, PO.explode_count(asked, c("amount"), "copy"), [()], 5, ["request_id", "copy"])
    return rows.groupBy("q_q_status", "score_q_score").agg(F.count(F.lit(1)).alias("rows"))


@query("gen04")
def conditional_sample(spark, sf_dir):
    """Rows made per request of the pool: every request is filled exactly."""
    return pool(spark, sf_dir).groupBy("request_id").agg(F.count(F.lit(1)).alias("made"))


def _unseen_pool(spark, sf_dir):
    def make():
        base = PO.Job(
            final_count=0, means=JOB.means, shares=(UNSEEN,),
            conditionals=(V.ConditionalTarget(
                "z", "q_q_segment", HEAVY_CELLS, "q_q_flags", frozenset({flags_cell("Z")}), 0.1,
                schema_members=frozenset({flags_cell("Z")}),
            ),),
            categorical=JOB.categorical, seed=21,
        )
        j, n = job(spark, sf_dir, base), _additions(spark, sf_dir)
        plans = PL.support_plans(source(spark, sf_dir), j)
        return PO.generate_pool(source(spark, sf_dir), j, n, n, plans, model(spark, sf_dir))

    return _stored(spark, sf_dir, "unseen", make)


@query("gen09")
def schema_member_rows(spark, sf_dir):
    return _unseen_pool(spark, sf_dir).where(c("q_q_status") == option_cell("X")).groupBy("score_q_score").agg(
        F.count(F.lit(1)).alias("rows")
    )


@query("gen11")
def schema_option_rows(spark, sf_dir):
    return _unseen_pool(spark, sf_dir).where(c("q_q_flags") == flags_cell("Z")).groupBy("q_q_segment").agg(
        F.count(F.lit(1)).alias("rows")
    )


@query("gen13")
def pool_by_kind(spark, sf_dir):
    return pool(spark, sf_dir).groupBy(F.substring_index("request_id", "|", 1).alias("kind")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("request_id").alias("requests")
    )


@query("gen14", S_SQL + """SELECT kind, greatest(20 * (n // 10), f) AS first_attempt, 2 * greatest(20 * (n // 10), f) AS second_attempt
  FROM (SELECT count(*) AS n FROM survey), (VALUES ('conditional', 800), ('share', 500), ('mean', 200)) v(kind, f)""")
def pool_sizes(spark, sf_dir):
    kinds = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(j.default_pool_size(0)).alias("floor"))
        for k, j in (("conditional", JOB), ("share", PO.Job(1, shares=(SHARE,))), ("mean", PO.Job(1, means=JOB.means)))
    ])
    sizes = field.survey(spark, sf_dir).agg(F.floor(F.count(F.lit(1)) / 10).alias("additions")).select("additions", F.inline(kinds))
    first = F.greatest(c("additions") * 20, c("floor"))
    return sizes.select("kind", first.alias("first_attempt"), (first * 2).alias("second_attempt"))


@query("gen16", S_SQL + "SELECT count(*) + count(*) // 10 AS final_count, count(*) // 10 AS synthetic_count FROM survey")
def targetless(spark, sf_dir):
    j = job(spark, sf_dir, PO.Job(final_count=0, categorical=JOB.categorical, seed=3))
    return PL.augment(source(spark, sf_dir), j).final.agg(
        F.count(F.lit(1)).alias("final_count"), F.count_if(c("origin") == "synthetic").alias("synthetic_count")
    )


# Request tables of all drafts at once.
def _planned(spark, sf_dir):
    plans = S.mean_support(planning._mean_inputs(spark, sf_dir)).where(c("low_score").isNotNull())
    rows = F.array(
        F.struct(c("low_score").alias("score"), c("low_count").alias("required")),
        F.struct((c("low_score") + 1).alias("score"), c("high_count").alias("required")),
    )
    return plans.select(c("draft_id").alias("key"), "additions", F.inline(rows)).where(c("required") > 0)


def _expanded(spark, sf_dir):
    planned = _planned(spark, sf_dir)
    observed = planning.drafts(spark, sf_dir).select(c("draft_id").alias("key"), "form_id").join(
        field.survey(spark, sf_dir).select("form_id", c("q_score").cast("long").alias("score")).distinct(), "form_id"
    ).join(planned.select("key").distinct(), "key", "left_semi")
    return RQ.expanded_scores(planned.select("key", "score", "required"), observed.select("key", "score"))


PLANNED_SQL = TB + MEAN_PLAN_SQL.replace(" SELECT draft_id, issue, additions", ", mp AS (SELECT draft_id, issue, additions").rstrip() + """),
 pl AS (SELECT draft_id AS key, additions, CAST(low_score AS BIGINT) AS score, CAST(low_count AS BIGINT) AS required FROM mp WHERE low_score IS NOT NULL AND low_count > 0
   UNION ALL SELECT draft_id, additions, CAST(low_score + 1 AS BIGINT), CAST(high_count AS BIGINT) FROM mp WHERE low_score IS NOT NULL AND high_count > 0),
 ob AS (SELECT DISTINCT d.draft_id AS key, s.q_score AS score FROM drafts d JOIN survey s USING (form_id) WHERE d.draft_id IN (SELECT key FROM pl)),
 ex AS (SELECT key, score, coalesce(pl.required, 1) AS required FROM ob FULL JOIN (SELECT key, score, required FROM pl) pl USING (key, score))"""


@query("gen06", PLANNED_SQL + " SELECT key, score, required FROM ex")
def expanded_scores(spark, sf_dir):
    return _expanded(spark, sf_dir)


@query("gen05", PLANNED_SQL + """ SELECT key, score, required, CAST(greatest(required, ceil(400 * required / sum(required) OVER (PARTITION BY key))) AS BIGINT) AS amount FROM ex""")
def score_requests(spark, sf_dir):
    return RQ.score_requests(_expanded(spark, sf_dir), F.lit(400))


@query("gen07", PLANNED_SQL + """ SELECT a.key, a.score, a.required, b.score AS extra_score, b.required AS extra_required,
   CAST(greatest(least(greatest(a.required, b.required) * 2, 400), 4) AS BIGINT) AS amount FROM ex a JOIN pl b ON a.key = b.key""")
def extra_mean_requests(spark, sf_dir):
    return RQ.extra_mean_requests(
        _expanded(spark, sf_dir), _planned(spark, sf_dir).select("key", "score", "required"), F.lit(400)
    )


ALLOC_SQL = """a AS (SELECT *, coalesce(sum(raw) OVER (PARTITION BY {keys} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w),
 b AS (SELECT *, CAST(CASE WHEN k = m THEN greatest(requested - before, 0) ELSE least(raw, greatest(requested - before, 0)) END AS BIGINT) AS amount FROM a)"""


def _form_scores(spark, sf_dir):
    return field.survey(spark, sf_dir).where(c("origin") == "synthetic").groupBy(
        c("form_id").alias("key"), c("q_score").alias("score")
    ).agg(F.count(F.lit(1)).alias("required"))


@query("gen08", S_SQL.rstrip() + """, sc AS (SELECT form_id AS key, q_score AS score, count(*) AS required FROM survey WHERE origin = 'synthetic' GROUP BY 1, 2),
 su AS (SELECT form_id AS key, count(*) FILTER (WHERE q_status = 'F') AS members_needed, count(*) FILTER (WHERE q_status <> 'F') AS others_needed FROM survey WHERE origin = 'synthetic' GROUP BY 1),
 ct AS (SELECT form_id AS key, q_segment AS value, q_segment IN ('MACHINERY', 'BUILDING') AS is_member, count(*) AS n FROM survey GROUP BY 1, 2, 3),
 w AS (SELECT ct.*, sc.score, greatest(greatest(least(sc.required, CASE WHEN is_member THEN members_needed ELSE others_needed END), 1) * 3, 20) AS requested,
    row_number() OVER (PARTITION BY ct.key, sc.score, is_member ORDER BY value) AS k, count(*) OVER (PARTITION BY ct.key, sc.score, is_member) AS m,
    greatest(1, round_even(greatest(greatest(least(sc.required, CASE WHEN is_member THEN members_needed ELSE others_needed END), 1) * 3, 20) * n / sum(n) OVER (PARTITION BY ct.key, sc.score, is_member), 0)) AS raw
   FROM ct JOIN sc ON sc.key = ct.key JOIN su ON su.key = ct.key), """ + ALLOC_SQL.format(keys="key, score, is_member") + """
 SELECT key, score, is_member, value, amount FROM b WHERE amount > 0""")
def share_requests(spark, sf_dir):
    rows = field.survey(spark, sf_dir)
    target = F.lit("heavy").alias("target_id")
    supports = rows.where(c("origin") == "synthetic").groupBy(c("form_id").alias("key")).agg(
        F.count_if(c("q_status") == "F").alias("members_needed"), F.count_if(c("q_status") != "F").alias("others_needed")
    ).select("key", target, "members_needed", "others_needed")
    counts = rows.groupBy(c("form_id").alias("key"), c("q_segment").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(
        "key", target, "value", c("value").isin("MACHINERY", "BUILDING").alias("is_member"), "n"
    )
    return RQ.share_requests(_form_scores(spark, sf_dir), supports, counts).select(
        "key", "score", "is_member", "value", "amount"
    )


@query("gen10", S_SQL.rstrip() + """, sc AS (SELECT form_id AS key, q_score AS score, count(*) AS required FROM survey WHERE origin = 'synthetic' GROUP BY 1, 2),
 ct AS (SELECT form_id AS key, q_segment AS l, q_status AS r, q_status = 'F' AS has_option, count(*) AS n FROM survey WHERE q_segment IN ('MACHINERY', 'BUILDING') GROUP BY 1, 2, 3, 4),
 w AS (SELECT ct.*, sc.score, greatest(sc.required * 3, 30) AS requested, row_number() OVER (PARTITION BY ct.key, sc.score, has_option ORDER BY n DESC, l, r) AS k,
    count(*) OVER (PARTITION BY ct.key, sc.score, has_option) AS m, greatest(1, round_even(greatest(sc.required * 3, 30) * n / sum(n) OVER (PARTITION BY ct.key, sc.score, has_option), 0)) AS raw
   FROM ct JOIN sc ON sc.key = ct.key), """ + ALLOC_SQL.format(keys="key, score, has_option") + """
 SELECT key, score, has_option, l, r, amount FROM b WHERE amount > 0""")
def conditional_requests(spark, sf_dir):
    rows = field.survey(spark, sf_dir).where(c("q_segment").isin("MACHINERY", "BUILDING"))
    target = F.lit("cond").alias("target_id")
    supports = _form_scores(spark, sf_dir).select("key").distinct().select("key", target, F.lit(0.5).alias("value"))
    counts = rows.groupBy(
        c("form_id").alias("key"), c("q_segment").alias("left"), c("q_status").alias("right")
    ).agg(F.count(F.lit(1)).alias("n")).select(
        "key", target, "left", "right", (c("right") == "F").alias("has_option"), "n"
    )
    return RQ.conditional_requests(_form_scores(spark, sf_dir), supports, counts).select(
        "key", "score", "has_option", c("left").alias("l"), c("right").alias("r"), "amount"
    )


@query("gen12", "SELECT event_id, CAST(least(greatest(round_even(value, 0), 1), 5) AS INTEGER) AS score FROM events")
def normalised_scores(spark, sf_dir):
    return field.table(spark, sf_dir, "events").select(
        "event_id", RQ.normalised_score(c("value"), F.lit(1), F.lit(5)).alias("score")
    )


# Selection.
# Rows of the survey, what the additions make of it, and the sum that comes closest to a mean.
_SIZES_SQL = S_SQL.rstrip() + """, t AS (SELECT count(*) AS n, count(*) + greatest(1, count(*) // 10) AS f, sum(q_score) AS total, count(*) FILTER (WHERE q_status = 'F') AS members FROM survey)"""


def _outcome_sql(target: str, kind: str, requested: str, numerator: str, weight: str) -> str:
    """One outcome row over all f rows."""
    achieved = numerator if kind == "count" else f"{numerator} / f"
    error = f"abs({achieved} - CAST({requested} AS DOUBLE))"
    weighted = f"CASE WHEN {error} > 0 THEN NULL ELSE CAST(0 AS DOUBLE) END" if kind == "count" else f"{error} / {weight}"
    return (
        f" SELECT '{target}' AS target_id, '{kind}' AS kind, CAST({requested} AS DOUBLE) AS requested, CAST({achieved} AS DOUBLE) AS achieved, {error} AS absolute_error, "
        f"CAST({numerator} AS DOUBLE) AS numerator, f AS denominator, {weighted} AS weighted_error FROM t"
    )


def _chosen(spark, sf_dir):
    return _stored(spark, sf_dir, "chosen", lambda: materialise(
        SEL.select_for_targets(source(spark, sf_dir), pool(spark, sf_dir), job(spark, sf_dir))
    ))


def _final(spark, sf_dir):
    columns = ["submitted_at", "score_q_score", *JOB.categorical]
    return source(spark, sf_dir).select(*columns).unionByName(_chosen(spark, sf_dir).select(*columns))


@query("sel01")
def append_selection(spark, sf_dir):
    return V.outcomes(_final(spark, sf_dir), JOB.targets)


@query("sel01_errors", _SIZES_SQL + """ SELECT 'mean' AS target_id, round(abs(floor(CAST(3.1 AS DOUBLE) * f + 0.5) / f - 3.1), 9) AS absolute_error FROM t
 UNION ALL SELECT 'share', round(abs(floor(CAST(0.36 AS DOUBLE) * f + 0.5) / f - 0.36), 9) FROM t
 UNION ALL SELECT 'cond', CAST(0 AS DOUBLE)""")
def append_errors(spark, sf_dir):
    """Three targets at once, each at its own least error; every fifth denominator takes the conditional share exactly."""
    return append_selection(spark, sf_dir).select("target_id", F.round("absolute_error", 9).alias("absolute_error"))


@query("sel02")
def selected_signatures(spark, sf_dir):
    signed, names = SEL._signatures(_chosen(spark, sf_dir), JOB.targets)
    return signed.groupBy(*names).agg(F.count(F.lit(1)).alias("taken"))


_SOLO = V.MeanTarget("mean", "score_q_score", 3.1, 1, 5)


@query("sel03", S_SQL.rstrip() + """, t AS (SELECT count(*) AS n, count(*) // 10 AS additions, sum(q_score) AS total FROM survey),
 p AS (SELECT *, CAST(least(greatest(floor(CAST(3.1 AS DOUBLE) * (n + additions) - total + 0.5), additions), additions * 5) AS BIGINT) AS synthetic_sum FROM t)
 SELECT * FROM (SELECT CAST(synthetic_sum // additions AS DOUBLE) AS score, CAST(additions - (synthetic_sum - (synthetic_sum // additions) * additions) AS BIGINT) AS rows FROM p
   UNION ALL SELECT CAST(synthetic_sum // additions + 1 AS DOUBLE), CAST(synthetic_sum - (synthetic_sum // additions) * additions AS BIGINT) FROM p) WHERE rows > 0""")
def mean_only_selection(spark, sf_dir):
    base = PO.Job(final_count=0, means=(_SOLO,), categorical=JOB.categorical, seed=20)
    plan = PL.support_plans(source(spark, sf_dir), job(spark, sf_dir, base))["mean"]["scores"]
    rows = SEL.select_for_mean(source(spark, sf_dir), pool(spark, sf_dir), _SOLO, plan)
    return rows.groupBy(c("score_q_score").alias("score")).agg(F.count(F.lit(1)).alias("rows"))


@query("sel05", S_SQL.rstrip() + """, t AS (SELECT count(*) AS n, count(*) // 10 AS a, sum(q_score) AS total, count(*) FILTER (WHERE q_status = 'F') AS f FROM survey)
 SELECT 'mean' AS target_id, 0 AS violations, round(abs((total + CAST(least(greatest(floor(CAST(3.1 AS DOUBLE) * (n + a) - total + 0.5), a), a * 5) AS BIGINT)) / (n + a) - 3.1), 9) AS absolute_error FROM t
 UNION ALL SELECT 'share', 0, round(abs(CAST(least(greatest(floor(CAST(0.36 AS DOUBLE) * (n + a) + 0.5), f), f + a) AS BIGINT) / (n + a) - 0.36), 9) FROM t
 UNION ALL SELECT 'cond', 0, CAST(0 AS DOUBLE)""")
def support_guard(spark, sf_dir):
    """No violations: every target reaches the best value its own plan allows; every fifth population size takes 0.8 exactly."""
    j = job(spark, sf_dir)
    plans = PL.support_plans(source(spark, sf_dir), j)
    outcome = V.outcomes(_final(spark, sf_dir), j.targets)
    broken = SEL.support_violations(outcome, plans, j).agg(F.count(F.lit(1)).alias("violations"))
    # One-row count next to the outcome.
    return outcome.join(broken).select(
        "target_id", "violations", F.round("absolute_error", 9).alias("absolute_error")
    )


_COUNT = PO.Job(
    final_count=0, means=JOB.means, counts=(V.CountTarget("few", "q_q_status", frozenset({option_cell("F")}), 100),),
    categorical=JOB.categorical, seed=20,
)


@query("sel06", _SIZES_SQL + _outcome_sql("mean", "mean", "3.1", "floor(CAST(3.1 AS DOUBLE) * f + 0.5)", "4") + " UNION ALL "
       + _outcome_sql("few", "count", "100", "members", "1"))
def relaxed_counts(spark, sf_dir):
    """The count is below what the source already holds, so only the relaxed selection exists: no member is added.

    The weighted error of the missed count is infinite; shown as null.
    """
    j = job(spark, sf_dir, _COUNT)
    chosen = SEL.select_for_targets(source(spark, sf_dir), pool(spark, sf_dir), j, enforce_counts=False)
    columns = ["score_q_score", *JOB.categorical]
    outcome = V.outcomes(source(spark, sf_dir).select(*columns).unionByName(chosen.select(*columns)), j.targets)
    return outcome.withColumn("weighted_error", F.nullif("weighted_error", F.lit(float("inf"))))


_HIGH = PO.Job(
    final_count=0, means=(V.MeanTarget("mean", "score_q_score", 3.4, 1, 5),), shares=(SHARE,),
    categorical=JOB.categorical, seed=20,
)


def _plan(spark, sf_dir):
    def make():
        j = job(spark, sf_dir, _HIGH)
        chosen = SEL.select_for_targets(source(spark, sf_dir), pool(spark, sf_dir), j)
        columns = ["score_q_score", *JOB.categorical]
        outcome = V.outcomes(source(spark, sf_dir).select(*columns).unionByName(chosen.select(*columns)), j.targets)
        return SEL.plan_replacements(source(spark, sf_dir), pool(spark, sf_dir), j, V.selection_error(outcome).first()[0])

    return _stored(spark, sf_dir, "plan", make)


@query("rep01")
def replacement_plan(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    kept = plan.kept.agg(F.count(F.lit(1)).alias("kept_rows"))
    return kept.join(plan.chosen.agg(F.count(F.lit(1)).alias("chosen_rows"))).withColumn(
        "status", F.lit(plan.status)
    ).withColumn("replaced", F.lit(plan.removed_count))


@query("rep02", _SIZES_SQL + _outcome_sql("mean", "mean", "3.4", "floor(CAST(3.4 AS DOUBLE) * f + 0.5)", "4") + " UNION ALL "
       + _outcome_sql("share", "share", "0.36", "floor(CAST(0.36 AS DOUBLE) * f + 0.5)", "1"))
def replacement_outcome(spark, sf_dir):
    plan, columns = _plan(spark, sf_dir), ["score_q_score", *JOB.categorical]
    return V.outcomes(plan.kept.select(*columns).unionByName(plan.chosen.select(*columns)), _HIGH.targets)


@query("rep03")
def replacement_rows(spark, sf_dir):
    """Removed source rows by score: what the alternative gives up."""
    removed = source(spark, sf_dir).join(_plan(spark, sf_dir).kept.select("response_id"), "response_id", "left_anti")
    return removed.groupBy("score_q_score").agg(F.count(F.lit(1)).alias("removed_rows"))


@query("evl01")
def augmentation_report(spark, sf_dir):
    j = job(spark, sf_dir)
    return PL.report(PL.augment(source(spark, sf_dir), j), j)


def _spoiled(spark, sf_dir):
    """The survey as if it were finished rows: originals and made copies, some of them spoiled by their id."""
    rows = source(spark, sf_dir).select(c("response_id").cast("string").alias("response_id"), "submitted_at", "score_q_score", *JOB.categorical)
    k = c("response_id").cast("long") % 97
    kept = rows.withColumn("k", k).where("k <> 1").select(
        F.when(c("k") == 5, F.concat(F.lit("ghost:"), "response_id")).otherwise(c("response_id")).alias("response_id"),
        F.when(c("k") != 2, c("submitted_at")).alias("submitted_at"),
        F.when(c("k") == 3, c("score_q_score") + 1).otherwise(c("score_q_score")).alias("score_q_score"), *JOB.categorical,
        F.when(c("k") == 4, "unknown").otherwise("original").alias("origin"),
    )
    made = rows.withColumn("k", k).where("k between 50 and 60").select(
        F.when(c("k") == 53, "synthetic:same").otherwise(F.concat(F.lit("synthetic:"), "response_id")).alias("response_id"), "submitted_at",
        F.when(c("k") == 51, 9.0).when(c("k") == 54, c("score_q_score") - 0.5).otherwise(c("score_q_score")).alias("score_q_score"),
        "q_q_status", "q_q_segment", F.when(c("k") == 52, '{"state":"guessed"}').otherwise(c("q_q_flags")).alias("q_q_flags"),
        F.lit("synthetic").alias("origin"),
    )
    return rows, kept.unionByName(made)


@query("evl01_refusals", S_SQL.rstrip() + """, k AS (SELECT CAST(response_id AS BIGINT) % 97 AS k FROM survey)
 SELECT code, sum(n) AS rows FROM (
  SELECT 'lost_source_row' AS code, count(*) AS n FROM k WHERE k IN (1, 4, 5)
  UNION ALL SELECT 'invalid_timestamp', count(*) FROM k WHERE k = 2
  UNION ALL SELECT 'changed_source_row', count(*) FROM k WHERE k IN (2, 3)
  UNION ALL SELECT 'invalid_origin', count(*) FROM k WHERE k = 4
  UNION ALL SELECT 'unknown_source_row', count(*) FROM k WHERE k = 5
  UNION ALL SELECT 'invalid_score', count(*) FROM k WHERE k IN (51, 54)
  UNION ALL SELECT 'invalid_cell', count(*) FROM k WHERE k = 52
  UNION ALL SELECT 'repeated_response_id', 1 WHERE (SELECT count(*) FROM k WHERE k = 53) > 1
  UNION ALL SELECT 'row_count', 1 WHERE (SELECT count(*) FILTER (WHERE k <> 1) + count(*) FILTER (WHERE k BETWEEN 50 AND 60) FROM k) <> 1000
  UNION ALL SELECT 'original_count', 1 WHERE (SELECT count(*) FROM k WHERE k IN (1, 4)) > 0)
 GROUP BY code HAVING sum(n) > 0""")
def refusals_of_finished_rows(spark, sf_dir):
    """Findings by code over a finished table with spoiled rows."""
    rows, final = _spoiled(spark, sf_dir)
    spoiled_job = PO.Job(final_count=1000, means=JOB.means, categorical=JOB.categorical)
    found = FIN.finished_findings(final, rows, spoiled_job)
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("rows"))


@query("cmp01", S_SQL.rstrip() + """, y AS (SELECT year(submitted_at) AS year, count(*) AS n, sum(q_score) AS total FROM survey GROUP BY 1),
 a AS (SELECT *, n // 20 AS extra, CASE year WHEN 1996 THEN 3.2 ELSE 2.9 END AS wanted FROM y WHERE year IN (1996, 1998))
 SELECT year, 'original' AS origin, n AS rows, total / n AS mean_score FROM y
 UNION ALL SELECT year, 'synthetic', extra, least(greatest(floor(CAST(wanted AS DOUBLE) * (n + extra) - total + 0.5), extra), 5 * extra) / extra FROM a WHERE extra > 0""")
def batch_of_rules(spark, sf_dir):
    """Two disjoint years, each with its own mean; rows outside both years stay as they are."""
    rules = {}
    for rule, year, mean in (("y96", 1996, 3.2), ("y98", 1998, 2.9)):
        scope = Scope(f"{year}-01-01 00:00:00", f"{year}-12-31 00:00:00")
        rows = source(spark, sf_dir).where(scope.predicate()).count()
        own = V.MeanTarget("mean", "score_q_score", mean, 1, 5)
        rules[rule] = (scope, PO.Job(final_count=rows + rows // 20, means=(own,), categorical=JOB.categorical, seed=4))
    done = PL.augment_batch(source(spark, sf_dir), rules)
    return done.groupBy(F.year("submitted_at").alias("year"), "origin").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("score_q_score").alias("mean_score")
    )
