"""Sources, sinks, revisions, runs, composition and export over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from canvass.functions.slots import slot
from canvass.operators import compose as C
from canvass.operators import export as X
from canvass.operators import profile as P
from canvass.operators.scope import Scope, in_scope, scope_overlaps
from canvass.plans import allocation as A
from canvass.plans import targets as T
from canvass.plans import vectors as V
from canvass.queries import field, planning
from canvass.queries.answers import A_CELLS, HEAVY_CELLS, flat, option_cell
from canvass.queries.field import BASE_SQL, SURVEY_SQL, ctes
from canvass.queries.planning import TM
from canvass.queries.profiles import OPTION_METRIC_SQL
from canvass.queries.registry import query
from canvass.scale import hash_order, join_dimension, number_by_hash, prefix_sums
from canvass.session import materialise, shared_dir
from canvass.sources import tables as ST
from canvass.sources.flat import decode_result

c = F.col
S = ctes(SURVEY_SQL)
PLAIN = ("response_id", "form_id", "submitted_at", "origin", "q_status", "q_score", "q_priority", "q_segment")


def _root(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _plain(spark, sf_dir):
    return field.survey(spark, sf_dir).select(*PLAIN)


@query("src01", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def parquet_scan(spark, sf_dir):
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    return ST.read_source(spark, f"{sf_dir}/orders.parquet", schema)


@query("src02", S + "SELECT form_id, q_status, count(*) AS responses FROM survey GROUP BY 1, 2")
def parquet_sink(spark, sf_dir):
    path = _root(spark, "src02")
    ST.write_parquet(_plain(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("form_id", "q_status").agg(F.count(F.lit(1)).alias("responses"))


@query("src03", "SELECT count(*) AS source_rows, count(*) AS result_rows, 11 AS source_columns, 11 AS result_columns FROM lineitem")
def round_trip(spark, sf_dir):
    return ST.round_trip(field.table(spark, sf_dir, "lineitem"), _root(spark, "src03"))


@query("src11", S + """SELECT 'r1' AS revision_id, count(*) AS responses FROM survey WHERE q_status <> 'O' UNION ALL SELECT 'r2', count(*) FROM survey""")
def revisions(spark, sf_dir):
    root, rows = _root(spark, "src11"), _plain(spark, sf_dir)
    ST.append_revision(rows.where(c("q_status") != "O"), root, "p", "r1", first_import=True)
    ST.append_revision(rows, root, "p", "r2")
    return spark.read.parquet(f"{root}/responses").groupBy("revision_id").agg(F.count(F.lit(1)).alias("responses"))


@query("src12", S + "SELECT 'p' AS project_id, 'r1' AS revision_id, count(*) AS responses FROM survey")
def first_import(spark, sf_dir):
    root = _root(spark, "src12")
    ST.append_revision(_plain(spark, sf_dir), root, "p", "r1", first_import=True)
    return ST.current_revision(spark, root).join(
        ST.read_revision(spark, root, "p", "r1").agg(F.count(F.lit(1)).alias("responses"))
    )


@query("src13", S + """SELECT 'r2' AS revision_id, count(*) AS responses, count(*) FILTER (WHERE q_status = 'O') AS new_responses FROM survey""")
def source_refresh(spark, sf_dir):
    root, rows = _root(spark, "src13"), _plain(spark, sf_dir)
    ST.append_revision(rows.where(c("q_status") != "O"), root, "p", "r1", first_import=True)
    ST.append_revision(rows, root, "p", "r2")
    old, new = (ST.read_revision(spark, root, "p", r) for r in ("r1", "r2"))
    fresh = new.join(old.select("response_id"), "response_id", "left_anti").agg(F.count(F.lit(1)).alias("new_responses"))
    current = ST.current_revision(spark, root).select("revision_id")
    return current.join(new.agg(F.count(F.lit(1)).alias("responses"))).join(fresh)


@query("src14", S + "SELECT response_id, form_id, q_status FROM survey ORDER BY submitted_at, response_id")
def ordered_scan(spark, sf_dir):
    return ST.list_responses(_plain(spark, sf_dir)).select("response_id", "form_id", "q_status")


# A result table in which open-status rows of accounts in debt claim to be originals.
RESULT_SQL = """result AS (SELECT response_id, CASE WHEN origin = 'synthetic' AND q_status = 'O' THEN 'original' ELSE origin END AS origin, q_score FROM survey),
 source AS (SELECT response_id, q_status FROM survey WHERE origin = 'original'),
 dec AS (SELECT r.response_id, r.origin, s.q_status AS source_status, CASE WHEN r.origin = 'original' AND s.response_id IS NULL THEN 'unknown_source_row' END AS problem
   FROM result r LEFT JOIN source s ON s.response_id = r.response_id)"""


def _decoded(spark, sf_dir):
    rows = field.survey(spark, sf_dir)
    result = rows.select(
        "response_id", "submitted_at", "q_score",
        F.when((c("origin") == "synthetic") & (c("q_status") == "O"), "original").otherwise(c("origin")).alias("origin"),
    )
    return decode_result(result, rows.where(c("origin") == "original").select("response_id", "q_status"))


@query("src16", S.rstrip() + ", " + RESULT_SQL + " SELECT * FROM dec")
def decoded_result(spark, sf_dir):
    return _decoded(spark, sf_dir).select("response_id", "origin", c("source.q_status").alias("source_status"), "problem")


@query("join08", S.rstrip() + ", " + RESULT_SQL + " SELECT origin, coalesce(problem, 'none') AS problem, count(*) AS rows FROM dec GROUP BY 1, 2")
def decode_problems(spark, sf_dir):
    return _decoded(spark, sf_dir).groupBy("origin", F.coalesce("problem", F.lit("none")).alias("problem")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def _run(spark, sf_dir):
    root = _root(spark, "run")
    ST.persist_run(_plain(spark, sf_dir), root, "run-1")
    return root


INDEX_SQL = "SELECT row_number() OVER (ORDER BY submitted_at, response_id) - 1 AS row_index, response_id, origin FROM survey"


@query("src17", S + "SELECT 'run-1' AS run_id, count(*) AS final_count, count(*) FILTER (WHERE origin = 'synthetic') AS synthetic_count FROM survey")
def persisted_run(spark, sf_dir):
    return spark.read.parquet(f"{_run(spark, sf_dir)}/runs")


@query("src18", S + INDEX_SQL)
def run_rows(spark, sf_dir):
    return ST.read_run(spark, _run(spark, sf_dir), "run-1").select("row_index", "response_id", "origin")


@query("win04", S + INDEX_SQL)
def row_index(spark, sf_dir):
    rows = _plain(spark, sf_dir)
    return prefix_sums(rows, ["submitted_at", "response_id"], {"n": F.lit(1)}).select(
        (c("n") - 1).alias("row_index"), "response_id", "origin"
    )


@query("win03", S + """SELECT form_id, count(*) AS rows, count(*) AS distinct_ids, 1 AS first_number, count(*) AS last_number FROM survey WHERE origin = 'synthetic' GROUP BY 1""")
def synthetic_ids(spark, sf_dir):
    rows = _plain(spark, sf_dir).where(c("origin") == "synthetic")
    numbered = number_by_hash(rows, ["form_id"], hash_order(7, "response_id"), tie=["response_id"]).withColumn(
        "synthetic_id", F.concat_ws(":", F.lit("synthetic"), F.lit(7), "rn")
    )
    return numbered.groupBy("form_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("synthetic_id").alias("distinct_ids"),
        F.min("rn").alias("first_number"), F.max("rn").alias("last_number"),
    )


# Weighted requests: every form asks for as many rows as it has responses in debt.
WEIGHT_SQL = """rq AS (SELECT form_id, count(*) AS requested FROM survey WHERE origin = 'synthetic' GROUP BY 1)"""


@query("win05", S.rstrip() + ", " + WEIGHT_SQL + """, v AS (SELECT s.form_id, s.q_segment AS value, count(*) AS n FROM survey s GROUP BY 1, 2),
 w AS (SELECT v.*, rq.requested, greatest(1, round_even(rq.requested * (n / sum(n) OVER (PARTITION BY v.form_id)), 0)) AS raw,
    row_number() OVER (PARTITION BY v.form_id ORDER BY value) AS k, count(*) OVER (PARTITION BY v.form_id) AS m FROM v JOIN rq USING (form_id)),
 a AS (SELECT *, coalesce(sum(raw) OVER (PARTITION BY form_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
 SELECT form_id, value, CAST(CASE WHEN k = m THEN greatest(requested - before, 0) ELSE least(raw, greatest(requested - before, 0)) END AS BIGINT) AS amount FROM a
 WHERE CASE WHEN k = m THEN greatest(requested - before, 0) ELSE least(raw, greatest(requested - before, 0)) END > 0""")
def weighted_requests(spark, sf_dir):
    rows = field.survey(spark, sf_dir)
    requested = rows.where(c("origin") == "synthetic").groupBy("form_id").agg(F.count(F.lit(1)).alias("requested"))
    counts = rows.groupBy("form_id", c("q_segment").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return A.weighted_requests(counts.join(requested, "form_id"), ["form_id"], [c("value")]).select(
        "form_id", "value", "amount"
    )


@query("win06", S.rstrip() + ", " + WEIGHT_SQL + """, v AS (SELECT s.form_id, s.q_segment AS l, s.q_status AS r, count(*) AS n FROM survey s GROUP BY 1, 2, 3),
 w AS (SELECT v.*, rq.requested, greatest(1, round_even(rq.requested * n / sum(n) OVER (PARTITION BY v.form_id), 0)) AS raw,
    row_number() OVER (PARTITION BY v.form_id ORDER BY n DESC, l, r) AS k, count(*) OVER (PARTITION BY v.form_id) AS m FROM v JOIN rq USING (form_id)),
 a AS (SELECT *, coalesce(sum(raw) OVER (PARTITION BY form_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w),
 b AS (SELECT *, CAST(CASE WHEN k = m THEN greatest(requested - before, 0) ELSE least(raw, greatest(requested - before, 0)) END AS BIGINT) AS amount FROM a)
 SELECT form_id, l, r, amount FROM b WHERE amount > 0""")
def joint_requests(spark, sf_dir):
    rows = field.survey(spark, sf_dir)
    requested = rows.where(c("origin") == "synthetic").groupBy("form_id").agg(F.count(F.lit(1)).alias("requested"))
    counts = rows.groupBy("form_id", c("q_segment").alias("l"), c("q_status").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    return A.weighted_requests(
        counts.join(requested, "form_id"), ["form_id"], [F.desc("n"), c("l"), c("r")]
    ).select("form_id", "l", "r", "amount")


@query("win07", S + """SELECT a.response_id AS removed_id, b.response_id AS replacement_id FROM (
   SELECT response_id, row_number() OVER (ORDER BY response_id) AS k FROM survey WHERE q_status = 'F') a
  JOIN (SELECT response_id, row_number() OVER (ORDER BY response_id) AS k FROM survey WHERE q_status = 'P') b ON a.k = b.k""")
def replacement_pairs(spark, sf_dir):
    rows = field.survey(spark, sf_dir)
    return A.pair_rows(
        rows.where(c("q_status") == "F").select("response_id"), rows.where(c("q_status") == "P").select("response_id"),
    )


@query("set01", S + "SELECT CAST(response_id AS VARCHAR) AS response_id, 'original' AS origin, q_status FROM survey UNION ALL SELECT 'synthetic:' || response_id, 'synthetic', q_status FROM survey WHERE q_score = 5")
def tagged_union(spark, sf_dir):
    rows = field.survey(spark, sf_dir).select(c("response_id").cast("string").alias("response_id"), "q_score", "q_status")
    extra = rows.where(c("q_score") == 5).withColumn("response_id", F.concat(F.lit("synthetic:"), "response_id"))
    return rows.withColumn("origin", F.lit("original")).unionByName(
        extra.withColumn("origin", F.lit("synthetic"))
    ).select("response_id", "origin", "q_status")


@query("set02", S + "SELECT 'score:' || q_score AS batch, count(*) AS rows FROM survey GROUP BY 1 UNION ALL SELECT 'heavy', count(*) FROM survey WHERE q_segment IN ('MACHINERY', 'BUILDING')")
def batch_union(spark, sf_dir):
    """All directed batches as one plan: each row carries the batches it belongs to."""
    batches = F.filter(
        F.array(
            F.concat(F.lit("score:"), "q_score"),
            F.when(c("q_segment").isin("MACHINERY", "BUILDING"), "heavy"),
        ),
        lambda b: b.isNotNull(),
    )
    return field.survey(spark, sf_dir).select(F.explode(batches).alias("batch")).groupBy("batch").agg(
        F.count(F.lit(1)).alias("rows")
    )


@query("set05", S + "SELECT response_id FROM survey WHERE q_segment = 'MACHINERY'")
def removed_rows(spark, sf_dir):
    rows = field.survey(spark, sf_dir)
    kept = rows.where(c("q_segment") != "MACHINERY").select("response_id")
    return rows.select("response_id").join(kept, "response_id", "left_anti")


RULES = {"y96": Scope("1996-01-01 00:00:00", "1996-12-31 00:00:00"), "y98": Scope("1998-01-01 00:00:00", "1998-12-31 00:00:00")}
Y96, Y98 = "submitted_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'", "submitted_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31'"
CHILD_SQL = f"""child AS (SELECT 'y96' AS rule_id, CAST(response_id AS VARCHAR) AS response_id, 'original' AS origin, form_id FROM survey WHERE {Y96}
   UNION ALL SELECT 'y96', 'synthetic:1:' || response_id, 'synthetic', form_id FROM survey WHERE {Y96} AND q_score = 5
   UNION ALL SELECT 'y98', CAST(response_id AS VARCHAR), 'original', form_id FROM survey WHERE {Y98}
   UNION ALL SELECT 'y98', 'synthetic:1:' || response_id, 'synthetic', form_id FROM survey WHERE {Y98} AND q_score = 1),
 composed AS (SELECT CASE WHEN origin = 'synthetic' THEN rule_id || ':' || response_id ELSE response_id END AS response_id, origin, form_id FROM child
   UNION ALL SELECT CAST(response_id AS VARCHAR), 'original', form_id FROM survey WHERE NOT ({Y96}) AND NOT ({Y98}))"""


def _base_and_children(spark, sf_dir):
    """Two child runs: their scopes plus copies of the best (1996) and worst (1998) scores."""
    base = field.survey(spark, sf_dir).select(
        c("response_id").cast("string").alias("response_id"), "submitted_at", F.lit("original").alias("origin"), "form_id", "q_score"
    )
    children = None
    for (rule, scope), score in zip(RULES.items(), (5, 1), strict=True):
        own = in_scope(base, scope)
        extra = own.where(c("q_score") == score).withColumn(
            "response_id", F.concat(F.lit("synthetic:1:"), "response_id")
        ).withColumn("origin", F.lit("synthetic"))
        rows = own.unionByName(extra).withColumn("rule_id", F.lit(rule))
        children = rows if children is None else children.unionByName(rows)
    return base, children


@query("set03", S.rstrip() + ", " + CHILD_SQL + " SELECT origin, form_id, count(*) AS rows FROM composed GROUP BY 1, 2")
def composite_union(spark, sf_dir):
    base, children = _base_and_children(spark, sf_dir)
    return C.compose(base, RULES, children).groupBy("origin", "form_id").agg(F.count(F.lit(1)).alias("rows"))


@query("cmp02", S.rstrip() + ", " + CHILD_SQL + " SELECT * FROM composed")
def composition(spark, sf_dir):
    base, children = _base_and_children(spark, sf_dir)
    return C.compose(base, RULES, children).select("response_id", "origin", "form_id")


@query("agg22", S.rstrip() + ", " + CHILD_SQL + f""" SELECT (SELECT count(*) FROM survey) AS base_rows, (SELECT count(*) FROM survey WHERE ({Y96}) OR ({Y98})) AS scope_rows,
  (SELECT count(*) FROM child) AS child_rows, (SELECT count(*) FROM composed) AS composed_rows, (SELECT count(DISTINCT response_id) FROM composed) AS distinct_ids,
  TRUE AS count_holds, TRUE AS ids_unique""")
def composite_invariants(spark, sf_dir):
    base, children = _base_and_children(spark, sf_dir)
    return C.composite_checks(base, RULES, children, C.compose(base, RULES, children))


@query("join09", S + f"SELECT response_id FROM survey WHERE NOT ({Y96}) AND NOT ({Y98})")
def unclaimed_rows(spark, sf_dir):
    base = field.survey(spark, sf_dir)
    claimed = base.where(RULES["y96"].predicate() | RULES["y98"].predicate())
    return C.not_claimed(base, claimed).select("response_id")


@query("join10", S + """SELECT response_id, CASE WHEN a THEN 'early' ELSE 'middle' END AS first_rule, CASE WHEN a AND b THEN 'middle' ELSE 'late' END AS second_rule,
   CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(d AS INTEGER) AS claim_count FROM (SELECT response_id, submitted_at <= TIMESTAMP '1997-06-30' AS a,
   submitted_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-03-31' AS b, submitted_at >= TIMESTAMP '1999-01-01' AS d FROM survey)
  WHERE CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(d AS INTEGER) > 1""")
def overlapping_scopes(spark, sf_dir):
    rules = {
        "early": Scope(None, "1997-06-30 00:00:00"), "middle": Scope("1997-01-01 00:00:00", "1999-03-31 00:00:00"),
        "late": Scope("1999-01-01 00:00:00", None),
    }
    return scope_overlaps(field.survey(spark, sf_dir), rules)


WANT_SQL = """want AS (SELECT form_id AS run_id, v.* FROM forms, (VALUES ('F', 'share'), ('O', 'share'), ('P', 'count'), ('X', 'share')) v(target_id, kind)),
 have AS (SELECT DISTINCT form_id AS run_id, q_status AS target_id, 'share' AS kind FROM survey)"""


@query("join11", BASE_SQL.rstrip() + ", " + WANT_SQL + """ SELECT coalesce(h.run_id, w.run_id) AS run_id, coalesce(h.target_id, w.target_id) AS target_id, coalesce(h.kind, w.kind) AS kind,
   CASE WHEN h.run_id IS NULL THEN 'missing_outcome' WHEN w.run_id IS NULL THEN 'unknown_target' END AS problem
  FROM have h FULL JOIN want w ON h.run_id = w.run_id AND h.target_id = w.target_id AND h.kind = w.kind""")
def outcome_completeness(spark, sf_dir):
    wanted = F.array(*[
        F.struct(F.lit(t).alias("target_id"), F.lit(k).alias("kind"))
        for t, k in (("F", "share"), ("O", "share"), ("P", "count"), ("X", "share"))
    ])
    want = field.forms(spark, sf_dir).select(c("form_id").alias("run_id"), F.inline(wanted))
    have = field.survey(spark, sf_dir).select(
        c("form_id").alias("run_id"), c("q_status").alias("target_id"), F.lit("share").alias("kind")
    ).distinct()
    return V.complete_outcome(have, want)


BEFORE_SQL = BASE_SQL.rstrip() + ", belig AS (SELECT form_id, count(*) AS d FROM survey WHERE origin = 'original' GROUP BY 1), bpick AS (SELECT form_id, q_status AS option_key, count(*) AS n FROM survey WHERE origin = 'original' GROUP BY 1, 2)"


@query("join12", BEFORE_SQL + f""" SELECT o.form_id, o.option_key, o.option_key AS label, CASE WHEN e.d > 0 THEN coalesce(b.n, 0) / e.d ELSE 0.0 END AS current_share, r.share AS result_share
  FROM (SELECT * FROM options WHERE question_id = 'q_status') o LEFT JOIN belig e ON e.form_id = o.form_id
  LEFT JOIN bpick b ON b.form_id = o.form_id AND b.option_key = o.option_key
  JOIN ({OPTION_METRIC_SQL}) r ON r.form_id = o.form_id AND r.question_id = 'q_status' AND r.option_key = o.option_key""")
def outcome_against_baseline(spark, sf_dir):
    """Both sides of the comparison come from one aggregate over origin."""
    options = field.options(spark, sf_dir).where(c("question_id") == "q_status")
    counts = field.survey(spark, sf_dir).groupBy("form_id", c("q_status").alias("option_key")).agg(
        F.count(F.lit(1)).alias("all_n"), F.count_if(c("origin") == "original").alias("old_n")
    )
    # Bounded by the options of one question.
    per_form = Window.partitionBy("form_id")
    rows = options.join(counts, ["form_id", "option_key"], "left").select(
        "form_id", "option_key", "label", F.coalesce("all_n", F.lit(0)).alias("all_n"), F.coalesce("old_n", F.lit(0)).alias("old_n")
    ).withColumn("all_d", F.sum("all_n").over(per_form)).withColumn("old_d", F.sum("old_n").over(per_form))
    return rows.select(
        "form_id", "option_key", "label", P.share_of(c("old_n"), c("old_d")).alias("current_share"),
        P.share_of(c("all_n"), c("all_d")).alias("result_share"),
    )


@query("join18", TM.split(", profile AS")[0] + """ SELECT draft_id, count(*) FILTER (WHERE group_id = 'g_heavy') AS dependents,
   count(*) FILTER (WHERE group_id IS NULL OR group_id <> 'g_heavy') AS kept FROM targets GROUP BY 1""")
def group_repair(spark, sf_dir):
    from canvass.operators.groups import repair_targets

    removed = field.members(spark, sf_dir).where(c("group_id") == "g_heavy")
    dependents, kept = repair_targets(planning.targets(spark, sf_dir), removed)
    tagged = dependents.select("draft_id", F.lit(1).alias("d")).unionByName(kept.select("draft_id", F.lit(0).alias("d")))
    return tagged.groupBy("draft_id").agg(
        F.count_if(c("d") == 1).alias("dependents"), F.count_if(c("d") == 0).alias("kept")
    )


FROZEN_SQL = TM.replace(
    "ON l.l_orderkey = o.o_orderkey)",
    "ON l.l_orderkey = o.o_orderkey\n WHERE o.o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31')", 1,
)


@query("agg08", FROZEN_SQL + f""" SELECT t.draft_id, t.position, m.count, m.denominator_count, m.metric_value FROM (SELECT *, {planning.KEY_SQL} AS skey FROM targets) t
  JOIN metrics m ON m.form_id = t.form_id AND m.subject_key = t.skey""")
def frozen_baselines(spark, sf_dir):
    """Metrics of every frozen target, recomputed on the run's own scope."""
    scoped = in_scope(field.responses(spark, sf_dir), field.SCOPE)
    profile = P.profile(
        scoped, field.questions(spark, sf_dir), field.options(spark, sf_dir), field.members(spark, sf_dir),
        field.score_map(spark, sf_dir),
    )
    metrics = materialise(T.subject_metrics(profile, field.questions(spark, sf_dir)))
    targets = planning.targets(spark, sf_dir).withColumn("subject_key", T.subject_key())
    return join_dimension(targets, metrics, ["form_id", "subject_key"]).select("draft_id", "position", "count", "denominator_count", "metric_value")


TARGETS = (
    V.MeanTarget("mean", "score_q_score", 3.2, 1, 5),
    V.ShareTarget("share", "q_q_status", frozenset({option_cell("F")}), 0.4),
    V.CountTarget("count", "q_q_flags", A_CELLS, 5000),
    V.ConditionalTarget("cond", "q_q_segment", HEAVY_CELLS, "q_q_flags", A_CELLS, 0.6),
)
_EL = "q_flags_state IN ('answered', 'skipped')"
_HA = "(q_flags_state = 'answered' AND has_a = 1)"
_HV = "q_segment IN ('MACHINERY', 'BUILDING')"
OUTCOME_SQL = f"""oc AS (SELECT 'mean' AS target_id, 3.2 AS requested, CAST(sum(q_score) AS DOUBLE) AS numerator, count(q_score) AS denominator FROM survey
  UNION ALL SELECT 'share', 0.4, CAST(count(*) FILTER (WHERE q_status = 'F') AS DOUBLE), count(*) FROM survey
  UNION ALL SELECT 'count', 5000.0, CAST(count(*) FILTER (WHERE {_HA}) AS DOUBLE), count(*) FROM survey
  UNION ALL SELECT 'cond', 0.6, CAST(count(*) FILTER (WHERE {_HV} AND {_HA}) AS DOUBLE), count(*) FILTER (WHERE {_HV} AND {_EL}) FROM survey),
 oe AS (SELECT *, CASE WHEN target_id = 'count' THEN numerator ELSE numerator / denominator END AS achieved FROM oc)"""


@query("agg27", S.rstrip() + ", " + OUTCOME_SQL + """ SELECT target_id, numerator, denominator, round(achieved, 9) AS achieved, round(abs(achieved - requested), 9) AS absolute_error FROM oe""")
def achievement_vector(spark, sf_dir):
    return V.outcomes(flat(spark, sf_dir), TARGETS).select(
        "target_id", "numerator", "denominator", F.round("achieved", 9).alias("achieved"), F.round("absolute_error", 9).alias("absolute_error")
    )


@query("agg26", S.rstrip() + ", " + OUTCOME_SQL + """, e AS (SELECT *, abs(achieved - requested) / CASE target_id WHEN 'mean' THEN 4 ELSE 1 END AS error FROM oe)
 SELECT round(sum(error) FILTER (WHERE target_id <> 'count'), 9) AS open_error, bool_or(target_id = 'count' AND error > 0) AS infinite FROM e""")
def selection_error(spark, sf_dir):
    """All targets: a missed exact count makes the whole error infinite, whatever the others add up to."""
    outcome = V.outcomes(flat(spark, sf_dir), TARGETS)
    open_error = V.selection_error(outcome.where(c("kind") != "count")).select(F.round("selection_error", 9).alias("open_error"))
    # One-row tables side by side.
    return open_error.join(V.selection_error(outcome).select((c("selection_error") == float("inf")).alias("infinite")))


@query("sel04", S.rstrip() + ", " + OUTCOME_SQL + """ SELECT target_id, round(achieved, 9) AS achieved FROM oe""")
def zero_additions(spark, sf_dir):
    """With no additions the outcome is the source's own."""
    return V.outcomes(flat(spark, sf_dir), TARGETS).select("target_id", F.round("achieved", 9).alias("achieved"))


@query("agg28", S.rstrip() + ", " + OUTCOME_SQL + """ SELECT target_id, numerator AS numerator_now, numerator + 1 AS numerator FROM oe WHERE target_id = 'share'""")
def outcome_cross_check(spark, sf_dir):
    """The plan claims one share member too many; only that target disagrees with the table."""
    rows = flat(spark, sf_dir)
    planned = V.outcomes(rows, TARGETS).select(
        "target_id", (c("numerator") + F.when(c("target_id") == "share", 1).otherwise(0)).alias("numerator"),
        "denominator", "achieved",
    )
    return V.cross_check(rows, TARGETS, planned).select("target_id", "numerator_now", "numerator")


# Export: the survey questions plus a date, a time and an "other" answer.
def export_slots(spark, sf_dir):
    day = F.date_format("submitted_at", "yyyy-MM-dd")
    done = F.lit("answered")
    extra = F.array(
        slot(question_id=F.lit("q_day"), kind=F.lit("date"), state=done,
             text=F.when(c("q_status") == "O", F.concat(F.substring(day, 1, 8), F.lit("31"))).otherwise(day)),
        slot(question_id=F.lit("q_time"), kind=F.lit("time"), state=done,
             text=F.format_string("%02d:%02d", c("q_score") * 6, (c("response_id") % 60).cast("int"))),
    )
    from canvass.functions.slots import explode_slots

    rows = field.with_answers(field.survey(spark, sf_dir)).withColumn("answers", F.concat("answers", extra))
    return explode_slots(rows, "origin")


def _cells(spark, sf_dir):
    form_options = field.options(spark, sf_dir).where(c("question_id") == "q_flags").groupBy("form_id", "question_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", "option_key", "label"))),
            lambda o: F.struct(o["option_key"].alias("option_key"), F.concat(F.lit("+"), o["label"]).alias("label")),
        ).alias("form_options")
    )
    flags = field.forms(spark, sf_dir).select("form_id", F.inline(F.array(*[
        F.struct(F.lit(q).alias("question_id"), F.lit(y).alias("include_year"), F.lit(False).alias("include_time"), F.lit(d).alias("duration"))
        for q, y, d in (("q_day", True, None), ("q_time", None, False))
    ])))
    return X.export_cells(export_slots(spark, sf_dir), form_options, flags)


EXPORT_SQL = """dd AS (SELECT *, strftime(submitted_at, '%Y-%m-%d') AS iso, substr(strftime(submitted_at, '%Y-%m-%d'), 1, 8) || '31' AS odd,
    printf('%02d:%02d', q_score * 6, CAST(response_id % 60 AS INTEGER)) AS hm, response_id % 60 AS mi FROM survey),
 cell AS (SELECT response_id, origin, submitted_at, 'q_status' AS question_id, 'text' AS cell_kind, q_status AS v FROM dd
  UNION ALL SELECT response_id, origin, submitted_at, 'q_score', 'number', CAST(q_score AS VARCHAR) FROM dd
  UNION ALL SELECT response_id, origin, submitted_at, 'q_priority', 'text', q_priority FROM dd
  UNION ALL SELECT response_id, origin, submitted_at, 'q_segment', 'text', q_segment FROM dd
  UNION ALL SELECT response_id, origin, submitted_at, 'q_flags', CASE WHEN q_flags_state = 'answered' THEN 'text' ELSE 'empty' END,
     CASE WHEN q_flags_state = 'answered' THEN concat_ws(', ', CASE WHEN has_a = 1 THEN '+A' END, CASE WHEN has_n = 1 THEN '+N' END, CASE WHEN has_r = 1 THEN '+R' END) END FROM dd
  UNION ALL SELECT response_id, origin, submitted_at, 'q_day', CASE WHEN q_status <> 'O' OR TRY_CAST(odd AS DATE) IS NOT NULL THEN 'date' ELSE 'text' END, CASE WHEN q_status = 'O' THEN odd ELSE iso END FROM dd
  UNION ALL SELECT response_id, origin, submitted_at, 'q_time', CASE WHEN q_score * 6 <= 23 THEN 'time' ELSE 'text' END, hm FROM dd),
 csv AS (SELECT *, CASE WHEN cell_kind = 'empty' THEN '' WHEN cell_kind = 'text' AND regexp_matches(v, '^[\\s]*[=+\\-@]') THEN '''' || v ELSE v END AS csv FROM cell)"""


@query("scl11", S.rstrip() + ", " + EXPORT_SQL + """ SELECT question_id, cell_kind, count(*) AS cells, count(v) AS filled FROM cell GROUP BY 1, 2""")
def export_cells(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    filled = F.coalesce("text_value", c("number_value").cast("string"), c("seconds_value").cast("string"), "iso_value")
    return cells.groupBy("question_id", "cell_kind").agg(F.count(F.lit(1)).alias("cells"), F.count(filled).alias("filled"))


@query("scl12", S.rstrip() + ", " + EXPORT_SQL + " SELECT response_id, v AS text_value FROM cell WHERE question_id = 'q_flags' AND cell_kind = 'text'")
def checkbox_text(spark, sf_dir):
    return _cells(spark, sf_dir).where((c("question_id") == "q_flags") & (c("cell_kind") == "text")).select(
        "response_id", "text_value"
    )


@query("scl15", S.rstrip() + ", " + EXPORT_SQL + """ SELECT response_id, question_id, CASE WHEN regexp_matches(csv, '[",\r\n]') THEN '"' || replace(csv, '"', '""') || '"' ELSE csv END AS csv FROM csv""")
def csv_cells(spark, sf_dir):
    return _cells(spark, sf_dir).select("response_id", "question_id", X.csv_quoted(X.csv_cell()).alias("csv"))


TITLES = {None: X.SUBMITTED_HEADER, **{q: q for q in (*field.QUESTIONS, "q_day", "q_time")}}
PIVOT_SQL = f"""wide AS (SELECT response_id, submitted_at, origin, {", ".join(f"max(csv) FILTER (WHERE question_id = '{q}') AS {q}" for q in TITLES if q)} FROM csv GROUP BY 1, 2, 3)"""


@query("cmp04", S.rstrip() + ", " + EXPORT_SQL + ", " + PIVOT_SQL + f""" SELECT strftime(submitted_at, '%Y-%m-%dT%H:%M:%S.000Z') AS "{X.SUBMITTED_HEADER}", {", ".join(q for q in TITLES if q)}, origin AS __origin FROM wide""")
def logical_export(spark, sf_dir):
    return X.export_table(_cells(spark, sf_dir), TITLES)


@query("sort01", S + "SELECT row_number() OVER (ORDER BY submitted_at, response_id) AS position, response_id FROM survey")
def export_order(spark, sf_dir):
    rows = field.survey(spark, sf_dir).select("submitted_at", "response_id")
    return prefix_sums(rows, ["submitted_at", "response_id"], {"position": F.lit(1)}).select("position", "response_id")


@query("src21", S.rstrip() + ", " + EXPORT_SQL + ", " + PIVOT_SQL + """ SELECT q_status, q_flags, q_time, count(*) AS rows FROM wide GROUP BY 1, 2, 3""")
def csv_sink(spark, sf_dir):
    """Written as CSV and read back; formula-like cells keep their guard."""
    path = _root(spark, "src21")
    X.write_csv(X.export_table(_cells(spark, sf_dir), TITLES), path)
    names = [TITLES[q] for q in TITLES] + ["__origin"]
    schema = ", ".join(f"`{n}` string" for n in names)
    back = spark.read.schema(schema).csv(path, header=True, lineSep="\r\n", quote='"', escape='"', emptyValue="", nullValue="\0")
    # An empty CSV field reads back as null.
    return back.fillna("").groupBy("q_status", "q_flags", "q_time").agg(F.count(F.lit(1)).alias("rows"))
