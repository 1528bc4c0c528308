"""Target drafts over the driver tables: one draft per customer, on the form of its nation.

What a draft asks for follows from the customer row (balance, segment, number of orders), so
that valid, out-of-range, unsupported, conflicting and duplicate targets all occur.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.functions.slots import explode_slots
from canvass.operators import profile as P
from canvass.plans import support as S
from canvass.plans import targets as T
from canvass.queries import field
from canvass.queries.field import BASE_SQL
from canvass.queries.profiles import CONDITIONAL_SQL, GROUP_SQL, OPTION_METRIC_SQL, PROFILE_SQL
from canvass.queries.registry import query

c = F.col


def source_counts(spark, sf_dir):
    return field.survey(spark, sf_dir).groupBy("form_id").agg(F.count(F.lit(1)).alias("source_count"))


def drafts(spark, sf_dir):
    """draft_id, form_id, n_orders, bal (whole balance), segment, source_count, final_count."""
    n_orders = field.table(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders")
    )
    base = field.table(spark, sf_dir, "customer").join(n_orders, "c_custkey", "left").select(
        c("c_custkey").alias("draft_id"),
        F.concat(F.lit("form:"), c("c_nationkey")).alias("form_id"),
        F.coalesce("n_orders", F.lit(0)).alias("n_orders"),
        F.floor("c_acctbal").cast("int").alias("bal"),
        c("c_mktsegment").alias("segment"),
    )
    return base.join(source_counts(spark, sf_dir), "form_id", "left").withColumn(
        "source_count", F.coalesce("source_count", F.lit(0))
    ).withColumn(
        "final_count", F.when(c("segment") != "AUTOMOBILE", c("source_count") + c("n_orders"))
    )


DRAFTS_SQL = """, drafts AS (SELECT c.c_custkey AS draft_id, 'form:' || c.c_nationkey AS form_id, coalesce(n.n, 0) AS n_orders,
   CAST(floor(c.c_acctbal) AS INTEGER) AS bal, c.c_mktsegment AS segment, coalesce(f.n, 0) AS source_count,
   CASE WHEN c.c_mktsegment <> 'AUTOMOBILE' THEN coalesce(f.n, 0) + coalesce(n.n, 0) END AS final_count
  FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) n ON n.o_custkey = c.c_custkey
  LEFT JOIN (SELECT form_id, count(*) AS n FROM survey GROUP BY 1) f ON f.form_id = 'form:' || c.c_nationkey)"""

_INTENT = {"MACHINERY": "percentage_point_delta", "AUTOMOBILE": "relative_percent_delta", "HOUSEHOLD": "count_delta"}


def _intent():
    expr = F.lit("absolute")
    for segment, intent in _INTENT.items():
        expr = F.when(c("segment") == segment, intent).otherwise(expr)
    return expr


INTENT_SQL = "CASE segment " + " ".join(f"WHEN '{s}' THEN '{i}'" for s, i in _INTENT.items()) + " ELSE 'absolute' END"


def targets(spark, sf_dir):
    share = c("bal") / F.lit(10000.0)

    def target(position, tid, kind, subject=None, q=None, option=None, group=None, intent=None, value=None):
        text = lambda x: (x if x is not None and not isinstance(x, str) else F.lit(x)).cast("string")
        return F.struct(
            F.lit(position).alias("position"), text(tid).alias("target_id"), F.lit(kind).alias("kind"),
            text(subject).alias("subject_kind"), text(q).alias("question_id"), text(option).alias("option_key"),
            text(group).alias("group_id"), (F.lit("absolute") if intent is None else intent).alias("intent"),
            value.cast("double").alias("value"),
        )

    rows = [
        target(0, "t0", "mean", q="q_score", value=F.lit(1.0) + c("bal") / F.lit(2500.0)),
        target(1, "t1", "share", "option", "q_status", "F", intent=_intent(), value=share),
        target(2, "t2", "count", "option", "q_status", "O",
               intent=F.when(c("segment") == "MACHINERY", "percentage_point_delta")
               .when(c("segment") == "BUILDING", "absolute").otherwise("count_delta"),
               value=F.when(c("segment") == "BUILDING", c("bal") / F.lit(2.0)).otherwise(F.floor(c("bal") / F.lit(100.0)))),
        target(3, "t3", "conditional_share", q="q_flags", option="A", group="g_heavy", intent=_intent(), value=share),
        target(4, "t4", "share", "option", "q_status",
               option=F.when(c("bal") < 500, "Q").otherwise("P"), value=F.lit(0.5)),
        target(5, F.when(c("segment") == "BUILDING", "t0").otherwise("t5"), "mean",
               q=F.when(c("segment") == "HOUSEHOLD", "q_segment").otherwise("q_score"), value=F.lit(4.0)),
        target(6, "t6", "share", "value_group", group="g_home", value=F.lit(0.4)),
        target(7, F.when(c("bal") > 5000, "t7").otherwise("t6"), "share", "value_group", group="g_home", value=F.lit(0.6)),
        target(8, "t8", "conditional_share", q="q_flags", option="N", group="g_heavy", value=F.lit(1.0) - share),
        target(9, "t9", "count", "option", "q_status", "P", value=F.greatest(c("bal"), F.lit(0))),
    ]
    return drafts(spark, sf_dir).select("draft_id", "form_id", "final_count", F.inline(F.array(*rows)))


def _tsql(position, tid, kind, subject="NULL", q="NULL", option="NULL", group="NULL", intent="'absolute'", value="0"):
    return f"""SELECT draft_id, form_id, final_count, {position} AS position, {tid} AS target_id, '{kind}' AS kind,
   CAST({subject} AS VARCHAR) AS subject_kind, CAST({q} AS VARCHAR) AS question_id, CAST({option} AS VARCHAR) AS option_key,
   CAST({group} AS VARCHAR) AS group_id, {intent} AS intent, CAST({value} AS DOUBLE) AS value FROM drafts"""


TARGETS_SQL = DRAFTS_SQL + ", targets AS (" + "\n UNION ALL ".join([
    _tsql(0, "'t0'", "mean", q="'q_score'", value="CAST(1.0 AS DOUBLE) + bal / CAST(2500.0 AS DOUBLE)"),
    _tsql(1, "'t1'", "share", "'option'", "'q_status'", "'F'", intent=INTENT_SQL, value="bal / CAST(10000.0 AS DOUBLE)"),
    _tsql(2, "'t2'", "count", "'option'", "'q_status'", "'O'",
          intent="CASE segment WHEN 'MACHINERY' THEN 'percentage_point_delta' WHEN 'BUILDING' THEN 'absolute' ELSE 'count_delta' END",
          value="CASE WHEN segment = 'BUILDING' THEN bal / CAST(2.0 AS DOUBLE) ELSE floor(bal / CAST(100.0 AS DOUBLE)) END"),
    _tsql(3, "'t3'", "conditional_share", q="'q_flags'", option="'A'", group="'g_heavy'", intent=INTENT_SQL, value="bal / CAST(10000.0 AS DOUBLE)"),
    _tsql(4, "'t4'", "share", "'option'", "'q_status'", "CASE WHEN bal < 500 THEN 'Q' ELSE 'P' END", value="0.5"),
    _tsql(5, "CASE WHEN segment = 'BUILDING' THEN 't0' ELSE 't5' END", "mean",
          q="CASE WHEN segment = 'HOUSEHOLD' THEN 'q_segment' ELSE 'q_score' END", value="4.0"),
    _tsql(6, "'t6'", "share", "'value_group'", group="'g_home'", value="0.4"),
    _tsql(7, "CASE WHEN bal > 5000 THEN 't7' ELSE 't6' END", "share", "'value_group'", group="'g_home'", value="0.6"),
    _tsql(8, "'t8'", "conditional_share", q="'q_flags'", option="'N'", group="'g_heavy'", value="CAST(1.0 AS DOUBLE) - bal / CAST(10000.0 AS DOUBLE)"),
    _tsql(9, "'t9'", "count", "'option'", "'q_status'", "'P'", value="greatest(bal, 0)"),
]) + ")"
KEY_SQL = """CASE WHEN kind = 'mean' THEN 'mean:' || question_id
   WHEN kind = 'conditional_share' THEN 'conditional_share:' || group_id || ':' || question_id || ':' || option_key
   WHEN subject_kind = 'value_group' THEN 'value_group:' || group_id
   ELSE subject_kind || ':' || question_id || ':' || option_key END"""
SEMANTIC_SQL = f"CASE WHEN kind IN ('mean', 'conditional_share') THEN {KEY_SQL} ELSE kind || ':' || ({KEY_SQL}) END"
METRICS_SQL = f""", profile AS ({PROFILE_SQL}),
 metrics AS (SELECT p.form_id, p.metric, CASE
    WHEN p.metric = 'option' THEN CASE WHEN p.question_id = 'q_flags' THEN 'checkbox_option' ELSE 'option' END || ':' || p.question_id || ':' || p.item
    WHEN p.metric = 'value_group' THEN 'value_group:' || p.group_id
    WHEN p.metric = 'conditional_share' THEN 'conditional_share:' || p.group_id || ':' || p.question_id || ':' || p.item
    ELSE 'mean:' || p.question_id END AS subject_key, p.count, p.denominator_count, p.value AS metric_value
   FROM profile p WHERE p.metric <> 'distribution')"""
TB = BASE_SQL.rstrip() + TARGETS_SQL
TM = TB + METRICS_SQL


def metrics(spark, sf_dir):
    profile = P.profile(
        field.responses(spark, sf_dir), field.questions(spark, sf_dir), field.options(spark, sf_dir),
        field.members(spark, sf_dir), field.score_map(spark, sf_dir),
    )
    return T.subject_metrics(profile, field.questions(spark, sf_dir))


@query("scl21", TB + f" SELECT draft_id, position, {SEMANTIC_SQL} AS semantic_key FROM targets")
def semantic_keys(spark, sf_dir):
    return targets(spark, sf_dir).select("draft_id", "position", T.semantic_key().alias("semantic_key"))


@query("agg24", TB + f""" SELECT draft_id, semantic_key, string_agg(DISTINCT target_id, ',' ORDER BY target_id) AS target_ids
  FROM (SELECT draft_id, target_id, {SEMANTIC_SQL} AS semantic_key FROM targets) GROUP BY 1, 2 HAVING count(DISTINCT target_id) > 1""")
def semantic_duplicates(spark, sf_dir):
    return T.semantic_duplicates(targets(spark, sf_dir))


@query("agg25", TB + " SELECT draft_id, target_id, count(*) AS n FROM targets GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_target_ids(spark, sf_dir):
    return T.repeated_ids(targets(spark, sf_dir))


CONFLICT_SQL = """SELECT draft_id, question_id, kind, sum(value) AS total, string_agg(target_id, ',' ORDER BY target_id) AS target_ids
  FROM targets WHERE kind IN ('count', 'share') AND subject_kind = 'option' AND intent = 'absolute' GROUP BY 1, 2, 3
  HAVING CASE WHEN kind = 'share' THEN sum(value) > 1 + 1e-9 ELSE max(final_count) > 0 AND sum(value) > max(final_count) END"""


@query("agg23", TB + f" SELECT draft_id, question_id, kind, round(total, 6) AS total, target_ids FROM ({CONFLICT_SQL})")
def question_conflicts(spark, sf_dir):
    return T.question_conflicts(targets(spark, sf_dir)).withColumn("total", F.round("total", 6))


RESOLVED_SQL = f""", res AS (SELECT t.*, m.count, m.denominator_count, m.metric_value, {KEY_SQL.replace('kind', 't.kind').replace('subject_t.kind', 't.subject_kind').replace('question_id', 't.question_id').replace('group_id', 't.group_id').replace('option_key', 't.option_key')} AS skey,
   CASE intent WHEN 'absolute' THEN t.value WHEN 'count_delta' THEN m.count + t.value
     WHEN 'percentage_point_delta' THEN m.metric_value + t.value ELSE m.metric_value * (1.0 + t.value) END AS raw
  FROM targets t LEFT JOIN metrics m ON m.form_id = t.form_id AND m.subject_key = {KEY_SQL.replace('kind', 't.kind').replace('subject_t.kind', 't.subject_kind').replace('question_id', 't.question_id').replace('group_id', 't.group_id').replace('option_key', 't.option_key')}),
 resolved AS (SELECT *, CASE WHEN kind = 'mean' AND intent <> 'absolute' THEN 'domain_unsupported'
    WHEN kind <> 'mean' AND denominator_count IS NULL THEN 'invalid_subject'
    WHEN kind = 'count' AND intent IN ('percentage_point_delta', 'relative_percent_delta') THEN 'domain_unsupported'
    WHEN kind NOT IN ('mean', 'count') AND intent = 'count_delta' THEN 'domain_unsupported'
    WHEN kind = 'count' AND (raw <> floor(raw) OR raw < 0) THEN 'out_of_range'
    WHEN kind NOT IN ('mean', 'count') AND NOT raw BETWEEN 0 AND 1 THEN 'out_of_range' END AS issue FROM res)"""


@query("scl19", TM + RESOLVED_SQL + """ SELECT draft_id, position, issue,
   round(CASE WHEN issue IS NULL THEN raw END, 9) AS resolved FROM resolved""")
def intent_arithmetic(spark, sf_dir):
    return T.resolve_intents(targets(spark, sf_dir), metrics(spark, sf_dir)).select(
        "draft_id", "position", "issue", F.round("resolved", 9).alias("resolved")
    )


@query("join16", TM + RESOLVED_SQL + """ SELECT draft_id, target_id, position, count AS baseline_count,
   denominator_count AS baseline_denominator, metric_value AS baseline_value, round(raw, 9) AS absolute_value
  FROM resolved WHERE intent <> 'absolute' AND issue IS NULL""")
def intent_baselines(spark, sf_dir):
    return T.resolve_intents(targets(spark, sf_dir), metrics(spark, sf_dir)).where(
        (c("intent") != "absolute") & c("issue").isNull()
    ).select(
        "draft_id", "target_id", "position", c("count").alias("baseline_count"),
        c("denominator_count").alias("baseline_denominator"), c("metric_value").alias("baseline_value"),
        F.round("resolved", 9).alias("absolute_value"),
    )


ISSUES_SQL = f""", known AS (SELECT DISTINCT form_id, subject_key FROM metrics),
 chk AS (SELECT t.*, k.subject_key IS NOT NULL AS known, b.min, b.max FROM (SELECT *, {KEY_SQL} AS skey FROM targets) t
   LEFT JOIN known k ON k.form_id = t.form_id AND k.subject_key = t.skey
   LEFT JOIN (SELECT form_id, question_id, min, max FROM questions WHERE kind = 'ordinal') b
     ON b.form_id = t.form_id AND b.question_id = t.question_id),
 issues AS (SELECT draft_id, target_id AS target_ids, 'invalid_subject' AS code FROM chk WHERE kind <> 'mean' AND NOT known
   UNION ALL SELECT draft_id, target_id, code FROM (SELECT draft_id, target_id, CASE
      WHEN kind = 'mean' THEN CASE WHEN min IS NULL THEN 'invalid_subject' WHEN intent <> 'absolute' THEN 'domain_unsupported'
                                   WHEN NOT value BETWEEN min AND max THEN 'out_of_range' END
      WHEN kind = 'count' THEN CASE WHEN intent NOT IN ('absolute', 'count_delta') THEN 'domain_unsupported'
                                    WHEN intent = 'absolute' AND (value <> floor(value) OR value < 0) THEN 'out_of_range' END
      WHEN intent = 'count_delta' THEN 'domain_unsupported'
      WHEN intent = 'absolute' AND NOT value BETWEEN 0 AND 1 THEN 'out_of_range' END AS code FROM chk) WHERE code IS NOT NULL
   UNION ALL SELECT draft_id, target_id, 'target_conflict' FROM (
     SELECT draft_id, target_id, row_number() OVER (PARTITION BY draft_id, target_id ORDER BY position) AS k FROM targets) WHERE k > 1
   UNION ALL SELECT draft_id, target_ids, 'target_conflict' FROM ({CONFLICT_SQL}))"""


@query("tgt07", TM + ISSUES_SQL + " SELECT draft_id, target_ids, code FROM issues")
def draft_issues(spark, sf_dir):
    return T.validate(targets(spark, sf_dir), metrics(spark, sf_dir), field.questions(spark, sf_dir))


PREVIEW_SQL = """, base AS (SELECT d.draft_id, m.subject_key, CASE WHEN m.metric = 'conditional_share' THEN 'conditional_share' ELSE 'share' END AS kind,
    m.count, m.metric_value, CASE WHEN d.source_count > 0 AND m.metric <> 'conditional_share' THEN floor(d.final_count * m.denominator_count / d.source_count + 0.5) END AS den
   FROM drafts d JOIN metrics m ON m.form_id = d.form_id WHERE m.metric <> 'mean' AND d.source_count > 0),
 tr AS (SELECT r.*, CASE WHEN d.source_count > 0 AND r.kind <> 'conditional_share' THEN floor(r.final_count * r.denominator_count / d.source_count + 0.5) END AS den
   FROM resolved r JOIN drafts d ON d.draft_id = r.draft_id),
 rows AS (SELECT draft_id, subject_key, -1 AS position, CAST(NULL AS VARCHAR) AS target_id, kind, count AS current_count, metric_value AS current_value,
    CAST(floor(den * metric_value + 0.5) AS BIGINT) AS projected_count, CASE WHEN den IS NOT NULL THEN metric_value END AS projected_value, 'projected' AS status FROM base
   UNION ALL SELECT draft_id, skey, position, target_id, kind, CASE WHEN issue IS NULL AND kind <> 'mean' THEN count END,
    CASE WHEN issue IS NULL THEN metric_value END, pc, CASE WHEN issue IS NOT NULL THEN NULL WHEN kind = 'mean' THEN raw
      WHEN final_count IS NULL OR kind = 'conditional_share' THEN NULL
      WHEN kind = 'count' THEN CASE WHEN raw <= den THEN raw / nullif(den, 0) END ELSE raw END,
    CASE WHEN issue IS NOT NULL THEN 'invalid' WHEN pc < count THEN 'needs_replacement' ELSE 'projected' END
   FROM (SELECT *, CAST(CASE WHEN kind = 'mean' OR issue IS NOT NULL THEN NULL WHEN kind = 'count' THEN raw
                        ELSE floor(den * raw + 0.5) END AS BIGINT) AS pc FROM tr))
 SELECT draft_id, subject_key, target_id, kind, current_count, round(current_value, 9) AS current_value, projected_count,
   round(projected_value, 9) AS projected_value, status, projected_count - current_count AS delta_count
 FROM (SELECT *, row_number() OVER (PARTITION BY draft_id, subject_key ORDER BY position DESC) AS k FROM rows) WHERE k = 1"""


@query("tgt08", TM + RESOLVED_SQL + PREVIEW_SQL)
def preview(spark, sf_dir):
    d = drafts(spark, sf_dir)
    return T.preview(
        targets(spark, sf_dir), d.select("draft_id", "form_id", "final_count"), metrics(spark, sf_dir),
        source_counts(spark, sf_dir),
    ).withColumn("current_value", F.round("current_value", 9)).withColumn(
        "projected_value", F.round("projected_value", 9)
    )


@query("val01", TM + ISSUES_SQL + f""", stale AS (SELECT form_id, group_id FROM members m WHERE m.question_id = 'q_status'
   AND m.member NOT IN ('F', 'O') UNION SELECT form_id, group_id FROM members WHERE FALSE)
 SELECT DISTINCT 'invalid_group' AS finding, form_id, CAST(NULL AS VARCHAR) AS draft_id, group_id AS ref, CAST(NULL AS VARCHAR) AS code FROM stale
 UNION ALL SELECT 'duplicate_target', d.form_id, CAST(x.draft_id AS VARCHAR), x.target_ids, 'target_conflict' FROM (
   SELECT draft_id, semantic_key, string_agg(DISTINCT target_id, ',' ORDER BY target_id) AS target_ids
   FROM (SELECT draft_id, target_id, {SEMANTIC_SQL} AS semantic_key FROM targets) GROUP BY 1, 2 HAVING count(DISTINCT target_id) > 1) x
   JOIN drafts d USING (draft_id)
 UNION ALL SELECT 'target_issue', d.form_id, CAST(i.draft_id AS VARCHAR), i.target_ids, i.code FROM issues i JOIN drafts d USING (draft_id)""")
def source_review(spark, sf_dir):
    """The refreshed form lost option P, so the group that lists it is no longer valid."""
    refreshed = field.options(spark, sf_dir).where(
        (c("question_id") != "q_status") | c("option_key").isin("F", "O")
    )
    return T.review_source(
        targets(spark, sf_dir), metrics(spark, sf_dir), field.questions(spark, sf_dir), refreshed,
        field.members(spark, sf_dir),
    )


# Support plans: absolute values taken from the drafts, source totals from the profile.
def _mean_inputs(spark, sf_dir):
    score = field.survey(spark, sf_dir).groupBy("form_id").agg(
        F.count("q_score").alias("answered_count"), F.sum("q_score").alias("score_sum")
    )
    return drafts(spark, sf_dir).withColumn("final_count", c("source_count") + c("n_orders") - F.when(c("bal") < -900, 30).otherwise(0)).join(
        score, "form_id"
    ).select(
        "draft_id", "source_count", "answered_count", "score_sum", "final_count",
        (F.lit(1.0) + c("bal") / F.lit(2500.0)).alias("value"), F.lit(1).alias("minimum"), F.lit(5).alias("maximum"),
    )


MEAN_PLAN_SQL = """, m AS (SELECT d.draft_id, d.source_count, s.answered_count, s.score_sum, d.source_count + d.n_orders - CASE WHEN bal < -900 THEN 30 ELSE 0 END AS final_count,
    CAST(1.0 AS DOUBLE) + bal / CAST(2500.0 AS DOUBLE) AS value FROM drafts d JOIN (SELECT form_id, count(q_score) AS answered_count, sum(q_score) AS score_sum FROM survey GROUP BY 1) s USING (form_id)),
 m2 AS (SELECT *, final_count - source_count AS additions, CASE WHEN source_count = 0 THEN 'empty_source_scope' WHEN final_count < source_count THEN 'final_count_below_source'
    WHEN NOT value BETWEEN 1 AND 5 THEN 'mean_out_of_range' WHEN answered_count = 0 AND final_count = source_count THEN 'mean_zero_denominator' END AS issue FROM m),
 m3 AS (SELECT *, CASE WHEN issue IS NULL THEN CAST(least(greatest(floor(value * (answered_count + additions) - score_sum + 0.5), additions), additions * 5) AS BIGINT) END AS synthetic_sum FROM m2),
 m4 AS (SELECT *, CASE WHEN issue IS NULL AND additions > 0 THEN synthetic_sum // additions END AS low_score,
    CASE WHEN issue IS NULL THEN (score_sum + synthetic_sum) / (answered_count + additions) END AS achieved FROM m3)
 SELECT draft_id, issue, additions, synthetic_sum, low_score, CASE WHEN low_score IS NOT NULL THEN synthetic_sum - low_score * additions END AS high_count,
   CASE WHEN low_score IS NOT NULL THEN additions - (synthetic_sum - low_score * additions) END AS low_count,
   round(achieved, 9) AS achieved, round(abs(achieved - value), 9) AS absolute_error FROM m4"""


@query("tgt01", TB + MEAN_PLAN_SQL)
def mean_plans(spark, sf_dir):
    return S.mean_support(_mean_inputs(spark, sf_dir)).select(
        "draft_id", "issue", "additions", "synthetic_sum", "low_score", "high_count", "low_count",
        F.round("achieved", 9).alias("achieved"), F.round("absolute_error", 9).alias("absolute_error"),
    )


def _option_totals(spark, sf_dir, option):
    facts = P.question_rows(explode_slots(field.responses(spark, sf_dir)))
    return P.option_metrics(
        facts, field.options(spark, sf_dir).where((c("question_id") == "q_status") & (c("option_key") == option))
    ).select("form_id", c("denominator_count").alias("source_denominator"), c("count").alias("source_numerator"))


@query("tgt02", TB + f""", m AS (SELECT d.draft_id, d.source_count, o.denominator_count AS den, o.count AS num, d.n_orders AS additions, d.bal / CAST(10000.0 AS DOUBLE) AS value
   FROM drafts d JOIN ({OPTION_METRIC_SQL} WHERE o.question_id = 'q_status' AND o.option_key = 'F') o USING (form_id)),
 m2 AS (SELECT *, CASE WHEN source_count = 0 THEN 'empty_source_scope' WHEN NOT value BETWEEN 0 AND 1 THEN 'share_out_of_range' WHEN den + additions <= 0 THEN 'share_zero_denominator' END AS issue FROM m),
 m3 AS (SELECT *, CASE WHEN issue IS NULL THEN CAST(least(greatest(floor(value * (den + additions) + 0.5), num), num + additions) AS BIGINT) END AS final_members FROM m2)
 SELECT draft_id, issue, final_members, final_members - num AS synthetic_members, round(final_members / (den + additions), 9) AS achieved,
   round(abs(final_members / (den + additions) - value), 9) AS absolute_error FROM m3""")
def share_plans(spark, sf_dir):
    rows = drafts(spark, sf_dir).join(_option_totals(spark, sf_dir, "F"), "form_id").select(
        "draft_id", "source_count", "source_denominator", "source_numerator",
        (c("source_count") + c("n_orders")).alias("final_count"), (c("bal") / F.lit(10000.0)).alias("value"),
        F.lit(True).alias("has_members"),
    )
    return S.share_support(rows).select(
        "draft_id", "issue", "final_members", "synthetic_members",
        F.round("achieved", 9).alias("achieved"), F.round("absolute_error", 9).alias("absolute_error"),
    )


@query("tgt06", TB + f""" SELECT d.draft_id, CAST(least(greatest(greatest(d.bal, 0) - o.count, 0), d.n_orders) AS BIGINT) AS needed_members,
   CAST(d.n_orders - least(greatest(greatest(d.bal, 0) - o.count, 0), d.n_orders) AS BIGINT) AS needed_nonmembers
  FROM drafts d JOIN ({OPTION_METRIC_SQL} WHERE o.question_id = 'q_status' AND o.option_key = 'O') o USING (form_id)""")
def count_plans(spark, sf_dir):
    rows = drafts(spark, sf_dir).join(_option_totals(spark, sf_dir, "O"), "form_id").select(
        "draft_id", "source_count", c("source_numerator").alias("source_members"),
        (c("source_count") + c("n_orders")).alias("final_count"), F.greatest(c("bal"), F.lit(0)).alias("value"),
    )
    return S.count_support(rows).select("draft_id", "needed_members", "needed_nonmembers")


def _conditional_inputs(spark, sf_dir):
    metric = P.conditional_metrics(
        P.group_cells(field.responses(spark, sf_dir), field.members(spark, sf_dir)), field.members(spark, sf_dir),
        field.options(spark, sf_dir).where(c("question_id") == "q_flags"),
    ).where(c("group_id") == "g_heavy").select(
        "form_id", c("option_key").alias("target_id"), c("denominator_count").alias("source_population"),
        c("count").alias("source_numerator"),
    )
    share = F.least(F.greatest(c("bal"), F.lit(0)), F.lit(10000)) / F.lit(10000.0)
    value = F.when(c("target_id") == "A", share).when(c("target_id") == "N", F.lit(0.55)).otherwise(F.lit(0.1))
    return drafts(spark, sf_dir).join(metric, "form_id").select(
        "draft_id", "target_id", "source_population", "source_numerator", value.alias("value"),
        c("n_orders").alias("available"),
    )


NEAREST_SQL = """(SELECT min({{'err': abs(n / CAST({d} AS DOUBLE) - {v}), 'num': CAST(n AS BIGINT)}}) FROM (SELECT unnest([
   CAST({num} AS DOUBLE), {num} + {d} - {pop}, least(greatest(floor({v} * {d}), {num}), {num} + {d} - {pop}),
   least(greatest(ceil({v} * {d}), {num}), {num} + {d} - {pop})]) AS n))"""
COND_SQL = f""", ci AS (SELECT d.draft_id, x.option_key AS target_id, x.denominator_count AS pop, x.count AS num, d.n_orders AS available,
   CASE x.option_key WHEN 'A' THEN least(greatest(d.bal, 0), 10000) / CAST(10000.0 AS DOUBLE) WHEN 'N' THEN CAST(0.55 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS value
  FROM drafts d JOIN ({CONDITIONAL_SQL}) x ON x.form_id = d.form_id AND x.group_id = 'g_heavy'),
 sc AS (SELECT ci.*, u.d, least(abs(num / CAST(d AS DOUBLE) - value), abs((num + d - pop) / CAST(d AS DOUBLE) - value),
     abs(least(greatest(floor(value * d), num), num + d - pop) / d - value), abs(least(greatest(ceil(value * d), num), num + d - pop) / d - value)) AS err
   FROM ci, LATERAL (SELECT unnest(range(greatest(1, pop), pop + available + 1)) AS d) u),
 tot AS (SELECT draft_id, d, sum(err ORDER BY target_id) AS total_error FROM sc GROUP BY 1, 2),
 best AS (SELECT draft_id, d AS denominator, total_error FROM (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY round(total_error, 12), d DESC) AS k FROM tot) WHERE k = 1)"""


@query("tgt04", TB + COND_SQL + """ SELECT ci.draft_id, ci.target_id, b.denominator, round(s.err, 9) AS absolute_error, round(b.total_error, 9) AS total_error,
   CASE WHEN b.draft_id IS NULL THEN 'conditional_population_empty' END AS issue
  FROM ci LEFT JOIN best b ON b.draft_id = ci.draft_id LEFT JOIN sc s ON s.draft_id = ci.draft_id AND s.target_id = ci.target_id AND s.d = b.denominator""")
def conditional_plans(spark, sf_dir):
    return S.conditional_support(_conditional_inputs(spark, sf_dir), ["draft_id"]).select(
        "draft_id", "target_id", "denominator", F.round("absolute_error", 9).alias("absolute_error"),
        F.round("total_error", 9).alias("total_error"), "issue",
    )


@query("tgt03", TB + COND_SQL + """, opts AS (SELECT draft_id, target_id, d, value, unnest([num, num + d - pop,
     CAST(least(greatest(floor(value * d), num), num + d - pop) AS BIGINT), CAST(least(greatest(ceil(value * d), num), num + d - pop) AS BIGINT)]) AS n
   FROM (SELECT *, pop + available AS d FROM ci WHERE pop + available > 0))
 SELECT draft_id, target_id, n AS numerator, round(abs(n / CAST(d AS DOUBLE) - value), 9) AS absolute_error FROM (
   SELECT *, row_number() OVER (PARTITION BY draft_id, target_id ORDER BY abs(n / CAST(d AS DOUBLE) - value), n) AS k FROM opts) WHERE k = 1""")
def nearest_numerators(spark, sf_dir):
    """Feasible numerator at the largest denominator each draft allows."""
    rows = _conditional_inputs(spark, sf_dir).withColumn("d", c("source_population") + c("available")).where(c("d") > 0)
    best = S.nearest_numerator(c("d"), c("source_population"), c("source_numerator"), c("value"))
    return rows.withColumn("best", best).select(
        "draft_id", "target_id", c("best.num").alias("numerator"), F.round("best.err", 9).alias("absolute_error")
    )


@query("tgt10", TB + """, m AS (SELECT group_id, count(DISTINCT member) AS n FROM members GROUP BY 1),
 x AS (SELECT t.*, CASE WHEN t.kind = 'conditional_share' OR t.subject_kind = 'value_group' THEN coalesce(m.n, 0)
     WHEN t.subject_kind = 'option' THEN CASE WHEN t.option_key IN ('F', 'O', 'P', 'X') THEN 1 ELSE 0 END END AS members
   FROM targets t LEFT JOIN m ON m.group_id = t.group_id)
 SELECT draft_id, target_id, code FROM (SELECT draft_id, target_id, CASE
    WHEN kind = 'count' AND NOT value BETWEEN 0 AND final_count THEN 'count_out_of_range' WHEN kind = 'count' AND members = 0 THEN 'count_member_support'
    WHEN kind = 'share' AND NOT value BETWEEN 0 AND 1 THEN 'share_out_of_range' WHEN kind = 'share' AND members = 0 THEN 'share_member_support'
    WHEN kind = 'conditional_share' AND NOT value BETWEEN 0 AND 1 THEN 'conditional_share_out_of_range' END AS code FROM x) WHERE code IS NOT NULL
 UNION ALL SELECT draft_id, target_id, CASE WHEN kind = 'conditional_share' THEN 'duplicate_conditional_share_target' ELSE 'duplicate_categorical_target' END
  FROM (SELECT draft_id, target_id, CASE WHEN kind = 'count' THEN 'share' ELSE kind END AS kind, count(*) AS n FROM targets WHERE kind <> 'mean' GROUP BY 1, 2, 3) WHERE n > 1""")
def solver_checks(spark, sf_dir):
    size = field.members(spark, sf_dir).groupBy("form_id", "group_id").agg(F.count_distinct("member").alias("n"))
    known = field.options(spark, sf_dir).select("form_id", "question_id", "option_key", F.lit(1).alias("one"))
    rows = targets(spark, sf_dir).join(size, ["form_id", "group_id"], "left").join(
        known, ["form_id", "question_id", "option_key"], "left"
    )
    by_group = (c("kind") == "conditional_share") | (c("subject_kind") == "value_group")
    return S.static_issues(
        rows.withColumn(
            "members",
            F.when(by_group, F.coalesce("n", F.lit(0))).when(c("subject_kind") == "option", F.coalesce("one", F.lit(0))),
        ).withColumn("options", F.when(c("kind") == "conditional_share", F.coalesce("one", F.lit(0))))
    )
