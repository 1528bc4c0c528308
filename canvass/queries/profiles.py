"""Profile metrics of every form (aggregations 01-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.functions.slots import explode_slots
from canvass.operators import profile as P
from canvass.operators.scope import in_scope, timestamp_range
from canvass.queries import field
from canvass.queries.field import BASE_SQL
from canvass.queries.registry import query

OPTION_METRIC_SQL = """SELECT o.form_id, o.question_id, o.option_key, coalesce(p.n, 0) AS count,
  coalesce(e.denominator_count, 0) AS denominator_count,
  CASE WHEN e.denominator_count > 0 THEN coalesce(p.n, 0) / e.denominator_count ELSE 0.0 END AS share
 FROM options o LEFT JOIN picks p USING (form_id, question_id, option_key)
 LEFT JOIN elig e ON e.form_id = o.form_id AND e.question_id = o.question_id"""
BOUNDS_SQL = """(SELECT form_id, question_id, min, max FROM questions WHERE kind = 'ordinal'
   UNION ALL SELECT DISTINCT form_id, 'q_priority', 1, 5 FROM forms)"""
MEAN_SQL = f"""SELECT b.form_id, b.question_id, coalesce(s.n, 0) AS denominator_count,
  coalesce(s.mean, 0.0) AS mean FROM {BOUNDS_SQL} b
 LEFT JOIN (SELECT form_id, question_id, count(*) AS n, avg(score) AS mean FROM scores GROUP BY 1, 2) s
   USING (form_id, question_id)"""
DISTRIBUTION_SQL = f"""SELECT b.form_id, b.question_id, CAST(b.value AS BIGINT) AS value, coalesce(c.n, 0) AS count,
  coalesce(t.n, 0) AS denominator_count, CASE WHEN t.n > 0 THEN coalesce(c.n, 0) / t.n ELSE 0.0 END AS share
 FROM (SELECT form_id, question_id, unnest(range(min, max + 1)) AS value FROM {BOUNDS_SQL}) b
 LEFT JOIN (SELECT form_id, question_id, score AS value, count(*) AS n FROM scores GROUP BY 1, 2, 3) c
   ON c.form_id = b.form_id AND c.question_id = b.question_id AND c.value = b.value
 LEFT JOIN (SELECT form_id, question_id, count(*) AS n FROM scores GROUP BY 1, 2) t
   ON t.form_id = b.form_id AND t.question_id = b.question_id"""
GROUP_SQL = """SELECT g.form_id, g.group_id, g.question_id, coalesce(h.n, 0) AS count,
  coalesce(e.denominator_count, 0) AS denominator_count,
  CASE WHEN e.denominator_count > 0 THEN coalesce(h.n, 0) / e.denominator_count ELSE 0.0 END AS share
 FROM (SELECT DISTINCT form_id, group_id, question_id FROM members) g
 LEFT JOIN (SELECT form_id, group_id, count(*) AS n FROM hits GROUP BY 1, 2) h
   ON h.form_id = g.form_id AND h.group_id = g.group_id
 LEFT JOIN elig e ON e.form_id = g.form_id AND e.question_id = g.question_id"""
CONDITIONAL_SQL = """SELECT x.form_id, x.group_id, x.question_id, x.option_key, coalesce(c.n, 0) AS count,
  coalesce(d.n, 0) AS denominator_count,
  CASE WHEN d.n > 0 THEN coalesce(c.n, 0) / d.n ELSE 0.0 END AS share
 FROM (SELECT DISTINCT m.form_id, m.group_id, o.question_id, o.option_key FROM members m
       JOIN options o ON o.form_id = m.form_id AND o.question_id = 'q_flags') x
 LEFT JOIN (SELECT h.form_id, h.group_id, count(*) AS n FROM hits h JOIN slots s
            ON s.form_id = h.form_id AND s.response_id = h.response_id AND s.question_id = 'q_flags'
            WHERE s.state IN ('answered', 'skipped') GROUP BY 1, 2) d
   ON d.form_id = x.form_id AND d.group_id = x.group_id
 LEFT JOIN (SELECT form_id, group_id, option_key, count(*) AS n FROM (
              SELECT h.form_id, h.group_id, unnest(s.option_keys) AS option_key FROM hits h JOIN slots s
              ON s.form_id = h.form_id AND s.response_id = h.response_id AND s.question_id = 'q_flags'
              WHERE s.state = 'answered') GROUP BY 1, 2, 3) c
   ON c.form_id = x.form_id AND c.group_id = x.group_id AND c.option_key = x.option_key"""
PROFILE_SQL = f"""SELECT form_id, 'option' AS metric, CAST(NULL AS VARCHAR) AS group_id, question_id, option_key AS item,
   count, denominator_count, share AS value FROM ({OPTION_METRIC_SQL})
 UNION ALL SELECT form_id, 'mean', NULL, question_id, NULL, NULL, denominator_count, mean FROM ({MEAN_SQL})
 UNION ALL SELECT form_id, 'distribution', NULL, question_id, CAST(value AS VARCHAR), count, denominator_count, share FROM ({DISTRIBUTION_SQL})
 UNION ALL SELECT form_id, 'value_group', group_id, question_id, NULL, count, denominator_count, share FROM ({GROUP_SQL})
 UNION ALL SELECT form_id, 'conditional_share', group_id, question_id, option_key, count, denominator_count, share FROM ({CONDITIONAL_SQL})"""


def _facts(spark, sf_dir, scored=False):
    slots = explode_slots(field.responses(spark, sf_dir))
    return P.question_rows(slots, field.score_map(spark, sf_dir) if scored else None)


def _options(spark, sf_dir, kind):
    return field.options(spark, sf_dir).join(
        field.questions(spark, sf_dir).where(F.col("kind") == kind).select("form_id", "question_id"),
        ["form_id", "question_id"],
    )


@query("agg01", BASE_SQL + OPTION_METRIC_SQL + " WHERE o.question_id IN ('q_status', 'q_priority')")
def single_choice_shares(spark, sf_dir):
    return P.option_metrics(_facts(spark, sf_dir), _options(spark, sf_dir, "single_choice"))


@query("agg02", BASE_SQL + OPTION_METRIC_SQL + " WHERE o.question_id = 'q_flags'")
def checkbox_shares(spark, sf_dir):
    return P.option_metrics(_facts(spark, sf_dir), _options(spark, sf_dir, "multi_choice"))


@query("agg03", BASE_SQL + GROUP_SQL)
def value_group_shares(spark, sf_dir):
    m = field.members(spark, sf_dir)
    return P.group_metrics(P.group_cells(field.responses(spark, sf_dir), m), _facts(spark, sf_dir), m)


def _bounds(spark, sf_dir):
    ordinal = field.questions(spark, sf_dir).where(F.col("kind") == "ordinal")
    likert = field.score_map(spark, sf_dir).select("form_id", "question_id").distinct()
    return ordinal.select("form_id", "question_id", "min", "max").unionByName(
        likert.select("form_id", "question_id", F.lit(1).alias("min"), F.lit(5).alias("max"))
    )


@query("agg04", BASE_SQL + MEAN_SQL)
def means(spark, sf_dir):
    return P.mean_metrics(_facts(spark, sf_dir, scored=True), _bounds(spark, sf_dir))


@query("agg05", BASE_SQL + DISTRIBUTION_SQL)
def distributions(spark, sf_dir):
    return P.ordinal_distribution(_facts(spark, sf_dir, scored=True), _bounds(spark, sf_dir))


@query("agg06", BASE_SQL + CONDITIONAL_SQL)
def conditional_shares(spark, sf_dir):
    m = field.members(spark, sf_dir)
    cells = P.group_cells(field.responses(spark, sf_dir), m)
    return P.conditional_metrics(cells, m, _options(spark, sf_dir, "multi_choice"))


@query("agg07", BASE_SQL + PROFILE_SQL)
def full_profile(spark, sf_dir):
    return P.profile(
        field.responses(spark, sf_dir), field.questions(spark, sf_dir), field.options(spark, sf_dir),
        field.members(spark, sf_dir), field.score_map(spark, sf_dir),
    )


SCOPED_SQL = BASE_SQL.replace(
    "ON l.l_orderkey = o.o_orderkey)",
    "ON l.l_orderkey = o.o_orderkey\n WHERE o.o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31')", 1,
)


@query("agg10", BASE_SQL + """SELECT form_id, CAST(min(submitted_at) AS VARCHAR) AS first_submitted_at,
  CAST(max(submitted_at) AS VARCHAR) AS last_submitted_at FROM survey GROUP BY 1""")
def response_timestamp_range(spark, sf_dir):
    fmt = "yyyy-MM-dd HH:mm:ss"
    return timestamp_range(field.survey(spark, sf_dir), "form_id").select(
        "form_id",
        F.date_format("first_submitted_at", fmt).alias("first_submitted_at"),
        F.date_format("last_submitted_at", fmt).alias("last_submitted_at"),
    )


@query("flt01", SCOPED_SQL + "SELECT form_id, count(*) AS responses, sum(q_score) AS score_sum FROM survey GROUP BY 1")
def scope_filter(spark, sf_dir):
    return in_scope(field.survey(spark, sf_dir), field.SCOPE).groupBy("form_id").agg(
        F.count(F.lit(1)).alias("responses"), F.sum("q_score").alias("score_sum")
    )
