"""Evaluation of a finished table: accounts in debt play the synthetic side, the rest the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.operators import evaluate as E
from canvass.queries import field
from canvass.queries.field import SURVEY_SQL, ctes
from canvass.queries.registry import query

COLUMNS = ("form_id", "submitted_at", "q_status", "q_priority", "q_segment", "has_a", "has_n", "has_r")
COLS_SQL = ", ".join(COLUMNS)
S = ctes(SURVEY_SQL)
CONTENT = ("q_status", "q_priority", "q_segment", "has_a", "has_n", "has_r")
CONTENT_SQL = ", ".join(CONTENT)
JOIN_SQL = " AND ".join(f"s.{c} IS NOT DISTINCT FROM o.{c}" for c in COLUMNS)


@query("agg14", S + f"""SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows FROM (
  SELECT count(*) AS n FROM survey GROUP BY {COLS_SQL} HAVING count(*) > 1)""")
def duplicate_rows(spark, sf_dir):
    return E.row_diagnostics(field.survey(spark, sf_dir), COLUMNS).select("duplicate_rows")


@query("agg15", S + f"""SELECT max(n) AS max_fingerprint_count,
  max(n) / (SELECT count(*) FROM survey WHERE origin = 'synthetic') AS max_fingerprint_share
 FROM (SELECT count(*) AS n FROM survey WHERE origin = 'synthetic' GROUP BY {CONTENT_SQL})""")
def fingerprint_concentration(spark, sf_dir):
    return E.row_diagnostics(field.survey(spark, sf_dir), CONTENT).select(
        "max_fingerprint_count", "max_fingerprint_share"
    )


@query("agg16", S + f"""SELECT count(*) AS source_clones,
  count(*) / (SELECT count(*) FROM survey WHERE origin = 'synthetic') AS source_clone_rate
 FROM survey s WHERE origin = 'synthetic' AND EXISTS (
   SELECT 1 FROM (SELECT DISTINCT {COLS_SQL} FROM survey WHERE origin = 'original') o WHERE {JOIN_SQL})""")
def clone_rate(spark, sf_dir):
    return E.row_diagnostics(field.survey(spark, sf_dir), COLUMNS).select("source_clones", "source_clone_rate")


@query("join17", S + f"""SELECT s.response_id, s.form_id, s.q_status FROM survey s WHERE origin = 'synthetic' AND EXISTS (
   SELECT 1 FROM (SELECT DISTINCT {COLS_SQL} FROM survey WHERE origin = 'original') o WHERE {JOIN_SQL})""")
def clone_rows(spark, sf_dir):
    return E.source_clones(field.survey(spark, sf_dir), COLUMNS).select("response_id", "form_id", "q_status")


ECDF_SQL = """, c AS (SELECT submitted_at AS t, sum(CASE WHEN origin = 'original' THEN 1 ELSE 0 END) AS r,
   sum(CASE WHEN origin = 'synthetic' THEN 1 ELSE 0 END) AS s FROM survey GROUP BY 1),
 e AS (SELECT t, sum(r) OVER (ORDER BY t) AS rc, sum(s) OVER (ORDER BY t) AS sc,
   sum(r) OVER () AS rt, sum(s) OVER () AS st FROM c)"""


@query("agg17", S.rstrip() + ECDF_SQL + " SELECT round(max(abs(rc / rt - sc / st)), 9) AS ks_statistic FROM e")
def timestamp_ks(spark, sf_dir):
    return E.timestamp_ks(field.survey(spark, sf_dir)).select(F.round("ks_statistic", 9).alias("ks_statistic"))


@query("agg18", S + """SELECT (median(epoch_us(submitted_at)) FILTER (WHERE origin = 'synthetic')
   - median(epoch_us(submitted_at)) FILTER (WHERE origin = 'original')) / 1e6 AS median_delta_seconds FROM survey""")
def timestamp_median_delta(spark, sf_dir):
    return E.timestamp_ks(field.survey(spark, sf_dir)).select("median_delta_seconds")


@query("win08", """WITH c AS (SELECT ts AS t, count(*) FILTER (WHERE event_type <> 'purchase') AS source_n,
   count(*) FILTER (WHERE event_type = 'purchase') AS synthetic_n FROM events GROUP BY 1)
 SELECT epoch_us(t) AS at, CAST(sum(source_n) OVER (ORDER BY t) AS BIGINT) AS source_cum,
   CAST(sum(synthetic_n) OVER (ORDER BY t) AS BIGINT) AS synthetic_cum FROM c""")
def ecdf(spark, sf_dir):
    events = field.table(spark, sf_dir, "events").select(
        F.col("ts").alias("submitted_at"),
        F.when(F.col("event_type") == "purchase", "synthetic").otherwise("original").alias("origin"),
    )
    return E._ecdf(events, "submitted_at").select("at", "source_cum", "synthetic_cum")


@query("agg19", S + """SELECT v.target_id, v.requested, avg(v.score) AS achieved,
   round(abs(avg(v.score) - v.requested), 9) AS absolute_error, count(v.score) AS denominator_count,
   count(*) FILTER (WHERE v.score NOT BETWEEN 1 AND 5) AS invalid_scores, count(*) AS final_count
 FROM (SELECT 'mean_score' AS target_id, 3.1 AS requested, CAST(q_score AS DOUBLE) AS score FROM survey
       UNION ALL SELECT 'mean_flags', 1.5, has_a + has_n + has_r FROM survey) v GROUP BY 1, 2""")
def achieved_means(spark, sf_dir):
    final = field.survey(spark, sf_dir).withColumn("flags", F.col("has_a") + F.col("has_n") + F.col("has_r"))
    return E.achieved_means(
        final, [("mean_score", "q_score", 3.1, 1, 5), ("mean_flags", "flags", 1.5, 1, 5)]
    ).withColumn("absolute_error", F.round("absolute_error", 9))


CATS, NUMS = ("q_status", "q_priority", "q_segment"), ("q_score", "has_n")


def _quality_sql() -> str:
    from itertools import combinations

    pairs = [p for p in combinations([*CATS, *NUMS], 2) if not set(p) <= set(NUMS)]
    cells = [f"SELECT origin, 'shape:{c}' AS m, CAST({c} AS VARCHAR) AS a, NULL AS b FROM survey" for c in CATS]
    cells += [
        f"SELECT origin, 'trend:{a}:{b}', CAST({a} AS VARCHAR), CAST({b} AS VARCHAR) FROM survey" for a, b in pairs
    ]
    ks = " UNION ALL ".join(
        f"""SELECT 'shape:{c}' AS m, 1.0 - max(abs(rc / t.rt - sc / t.st)) AS score FROM (
          SELECT x, sum(r) OVER (ORDER BY x NULLS FIRST) AS rc, sum(s) OVER (ORDER BY x NULLS FIRST) AS sc FROM (
            SELECT CAST({c} AS DOUBLE) AS x, count(*) FILTER (WHERE origin = 'original') AS r,
                   count(*) FILTER (WHERE origin = 'synthetic') AS s FROM survey GROUP BY 1)), t"""
        for c in NUMS
    )
    return S.rstrip() + f""", t AS (SELECT count(*) FILTER (WHERE origin = 'original') AS rt,
   count(*) FILTER (WHERE origin = 'synthetic') AS st FROM survey),
 k AS (SELECT m, a, b, count(*) FILTER (WHERE origin = 'original') AS r, count(*) FILTER (WHERE origin = 'synthetic') AS s
   FROM ({" UNION ALL ".join(cells)}) GROUP BY 1, 2, 3),
 scores AS (SELECT m, 1.0 - sum(abs(r / t.rt - s / t.st)) / 2 AS score FROM k, t GROUP BY 1
   UNION ALL {ks}
   UNION ALL SELECT 'trend:q_score:has_n', 1.0 - abs(
     corr(CASE WHEN origin = 'original' THEN CAST(q_score AS DOUBLE) END, CASE WHEN origin = 'original' THEN CAST(has_n AS DOUBLE) END)
     - corr(CASE WHEN origin = 'synthetic' THEN CAST(q_score AS DOUBLE) END, CASE WHEN origin = 'synthetic' THEN CAST(has_n AS DOUBLE) END)) / 2 FROM survey),
 sections AS (SELECT split_part(m, ':', 1) AS section, avg(score) AS score FROM scores GROUP BY 1)
 SELECT section, metric, round(score, 9) AS score FROM (
   SELECT split_part(m, ':', 1) AS section, m AS metric, score FROM scores
   UNION ALL SELECT section, 'section', score FROM sections
   UNION ALL SELECT 'overall', 'score', avg(score) FROM sections)"""


@query("agg20", _quality_sql())
def quality(spark, sf_dir):
    return E.quality(field.survey(spark, sf_dir), CATS, NUMS).withColumn("score", F.round("score", 9))


@query("evl03", S + """SELECT count(*) FILTER (WHERE submitted_at < TIMESTAMP '1997-01-01') AS before_scope,
   count(*) FILTER (WHERE submitted_at > TIMESTAMP '1998-12-31') AS after_scope FROM survey""")
def frozen_scope_check(spark, sf_dir):
    return E.out_of_scope(field.survey(spark, sf_dir), field.SCOPE.start, field.SCOPE.end)


@query("agg12")
def response_set_fingerprint(spark, sf_dir):
    return E.set_fingerprint(field.survey(spark, sf_dir), ("response_id", *COLUMNS, "q_score"), "form_id")


@query("agg21", S + """SELECT form_id, count(*) FILTER (WHERE origin = 'original') AS original_rows,
   count(*) FILTER (WHERE origin = 'synthetic') AS synthetic_rows, count(*) AS final_rows,
   count(*) FILTER (WHERE origin NOT IN ('original', 'synthetic')) AS bad_origin_rows FROM survey GROUP BY 1""")
def run_diagnostics(spark, sf_dir):
    return field.survey(spark, sf_dir).groupBy("form_id").agg(
        F.count_if(F.col("origin") == "original").alias("original_rows"),
        F.count_if(F.col("origin") == "synthetic").alias("synthetic_rows"),
        F.count(F.lit(1)).alias("final_rows"),
        F.count_if(~F.col("origin").isin("original", "synthetic")).alias("bad_origin_rows"),
    )
