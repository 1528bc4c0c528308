"""Survey data seen through the driver tables, in Spark and as SQL CTEs.

One order is one response of the form of its customer's nation. Status P routes to
submit, so the checkbox question is then not reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.functions.slots import slot
from canvass.operators.scope import Scope

SCOPE = Scope("1997-01-01 00:00:00", "1998-12-31 00:00:00")

# The form every nation uses: question -> (kind, section, required, min, max).
QUESTIONS = {
    "q_status": ("single_choice", "entry", True, None, None),
    "q_score": ("ordinal", "entry", True, 1, 5),
    "q_priority": ("single_choice", "entry", False, None, None),
    "q_segment": ("text", "entry", False, None, None),
    "q_flags": ("multi_choice", "flags", False, None, None),
}
OPTIONS = {
    "q_status": ("F", "O", "P", "X"),
    "q_priority": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
    "q_flags": ("A", "N", "R", "Z"),
}
GROUPS = {
    "g_heavy": ("q_segment", ("MACHINERY", "BUILDING")),
    "g_home": ("q_segment", ("HOUSEHOLD", "FURNITURE", "BUILDING")),
    "g_open": ("q_status", ("O", "P")),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per response, one column per question."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    flag = lambda v: F.max(F.when(F.col("l_returnflag") == v, 1).otherwise(0))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        flag("A").alias("a"), flag("N").alias("n"), flag("R").alias("r")
    )
    reached = F.col("o_orderstatus") != "P"
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.concat(F.lit("form:"), F.col("c_nationkey")).alias("form_id"),
            F.col("o_orderkey").alias("response_id"),
            F.col("o_orderdate").alias("submitted_at"),
            F.when(F.col("c_acctbal") < 0, "synthetic").otherwise("original").alias("origin"),
            F.col("o_custkey").alias("custkey"),
            F.col("o_orderstatus").alias("q_status"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("q_score"),
            F.col("o_orderpriority").alias("q_priority"),
            F.col("c_mktsegment").alias("q_segment"),
            F.when(~reached, "not_reached").when(F.col("l_orderkey").isNull(), "skipped")
            .otherwise("answered").alias("q_flags_state"),
            *[F.when(reached, F.col(c)).alias(f"has_{c}") for c in ("a", "n", "r")],
        )
    )


def with_answers(wide: DataFrame) -> DataFrame:
    """Wide survey columns to an array of slots."""
    answered = F.lit("answered")
    kind = {q: F.lit(spec[0]) for q, spec in QUESTIONS.items()}
    flags = F.when(
        F.col("q_flags_state") == "answered",
        F.filter(
            F.array(*[F.when(F.col(f"has_{c}") == 1, c.upper()) for c in ("a", "n", "r")]),
            lambda v: v.isNotNull(),
        ),
    )
    return wide.withColumn(
        "answers",
        F.array(
            slot(question_id=F.lit("q_status"), kind=kind["q_status"], state=answered,
                 option_key=F.col("q_status"), label=F.col("q_status")),
            slot(question_id=F.lit("q_score"), kind=kind["q_score"], state=answered, score=F.col("q_score")),
            slot(question_id=F.lit("q_priority"), kind=kind["q_priority"], state=answered,
                 option_key=F.col("q_priority"), label=F.col("q_priority")),
            slot(question_id=F.lit("q_segment"), kind=kind["q_segment"], state=answered, text=F.col("q_segment")),
            slot(question_id=F.lit("q_flags"), kind=kind["q_flags"], state=F.col("q_flags_state"),
                 option_keys=flags, labels=flags),
        ),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_answers(survey(spark, sf_dir)).select("form_id", "response_id", "submitted_at", "origin", "answers")


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("form:"), F.col("n_nationkey")).alias("form_id"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(q).alias("question_id"), F.lit(kind).alias("kind"), F.lit(section).alias("section_id"),
                F.lit(required).alias("required"), F.lit(lo).cast("int").alias("min"),
                F.lit(hi).cast("int").alias("max"), F.lit(i).alias("ord"),
            )
            for i, (q, (kind, section, required, lo, hi)) in enumerate(QUESTIONS.items())
        ]
    )
    return forms(spark, sf_dir).select("form_id", F.inline(rows))


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(q).alias("question_id"), F.lit(k).alias("option_key"), F.lit(k).alias("label"),
                     F.lit(False).alias("is_other"), F.lit(i).alias("ord"))
            for q, keys in OPTIONS.items() for i, k in enumerate(keys)
        ]
    )
    return forms(spark, sf_dir).select("form_id", F.inline(rows))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(g).alias("group_id"), F.lit(q).alias("question_id"), F.lit(m).alias("member"))
            for g, (q, ms) in GROUPS.items() for m in ms
        ]
    )
    return forms(spark, sf_dir).select("form_id", F.inline(rows))


def score_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likert reading of the priority question: the first label scores 5."""
    return options(spark, sf_dir).where(F.col("question_id") == "q_priority").select(
        "form_id", "question_id", "option_key", (F.lit(5) - F.col("ord")).alias("score")
    )


def _values(rows: list[tuple]) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return str(v) if isinstance(v, (int, float)) else "'" + v + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


SURVEY_SQL = """survey AS (
 SELECT 'form:' || c.c_nationkey AS form_id, o.o_orderkey AS response_id, o.o_orderdate AS submitted_at,
        CASE WHEN c.c_acctbal < 0 THEN 'synthetic' ELSE 'original' END AS origin, o.o_custkey AS custkey,
        o.o_orderstatus AS q_status, CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS q_score,
        o.o_orderpriority AS q_priority, c.c_mktsegment AS q_segment,
        CASE WHEN o.o_orderstatus = 'P' THEN 'not_reached'
             WHEN l.l_orderkey IS NULL THEN 'skipped' ELSE 'answered' END AS q_flags_state,
        CASE WHEN o.o_orderstatus <> 'P' THEN l.a END AS has_a,
        CASE WHEN o.o_orderstatus <> 'P' THEN l.n END AS has_n,
        CASE WHEN o.o_orderstatus <> 'P' THEN l.r END AS has_r
 FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
 LEFT JOIN (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a,
                   max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS n,
                   max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r
            FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey)"""

FLAGS_SQL = (
    "CASE WHEN q_flags_state = 'answered' THEN list_filter([CASE WHEN has_a = 1 THEN 'A' END, "
    "CASE WHEN has_n = 1 THEN 'N' END, CASE WHEN has_r = 1 THEN 'R' END], lambda v: v IS NOT NULL) END"
)

# Long slots: one row per response and question.
SLOTS_SQL = f"""slots AS (
 SELECT form_id, response_id, submitted_at, origin, 'q_status' AS question_id, 'single_choice' AS kind,
        'answered' AS state, q_status AS option_key, CAST(NULL AS VARCHAR[]) AS option_keys,
        CAST(NULL AS INTEGER) AS score, CAST(NULL AS VARCHAR) AS text FROM survey
 UNION ALL SELECT form_id, response_id, submitted_at, origin, 'q_score', 'ordinal', 'answered', NULL, NULL, q_score, NULL FROM survey
 UNION ALL SELECT form_id, response_id, submitted_at, origin, 'q_priority', 'single_choice', 'answered', q_priority, NULL, NULL, NULL FROM survey
 UNION ALL SELECT form_id, response_id, submitted_at, origin, 'q_segment', 'text', 'answered', NULL, NULL, NULL, q_segment FROM survey
 UNION ALL SELECT form_id, response_id, submitted_at, origin, 'q_flags', 'multi_choice', q_flags_state, NULL, {FLAGS_SQL}, NULL, NULL FROM survey)"""

FORMS_SQL = "forms AS (SELECT 'form:' || n_nationkey AS form_id FROM nation)"
QUESTIONS_SQL = (
    "questions AS (SELECT form_id, v.* FROM forms, "
    + _values([(q, *spec, i) for i, (q, spec) in enumerate(QUESTIONS.items())])
    + " v(question_id, kind, section_id, required, min, max, ord))"
)
OPTIONS_SQL = (
    "options AS (SELECT form_id, v.* FROM forms, "
    + _values([(q, k, i) for q, keys in OPTIONS.items() for i, k in enumerate(keys)])
    + " v(question_id, option_key, ord))"
)
MEMBERS_SQL = (
    "members AS (SELECT form_id, v.* FROM forms, "
    + _values([(g, q, m) for g, (q, ms) in GROUPS.items() for m in ms])
    + " v(group_id, question_id, member))"
)
# Per form and question: eligible, per option: picked.
FACTS_SQL = """elig AS (SELECT form_id, question_id, count(*) AS denominator_count FROM slots
   WHERE state IN ('answered', 'skipped') GROUP BY 1, 2),
 picks AS (SELECT form_id, question_id, option_key, count(*) AS n FROM (
   SELECT form_id, question_id, option_key FROM slots WHERE state = 'answered' AND kind = 'single_choice'
   UNION ALL SELECT form_id, question_id, unnest(option_keys) FROM slots WHERE state = 'answered' AND kind = 'multi_choice')
   GROUP BY 1, 2, 3)"""
# Scores: ordinal answers and the Likert reading of the priority question.
SCORES_SQL = """scores AS (SELECT form_id, question_id, score FROM slots WHERE state = 'answered' AND kind = 'ordinal'
   UNION ALL SELECT s.form_id, s.question_id, 5 - o.ord FROM slots s JOIN options o
     ON o.form_id = s.form_id AND o.question_id = s.question_id AND o.option_key = s.option_key
     WHERE s.question_id = 'q_priority' AND s.state = 'answered')"""
HITS_SQL = """hits AS (SELECT s.form_id, s.response_id, m.group_id FROM slots s JOIN members m
   ON m.form_id = s.form_id AND m.question_id = s.question_id
  AND m.member = CASE WHEN s.kind = 'text' THEN s.text ELSE s.option_key END WHERE s.state = 'answered')"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE_SQL = ctes(SURVEY_SQL, SLOTS_SQL, FORMS_SQL, QUESTIONS_SQL, OPTIONS_SQL, MEMBERS_SQL, FACTS_SQL, SCORES_SQL, HITS_SQL)
