"""A branching form over the driver tables: raw answers, landed JSON, routing oracles.

Every nation runs the same four-section form. Which answers a response holds depends on the
order, so that skips, conflicts, backward jumps and restarts all occur.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.functions.slots import explode_slots, slot
from canvass.operators import routing as R
from canvass.queries import field
from canvass.queries.field import FORMS_SQL, ctes
from canvass.queries.registry import query
from canvass.sources import responses as SR

SECTIONS = ("entry", "mid", "flags", "end")
# question -> (section, required, kind)
QUESTIONS = {
    "q_status": (0, True, "single_choice"),
    "q_priority": (1, False, "single_choice"),
    "q_flags": (2, False, "multi_choice"),
    "q_score": (2, True, "ordinal"),
    "q_segment": (3, False, "text"),
}
# (question, option, destination type, destination section)
TRANSITIONS = (
    ("q_status", "F", "next_section", None),
    ("q_status", "O", "section", 2),
    ("q_status", "P", "submit", None),
    ("q_priority", "1-URGENT", "section", 3),
    ("q_priority", "2-HIGH", "section", 1),
    ("q_priority", "3-MEDIUM", "section", 0),
    ("q_priority", "5-LOW", "restart", None),
)
OPTIONS = {
    "q_status": ("F", "O", "P"),
    "q_priority": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "Other"),
    "q_flags": ("A", "N", "R"),
}


def _dims(spark, sf_dir, rows):
    return field.forms(spark, sf_dir).select("form_id", F.inline(F.array(*rows)))


def sections(spark, sf_dir):
    following = (*SECTIONS[1:], None)
    return _dims(spark, sf_dir, [
        F.struct(F.lit(s).alias("section_id"), F.lit(i).alias("ord"),
                 F.lit(n).cast("string").alias("next_section_id"))
        for i, (s, n) in enumerate(zip(SECTIONS, following, strict=True))
    ])


def questions(spark, sf_dir):
    return _dims(spark, sf_dir, [
        F.struct(F.lit(q).alias("question_id"), F.lit(i).alias("ord"), F.lit(s).alias("section_ord"),
                 F.lit(r).alias("required"), F.lit(k).alias("kind"),
                 F.lit(1 if k == "ordinal" else None).cast("int").alias("min"),
                 F.lit(5 if k == "ordinal" else None).cast("int").alias("max"))
        for i, (q, (s, r, k)) in enumerate(QUESTIONS.items())
    ])


def transitions(spark, sf_dir):
    return _dims(spark, sf_dir, [
        F.struct(F.lit(q).alias("question_id"), F.lit(o).alias("option_key"), F.lit(t).alias("dest_type"),
                 F.lit(d).cast("int").alias("dest_ord"), F.lit(QUESTIONS[q][0]).alias("source_ord"))
        for q, o, t, d in TRANSITIONS
    ])


def options(spark, sf_dir):
    return _dims(spark, sf_dir, [
        F.struct(F.lit(q).alias("question_id"), F.lit(k).alias("option_key"), F.lit(k).alias("label"),
                 F.lit(k == "Other").alias("is_other"), F.lit(i).alias("ord"))
        for q, ks in OPTIONS.items() for i, k in enumerate(ks)
    ])


def index(spark, sf_dir):
    return R.form_index(sections(spark, sf_dir), questions(spark, sf_dir), transitions(spark, sf_dir))


def _wide(spark, sf_dir):
    s = field.survey(spark, sf_dir)
    extra = field.table(spark, sf_dir, "orders").join(
        field.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select(F.col("o_orderkey").alias("response_id"), "o_totalprice", "c_acctbal")
    flag = lambda v: F.max(F.when(F.col("l_returnflag") == v, 1).otherwise(0))
    lines = field.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("response_id")).agg(
        flag("A").alias("a"), flag("N").alias("n"), flag("R").alias("r")
    )
    return s.join(extra, "response_id").join(lines, "response_id", "left")


def _given():
    return {
        "q_status": F.col("o_totalprice") >= 50000,
        "q_priority": F.col("c_acctbal") >= 2000,
        "q_flags": F.col("a").isNotNull(),
        "q_score": F.col("o_totalprice") < 400000,
        "q_segment": F.col("q_status") != "P",
    }


def _flags():
    return F.filter(
        F.array(*[F.when(F.col(c) == 1, c.upper()) for c in ("a", "n", "r")]), lambda v: v.isNotNull()
    )


def raw_answers(spark, sf_dir):
    """One row per response with its answered slots only."""
    wide, given, done = _wide(spark, sf_dir), _given(), F.lit("answered")
    slots = {
        "q_status": slot(question_id=F.lit("q_status"), kind=F.lit("single_choice"), state=done,
                         option_key=F.col("q_status"), label=F.col("q_status")),
        "q_priority": slot(question_id=F.lit("q_priority"), kind=F.lit("single_choice"), state=done,
                           option_key=F.col("q_priority"), label=F.col("q_priority")),
        "q_flags": slot(question_id=F.lit("q_flags"), kind=F.lit("multi_choice"), state=done,
                        option_keys=_flags(), labels=_flags()),
        "q_score": slot(question_id=F.lit("q_score"), kind=F.lit("ordinal"), state=done, score=F.col("q_score")),
        "q_segment": slot(question_id=F.lit("q_segment"), kind=F.lit("text"), state=done, text=F.col("q_segment")),
    }
    answers = F.filter(F.array(*[F.when(given[q], s) for q, s in slots.items()]), lambda s: s.isNotNull())
    return wide.select("form_id", "response_id", "submitted_at", answers.alias("answers"))


def _case(by_question: dict[str, str]) -> str:
    return "CASE q.question_id " + " ".join(f"WHEN '{q}' THEN {e}" for q, e in by_question.items()) + " END"


GIVEN_SQL = _case({
    "q_status": "r.o_totalprice >= 50000", "q_priority": "r.c_acctbal >= 2000", "q_flags": "r.has_lines",
    "q_score": "r.o_totalprice < 400000", "q_segment": "r.st <> 'P'",
})
PATH_CTES = (
    FORMS_SQL,
    """r AS (SELECT 'form:' || c_nationkey AS form_id, o_orderkey AS response_id, o_orderstatus AS st,
   o_orderpriority AS pr, o_totalprice, c_acctbal, c_mktsegment AS seg, o_orderdate AS submitted_at, l.l_orderkey IS NOT NULL AS has_lines, l.flags
  FROM orders JOIN customer ON c_custkey = o_custkey
  LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags
             FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey)""",
    "q AS (SELECT * FROM " + field._values([(q, i, *spec) for i, (q, spec) in enumerate(QUESTIONS.items())])
    + " v(question_id, ord, section_ord, required, kind))",
    "sec AS (SELECT * FROM " + field._values([(s, i) for i, s in enumerate(SECTIONS)]) + " v(section_id, ord))",
    "t AS (SELECT v.*, q.section_ord AS source_ord FROM "
    + field._values([(q, o, d, s if s is not None else -1) for q, o, d, s in TRANSITIONS])
    + " v(question_id, option_key, dest_type, dest_ord) JOIN q USING (question_id))",
    f"""ans AS (SELECT r.form_id, r.response_id, q.question_id, q.section_ord, q.kind,
   CASE q.question_id WHEN 'q_status' THEN r.st WHEN 'q_priority' THEN r.pr END AS option_key
  FROM r, q WHERE {GIVEN_SQL})""",
    """hit AS (SELECT a.*, t.dest_type, t.dest_ord FROM ans a
  JOIN t ON t.question_id = a.question_id AND t.option_key = a.option_key)""",
    """reached AS (SELECT response_id, 0 AS ord FROM r UNION SELECT response_id, section_ord FROM ans
  UNION SELECT response_id, section_ord + 1 FROM hit WHERE dest_type = 'next_section' AND section_ord < 3
  UNION SELECT response_id, dest_ord FROM hit WHERE dest_type = 'section')""",
    """away AS (SELECT DISTINCT h.response_id, s.ord FROM hit h JOIN sec s ON s.ord > h.section_ord
  AND (h.dest_type = 'submit' OR (h.dest_type = 'section' AND s.ord < h.dest_ord)))""",
    """clash AS (SELECT a.response_id FROM away a JOIN ans b ON b.response_id = a.response_id AND b.section_ord = a.ord
  UNION SELECT response_id FROM hit WHERE dest_type = 'section' AND dest_ord < section_ord)""",
    """path AS (SELECT r.form_id, r.response_id, q.question_id, q.required, q.kind,
   a.question_id IS NOT NULL AS answered,
   CASE WHEN a.question_id IS NOT NULL THEN 'reached' WHEN x.ord IS NOT NULL THEN 'reached'
        WHEN w.ord IS NOT NULL THEN 'not_reached' ELSE 'indeterminate' END AS reach
  FROM r CROSS JOIN q LEFT JOIN ans a ON a.response_id = r.response_id AND a.question_id = q.question_id
  LEFT JOIN reached x ON x.response_id = r.response_id AND x.ord = q.section_ord
  LEFT JOIN away w ON w.response_id = r.response_id AND w.ord = q.section_ord)""",
    """conf AS (SELECT p.response_id, bool_or(p.reach = 'indeterminate') AS unknown,
   bool_and(CASE WHEN p.question_id <> 'q_priority' THEN TRUE
                 WHEN p.answered THEN NOT EXISTS (SELECT 1 FROM hit h WHERE h.response_id = p.response_id
                                                  AND h.question_id = 'q_priority' AND h.dest_type = 'restart')
                 ELSE p.reach = 'not_reached' END) AS restart_irrelevant
  FROM path p GROUP BY 1)""",
    """verdict AS (SELECT r.form_id, r.response_id, c.restart_irrelevant,
   CASE WHEN EXISTS (SELECT 1 FROM hit h WHERE h.response_id = r.response_id AND h.dest_type = 'restart') THEN 'ambiguous'
        WHEN c.unknown AND NOT c.restart_irrelevant THEN 'ambiguous'
        WHEN c.unknown OR EXISTS (SELECT 1 FROM clash k WHERE k.response_id = r.response_id) THEN 'partial'
        ELSE 'certain' END AS confidence
  FROM r JOIN conf c ON c.response_id = r.response_id)""",
)
PATH_SQL = ctes(*PATH_CTES)
STATE_SQL = """CASE WHEN p.answered THEN 'answered' WHEN p.reach = 'reached' AND NOT p.required THEN 'skipped'
   WHEN p.reach = 'not_reached' THEN 'not_reached' ELSE 'indeterminate' END"""


def _paths(spark, sf_dir):
    return R.resolve_paths(raw_answers(spark, sf_dir), index(spark, sf_dir))


@query("rte01", PATH_SQL + """SELECT p.form_id, p.response_id, p.question_id, p.reach, v.confidence
 FROM path p JOIN verdict v ON v.response_id = p.response_id""")
def path_resolution(spark, sf_dir):
    return _paths(spark, sf_dir).select(
        "form_id", "response_id", "confidence", F.inline_outer("path")
    )


@query("rte02", PATH_SQL + "SELECT form_id, response_id, restart_irrelevant FROM verdict")
def restart_relevance(spark, sf_dir):
    return _paths(spark, sf_dir).select("form_id", "response_id", "restart_irrelevant")


@query("rte03", PATH_SQL + f"SELECT p.form_id, p.response_id, p.question_id, {STATE_SQL} AS state FROM path p")
def completed_states(spark, sf_dir):
    done = R.complete_slots(_paths(spark, sf_dir))
    return explode_slots(done).select("form_id", "response_id", "question_id", "state")


RULES_SQL = """, held AS (SELECT t.question_id, t.option_key, q.question_id AS held, 'forbidden' AS side FROM t JOIN q
   ON q.section_ord > t.source_ord AND (t.dest_type = 'submit' OR (t.dest_type = 'section' AND q.section_ord < t.dest_ord))
  UNION ALL SELECT t.question_id, t.option_key, q.question_id, 'required' FROM t JOIN q ON q.required
   AND q.section_ord = CASE WHEN t.dest_type = 'section' AND t.dest_ord > t.source_ord THEN t.dest_ord
                            WHEN t.dest_type = 'next_section' AND t.source_ord < 3 THEN t.source_ord + 1 END)
 SELECT form_id, question_id, option_key,
   coalesce(string_agg(held, ',' ORDER BY held) FILTER (WHERE side = 'forbidden'), '') AS forbidden,
   coalesce(string_agg(held, ',' ORDER BY held) FILTER (WHERE side = 'required'), '') AS required
 FROM forms, held GROUP BY 1, 2, 3"""


@query("rte04", PATH_SQL.rstrip() + RULES_SQL)
def compiled_rules(spark, sf_dir):
    rules = R.routing_rules(transitions(spark, sf_dir), sections(spark, sf_dir), questions(spark, sf_dir))
    return rules.select(
        "form_id", "question_id", "option_key",
        F.array_join("forbidden", ",").alias("forbidden"), F.array_join("required", ",").alias("required"),
    )


@query("rte05", PATH_SQL + """SELECT p.form_id, p.response_id, p.question_id,
   CASE WHEN p.answered THEN 'answered' WHEN p.reach = 'reached' THEN 'skipped'
        WHEN p.reach = 'not_reached' THEN 'not_reached' ELSE 'indeterminate' END AS state,
   CAST(sum(CASE WHEN NOT p.answered AND p.reach = 'reached' AND p.required THEN 1 ELSE 0 END)
        OVER (PARTITION BY p.response_id) AS INTEGER) AS required_skipped FROM path p""")
def rebuilt_synthetic_rows(spark, sf_dir):
    done = R.complete_slots(_paths(spark, sf_dir), synthetic=True)
    return explode_slots(done, "required_skipped").select(
        "form_id", "response_id", "question_id", "state", "required_skipped"
    )


@query("rte06", PATH_SQL + """SELECT a.form_id, a.response_id, a.question_id FROM ans a
  JOIN away w ON w.response_id = a.response_id AND w.ord = a.section_ord""")
def hard_routing_check(spark, sf_dir):
    return R.routing_violations(raw_answers(spark, sf_dir), index(spark, sf_dir))


@query("join04", PATH_SQL + """SELECT form_id, question_id, option_key, dest_type, count(*) AS responses
 FROM hit GROUP BY 1, 2, 3, 4""")
def answered_transitions(spark, sf_dir):
    slots = explode_slots(raw_answers(spark, sf_dir)).where(F.col("kind") == "single_choice")
    return (
        slots.select("form_id", "question_id", "option_key")
        .join(transitions(spark, sf_dir), ["form_id", "question_id", "option_key"])
        .groupBy("form_id", "question_id", "option_key", "dest_type").agg(F.count(F.lit(1)).alias("responses"))
    )


@query("join05", PATH_SQL + """SELECT f.form_id, t.question_id, t.option_key, s.section_id FROM forms f, t
 JOIN sec s ON s.ord > t.source_ord AND (t.dest_type = 'submit' OR (t.dest_type = 'section' AND s.ord < t.dest_ord))""")
def routed_around_sections(spark, sf_dir):
    return R.skipped_sections(transitions(spark, sf_dir), sections(spark, sf_dir)).select(
        "form_id", "question_id", "option_key", "section_id"
    )


@query("win02", PATH_SQL + """SELECT form_id, section_id, ord, lead(section_id) OVER (PARTITION BY form_id ORDER BY ord) AS next_section_id
 FROM forms, sec""")
def next_sections(spark, sf_dir):
    from pyspark.sql import Window

    return sections(spark, sf_dir).select(
        "form_id", "section_id", "ord",
        F.lead("section_id").over(Window.partitionBy("form_id").orderBy("ord")).alias("next_section_id"),
    )


# Landed JSON: priority labels come wide, padded or free-form, so that label matching has work to do.
FULL_WIDTH_DIGITS = "０１２３４５６７８９"


def landed_responses(spark, sf_dir):
    given = _given()
    texts = lambda arr: F.struct(F.struct(F.transform(arr, lambda v: F.struct(v.alias("value"))).alias("answers")).alias("textAnswers"))
    priority = (
        F.when(F.col("q_status") == "F", F.concat(F.lit("  "), F.col("q_priority"), F.lit(" ")))
        .when(F.col("q_status") == "O", F.translate("q_priority", "0123456789", FULL_WIDTH_DIGITS))
        .otherwise(F.concat(F.lit("about "), F.col("q_priority")))
    )
    doc = F.struct(
        F.concat(F.lit("r"), F.col("response_id")).alias("responseId"),
        F.date_format("submitted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createTime"),
        F.struct(
            F.when(given["q_status"], texts(F.array("q_status"))).alias("q_status"),
            F.when(given["q_priority"], texts(F.array(priority))).alias("q_priority"),
            F.when(given["q_flags"], texts(_flags())).alias("q_flags"),
            F.when(given["q_score"], texts(F.array(F.col("q_score").cast("string")))).alias("q_score"),
            F.when(given["q_segment"], texts(F.array("q_segment", "q_segment"))).alias("q_segment"),
            texts(F.array("q_segment")).alias("q_unknown"),
        ).alias("answers"),
    )
    return _wide(spark, sf_dir).select("form_id", F.to_json(doc).alias("payload"))


def typed_responses(spark, sf_dir):
    specs = SR.answer_index(questions(spark, sf_dir), options(spark, sf_dir))
    return SR.type_answers(SR.parse_responses(landed_responses(spark, sf_dir)), specs)


TYPED_SQL = f"""SELECT r.form_id, 'r' || r.response_id AS response_id, q.question_id, q.kind,
   CASE q.question_id WHEN 'q_status' THEN r.st
     WHEN 'q_priority' THEN CASE WHEN r.st = 'P' THEN 'Other' ELSE r.pr END
     WHEN 'q_flags' THEN r.flags WHEN 'q_score' THEN substr(r.pr, 1, 1)
     WHEN 'q_segment' THEN r.seg || chr(10) || r.seg END AS value,
   CASE WHEN q.question_id = 'q_priority' AND r.st = 'P' THEN 'about ' || r.pr END AS other_value
  FROM r, q WHERE {GIVEN_SQL}"""


def _typed_rows(spark, sf_dir):
    return explode_slots(typed_responses(spark, sf_dir)).select(
        "form_id", "response_id", "question_id", "kind",
        F.coalesce("option_key", F.array_join("option_keys", ","), F.col("score").cast("string"), "text").alias("value"),
        "other_value",
    )


@query("src05", PATH_SQL + TYPED_SQL)
def typed_ingest(spark, sf_dir):
    return _typed_rows(spark, sf_dir)


@query("scl05", PATH_SQL + f"SELECT form_id, question_id, kind, count(*) AS answers, count(DISTINCT value) AS distinct_values FROM ({TYPED_SQL}) GROUP BY 1, 2, 3")
def answer_typing(spark, sf_dir):
    return _typed_rows(spark, sf_dir).groupBy("form_id", "question_id", "kind").agg(
        F.count(F.lit(1)).alias("answers"), F.count_distinct("value").alias("distinct_values")
    )


@query("scl06", PATH_SQL + f"SELECT response_id, value FROM ({TYPED_SQL}) WHERE kind = 'multi_choice'")
def checkbox_typing(spark, sf_dir):
    return _typed_rows(spark, sf_dir).where(F.col("kind") == "multi_choice").select("response_id", "value")


@query("scl07", PATH_SQL + f"SELECT response_id, value FROM ({TYPED_SQL}) WHERE kind = 'text'")
def text_extraction(spark, sf_dir):
    return _typed_rows(spark, sf_dir).where(F.col("kind") == "text").select("response_id", "value")


@query("join01", PATH_SQL + f"SELECT form_id, question_id, count(*) AS answers FROM ({TYPED_SQL}) GROUP BY 1, 2")
def known_answers(spark, sf_dir):
    parsed = SR.parse_responses(landed_responses(spark, sf_dir))
    return (
        parsed.select("form_id", F.inline("entries"))
        .join(questions(spark, sf_dir).select("form_id", "question_id"), ["form_id", "question_id"])
        .groupBy("form_id", "question_id").agg(F.count(F.lit(1)).alias("answers"))
    )


@query("join02", PATH_SQL + f"SELECT form_id, value AS option_key, count(*) AS answers FROM ({TYPED_SQL}) WHERE question_id = 'q_priority' AND other_value IS NULL GROUP BY 1, 2")
def matched_labels(spark, sf_dir):
    return _typed_rows(spark, sf_dir).where(
        (F.col("question_id") == "q_priority") & F.col("other_value").isNull()
    ).groupBy("form_id", F.col("value").alias("option_key")).agg(F.count(F.lit(1)).alias("answers"))


@query("join03", PATH_SQL + f"SELECT form_id, value AS option_key, other_value, count(*) AS answers FROM ({TYPED_SQL}) WHERE other_value IS NOT NULL GROUP BY 1, 2, 3")
def other_fallback(spark, sf_dir):
    return _typed_rows(spark, sf_dir).where(F.col("other_value").isNotNull()).groupBy(
        "form_id", F.col("value").alias("option_key"), "other_value"
    ).agg(F.count(F.lit(1)).alias("answers"))


@query("scl08", PATH_SQL + f"SELECT form_id, coalesce(other_value, value) AS label_key, count(*) AS answers FROM ({TYPED_SQL}) WHERE question_id = 'q_priority' GROUP BY 1, 2")
def label_keys_of_answers(spark, sf_dir):
    from canvass.functions.labels import label_keys

    parsed = SR.parse_responses(landed_responses(spark, sf_dir))
    labels = parsed.select("form_id", F.inline("entries")).where(F.col("question_id") == "q_priority")
    return (
        labels.select("form_id", F.explode("texts").alias("raw"))
        .groupBy("form_id", "raw").agg(F.count(F.lit(1)).alias("n"))
        .select("form_id", label_keys(F.array("raw"))[0].alias("label_key"), "n")
        .groupBy("form_id", "label_key").agg(F.sum("n").alias("answers"))
    )


@query("scl22", PATH_SQL + "SELECT 'r' || response_id AS response_id, epoch_us(submitted_at) AS submitted_us FROM r")
def submission_times(spark, sf_dir):
    return SR.parse_responses(landed_responses(spark, sf_dir)).select(
        "response_id", F.unix_micros("submitted_at").alias("submitted_us")
    )
