"""Filters, predicates, membership vectors, parsers and value groups over the survey view."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.functions import labels as L
from canvass.functions import parsing as Q
from canvass.functions import slots as SL
from canvass.functions.slots import explode_slots
from canvass.operators import groups as G
from canvass.operators import profile as P
from canvass.plans import domains as D
from canvass.plans import vectors as V
from canvass.queries import field
from canvass.queries.field import BASE_SQL, FLAGS_SQL, SURVEY_SQL, ctes
from canvass.queries.registry import query
from canvass.sources.flat import flat_table, wrong_scores

c = F.col
S = ctes(SURVEY_SQL)
HEAVY = frozenset(field.GROUPS["g_heavy"][1])


def flat(spark, sf_dir):
    """Flat table of the survey; the priority question is scored through its Likert map."""
    likert = {k: 5 - i for i, k in enumerate(field.OPTIONS["q_priority"])}
    return flat_table(
        field.responses(spark, sf_dir), list(field.QUESTIONS), {"q_score": None, "q_priority": likert}
    )


def text_cell(value: str) -> str:
    return f'{{"state":"answered","value":{{"kind":"text","text":"{value}"}}}}'


def option_cell(value: str) -> str:
    return f'{{"state":"answered","value":{{"kind":"single_choice","optionKey":"{value}","label":"{value}"}}}}'


def flags_cell(*keys: str) -> str:
    listed = ",".join(f'"{k}"' for k in keys)
    return f'{{"state":"answered","value":{{"kind":"multi_choice","optionKeys":[{listed}],"labels":[{listed}]}}}}'


FLAG_SETS = (("A",), ("N",), ("R",), ("A", "N"), ("A", "R"), ("N", "R"), ("A", "N", "R"))
HEAVY_CELLS = frozenset(text_cell(v) for v in HEAVY)
A_CELLS = frozenset(flags_cell(*s) for s in FLAG_SETS if "A" in s)
ELIG_SQL = "CASE WHEN q_flags_state IN ('answered', 'skipped') THEN 1 ELSE 0 END"
HEAVY_SQL = "CASE WHEN q_segment IN ('MACHINERY', 'BUILDING') THEN 1 ELSE 0 END"
HAS_A_SQL = "CASE WHEN q_flags_state = 'answered' AND has_a = 1 THEN 1 ELSE 0 END"


@query("flt02", S + f"""SELECT form_id, CAST(sum({ELIG_SQL}) AS BIGINT) AS eligible, count(*) AS responses FROM survey GROUP BY 1""")
def eligible_predicate(spark, sf_dir):
    return flat(spark, sf_dir).groupBy("form_id").agg(
        F.sum(SL.cell_eligible(c("q_q_flags")).cast("int")).alias("eligible"), F.count(F.lit(1)).alias("responses")
    )


@query("flt03", S + f"SELECT response_id, {HEAVY_SQL} AS member FROM survey")
def categorical_membership(spark, sf_dir):
    return flat(spark, sf_dir).select("response_id", V.membership("q_q_segment", HEAVY_CELLS).alias("member"))


@query("flt04", S + f"SELECT response_id, {HAS_A_SQL} AS member FROM survey")
def count_membership(spark, sf_dir):
    den, num = V.vectors(V.CountTarget("n", "q_q_flags", A_CELLS, 0))
    return flat(spark, sf_dir).select("response_id", num.alias("member"))


@query("flt05", S + f"SELECT response_id, {ELIG_SQL} AS eligible, {ELIG_SQL} * {HAS_A_SQL} AS member FROM survey")
def share_vectors(spark, sf_dir):
    den, num = V.vectors(V.ShareTarget("s", "q_q_flags", A_CELLS, 0.5))
    return flat(spark, sf_dir).select("response_id", den.alias("eligible"), num.alias("member"))


@query("flt06", S + f"""SELECT response_id, {HEAVY_SQL} * {ELIG_SQL} AS population,
   {HEAVY_SQL} * {ELIG_SQL} * {HAS_A_SQL} AS member FROM survey""")
def conditional_vectors(spark, sf_dir):
    den, num = V.vectors(V.ConditionalTarget("c", "q_q_segment", HEAVY_CELLS, "q_q_flags", A_CELLS, 0.5))
    return flat(spark, sf_dir).select("response_id", den.alias("population"), num.alias("member"))


@query("flt07", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS score, 1 AS answered FROM events")
def mean_vectors(spark, sf_dir):
    events = field.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    den, num = V.vectors(V.MeanTarget("m", "k", 3.0, 0, 100))
    return events.select("event_id", num.alias("score"), den.alias("answered"))


@query("flt08", """SELECT event_id, coalesce(abs(value - round_even(value, 0)) <= 1e-9 AND round_even(value, 0) BETWEEN 1 AND 5, FALSE) AS valid FROM events""")
def ordinal_validity(spark, sf_dir):
    return field.table(spark, sf_dir, "events").select(
        "event_id", Q.valid_score(c("value"), F.lit(1), F.lit(5)).alias("valid")
    )


@query("flt09", """SELECT form_id, count(*) FILTER (WHERE NOT ok) AS violations, CAST(sum(CASE WHEN ok THEN p_size END) AS BIGINT) AS score_sum
 FROM (SELECT p_brand AS form_id, p_size, p_size BETWEEN 1 AND 40 AS ok FROM part) GROUP BY 1""")
def score_cast(spark, sf_dir):
    ok = Q.valid_score(c("p_size").cast("double"), F.lit(1), F.lit(40))
    parts = field.table(spark, sf_dir, "part").select(c("p_brand").alias("form_id"), "p_size", ok.alias("ok"))
    return parts.groupBy("form_id").agg(
        F.count_if(~c("ok")).alias("violations"), F.sum(F.when(c("ok"), c("p_size").cast("int"))).alias("score_sum")
    )


@query("flt10", """SELECT event_type, count(*) FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') AS valid, count(*) AS rows
 FROM events GROUP BY 1""")
def timestamp_validity(spark, sf_dir):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    ts = F.try_to_timestamp(text)
    valid = D.valid_time(ts, F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return field.table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count_if(valid).alias("valid"), F.count(F.lit(1)).alias("rows")
    )


@query("flt11", """SELECT p_partkey FROM part WHERE p_type IN (SELECT DISTINCT p_type FROM part WHERE p_size < 3)
   AND p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_size < 3)""")
def domain_validity(spark, sf_dir):
    """Allowed values are what the small parts show; every row must stay inside them."""
    part = field.table(spark, sf_dir, "part")
    allowed = part.where(c("p_size") < 3)
    return D.in_domains(part, {x: allowed for x in ("p_type", "p_brand")}).select("p_partkey")


@query("flt12", """WITH d AS (SELECT lang, source, CASE WHEN lang <> 'fr' THEN lang END AS gaps, n_chars AS number FROM documents)
 SELECT 'lang' AS "column", count(*) AS rows, count(*) FILTER (WHERE lang IS NULL) AS nulls, count(*) = count(lang) AS valid FROM d
 UNION ALL SELECT 'source', count(*), count(*) FILTER (WHERE source IS NULL), count(*) = count(source) FROM d
 UNION ALL SELECT 'gaps', count(*), count(*) FILTER (WHERE gaps IS NULL), count(*) = count(gaps) FROM d
 UNION ALL SELECT 'number', count(*), count(*) FILTER (WHERE number IS NULL), FALSE FROM d""")
def categorical_source_check(spark, sf_dir):
    """Text without gaps may be modelled as a category; a column with nulls or numbers may not."""
    rows = field.table(spark, sf_dir, "documents").select(
        "lang", "source", F.when(c("lang") != "fr", c("lang")).alias("gaps"), c("n_chars").alias("number")
    )
    return D.category_check(rows, ["lang", "source", "gaps", "number"])


@query("flt14", S + """SELECT response_id, q_flags_state = 'answered' AS answered, q_status = 'P' AS holds_option FROM survey""")
def answered_predicates(spark, sf_dir):
    return flat(spark, sf_dir).select(
        "response_id", SL.cell_answered(c("q_q_flags")).alias("answered"),
        SL.cell_answered_option(c("q_q_status"), "P").alias("holds_option"),
    )


@query("flt16", S + """SELECT response_id, CAST(q_score AS DOUBLE) AS score, CAST(6 - q_score AS DOUBLE) AS likert_score FROM survey""")
def score_projection(spark, sf_dir):
    return flat(spark, sf_dir).select(
        "response_id", c("score_q_score").alias("score"), c("score_q_priority").alias("likert_score")
    )


@query("flt17", S + "SELECT submitted_at::VARCHAR AS submitted_at, q_status, q_score, q_priority, q_segment FROM survey")
def model_frame(spark, sf_dir):
    wide = field.survey(spark, sf_dir).drop("response_id")
    return wide.select(
        F.date_format("submitted_at", "yyyy-MM-dd HH:mm:ss").alias("submitted_at"), "q_status", "q_score", "q_priority", "q_segment"
    )


@query("flt19", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the')")
def raw_value_search(spark, sf_dir):
    return field.table(spark, sf_dir, "documents").where(F.lower("text").contains("the")).select("doc_id", "lang")


# Parsers: raw strings taken from the tables, well-formed and malformed.
@query("scl01", r"""SELECT conv, event_id, CASE WHEN ok THEN CAST(raw AS BIGINT) END AS value, NOT ok AS rejected FROM (
  SELECT *, coalesce(regexp_full_match(raw, '-?[0-9]+') AND TRY_CAST(raw AS BIGINT) BETWEEN 1 AND 60, FALSE) AS ok FROM (
   SELECT event_id, 'int' AS conv, json_extract_string(props, '$.k') AS raw FROM events
   UNION ALL SELECT event_id, 'float', json_extract_string(props, '$.k') || '.0' FROM events
   UNION ALL SELECT event_id, 'negative', '-' || json_extract_string(props, '$.k') FROM events
   UNION ALL SELECT event_id, 'padded', ' ' || json_extract_string(props, '$.k') FROM events
   UNION ALL SELECT event_id, 'newline', json_extract_string(props, '$.k') || chr(10) FROM events))""")
def ordinal_parse(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    raws = F.array(
        F.struct(F.lit("int").alias("conv"), k.alias("raw")),
        F.struct(F.lit("float").alias("conv"), F.concat(k, F.lit(".0")).alias("raw")),
        F.struct(F.lit("negative").alias("conv"), F.concat(F.lit("-"), k).alias("raw")),
        F.struct(F.lit("padded").alias("conv"), F.concat(F.lit(" "), k).alias("raw")),
        F.struct(F.lit("newline").alias("conv"), F.concat(k, F.lit("\n")).alias("raw")),
    )
    rows = field.table(spark, sf_dir, "events").select("event_id", F.inline(raws))
    parsed = rows.withColumn("p", Q.parse_ordinal(c("raw"), F.lit(1), F.lit(60)))
    return parsed.select("conv", "event_id", c("p.value").alias("value"), c("p.error").isNotNull().alias("rejected"))


@query("scl02", """SELECT p_partkey, TRY_CAST(printf('%04d-%02d-%02d', y, m, d) AS DATE) IS NOT NULL AS valid FROM (
   SELECT p_partkey, CAST(1896 + p_size AS INTEGER) AS y, CAST(p_partkey % 14 AS INTEGER) AS m, CAST(27 + p_size % 6 AS INTEGER) AS d FROM part)""")
def calendar_dates(spark, sf_dir):
    y, m, d = c("p_size") + 1896, (c("p_partkey") % 14).cast("int"), F.lit(27) + c("p_size") % 6
    return field.table(spark, sf_dir, "part").select("p_partkey", Q.valid_calendar_date(y, m, d).alias("valid"))


@query("scl03", """SELECT o_orderkey, shape, CASE WHEN ok THEN raw END AS value, NOT ok AS rejected FROM (
  SELECT o_orderkey, 'ymd' AS shape, CAST(o_orderdate AS DATE)::VARCHAR AS raw, TRUE AS ok FROM orders
  UNION ALL SELECT o_orderkey, 'newline', CAST(o_orderdate AS DATE)::VARCHAR || chr(10), FALSE FROM orders
  UNION ALL SELECT o_orderkey, 'ymdhm', strftime(o_orderdate, '%Y-%m-%d') || ' 24:00', FALSE FROM orders
  UNION ALL SELECT o_orderkey, 'md', strftime(o_orderdate, '%m-%d'), TRUE FROM orders
  UNION ALL SELECT o_orderkey, 'mdhm', strftime(o_orderdate, '%m') || '-31 23:59', strftime(o_orderdate, '%m') IN ('01', '03', '05', '07', '08', '10', '12') FROM orders)""")
def date_answers(spark, sf_dir):
    shape = lambda name, raw, year, time: F.struct(
        F.lit(name).alias("shape"), raw.alias("raw"), F.lit(year).alias("year"), F.lit(time).alias("time")
    )
    day = c("o_orderdate")
    rows = field.table(spark, sf_dir, "orders").select("o_orderkey", F.inline(F.array(
        shape("ymd", F.date_format(day, "yyyy-MM-dd"), True, False),
        shape("newline", F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("\n")), True, False),
        shape("ymdhm", F.date_format(day, "yyyy-MM-dd' 24:00'"), True, True),
        shape("md", F.date_format(day, "MM-dd"), False, False),
        shape("mdhm", F.concat(F.date_format(day, "MM"), F.lit("-31 23:59")), False, True),
    )))
    parsed = rows.withColumn("p", Q.parse_date(c("raw"), c("year"), c("time")))
    return parsed.select("o_orderkey", "shape", c("p.value").alias("value"), c("p.error").isNotNull().alias("rejected"))


@query("scl04", """SELECT p_partkey, duration, newline, CASE WHEN ok THEN raw END AS value, NOT ok AS rejected FROM (
   SELECT p_partkey, duration, newline, printf('%02d:%02d', p_size, m) AS raw, NOT newline AND m <= 59 AND (duration OR p_size <= 23) AS ok FROM (
    SELECT p_partkey, unnest([TRUE, TRUE, FALSE, FALSE]) AS newline, CAST(p_size AS INTEGER) AS p_size, CAST(p_partkey % 70 AS INTEGER) AS m, unnest([TRUE, FALSE, TRUE, FALSE]) AS duration FROM part))""")
def time_answers(spark, sf_dir):
    raw = F.format_string("%02d:%02d", c("p_size"), (c("p_partkey") % 70).cast("int"))
    rows = field.table(spark, sf_dir, "part").select(
        "p_partkey", raw.alias("raw"), F.inline(F.array(*[
            F.struct(F.lit(d).alias("duration"), F.lit(n).alias("newline")) for n in (True, False) for d in (True, False)
        ]))
    ).withColumn("raw", F.when(c("newline"), F.concat("raw", F.lit("\n"))).otherwise(c("raw")))
    parsed = rows.withColumn("p", Q.parse_time(c("raw"), c("duration")))
    return parsed.select("p_partkey", "duration", "newline", c("p.value").alias("value"), c("p.error").isNotNull().alias("rejected"))


# Likert: each customer's form asks one agreement question whose labels come in one of the scales.
def _likert_labels(spark, sf_dir):
    """customer -> five option labels; a customer in debt has one label the scale does not know."""
    scales = F.array(*[F.array(*[F.lit(x) for x in scale]) for scale in L.LIKERT_SCALES])
    labels = F.transform(
        F.element_at(scales, (c("c_nationkey") % 4 + 1).cast("int")),
        lambda x, i: F.struct(
            F.concat(F.lit("o"), i).alias("option_key"), (F.lit(5) - i).alias("score"),
            F.when((c("c_acctbal") < 0) & (i == 2), F.concat(x, F.lit("?")))
            .otherwise(F.upper(F.concat(F.lit("  "), F.replace(x, F.lit(" "), F.lit("   "))))).alias("label"),
        ),
    )
    return field.table(spark, sf_dir, "customer").select(c("c_custkey").alias("form_id"), F.inline(labels))


@query("scl09", "SELECT c_custkey AS form_id, CAST(c_nationkey % 4 AS INTEGER) AS scale FROM customer WHERE c_acctbal >= 0")
def recognised_likert(spark, sf_dir):
    key = L.likert_label(c("label"))
    matches = F.array(*[
        F.when(L.likert_score_of(key, i) == c("score"), F.lit(i)) for i in range(len(L.LIKERT_SCALES))
    ])
    return (
        _likert_labels(spark, sf_dir).select("form_id", F.explode(matches).alias("scale"))
        .where(c("scale").isNotNull()).groupBy("form_id", "scale").agg(F.count(F.lit(1)).alias("n"))
        .where(c("n") == 5).select("form_id", "scale")
    )


@query("scl10", """SELECT c_custkey AS form_id, n_scores = 5 AS bijection FROM (SELECT c_custkey, count(DISTINCT s) AS n_scores FROM (
   SELECT c_custkey, unnest([5, 4, 3, 2, CASE WHEN c_acctbal < 2000 THEN 2 ELSE 1 END]) AS s FROM customer) GROUP BY 1)""")
def likert_bounds(spark, sf_dir):
    """A mapping is usable when five keys carry the five scores 1..5.

    A form's rows come together first and its few keys and scores are gathered once, so that a task holds its
    share of the forms; both sides of the join have a row or more per form, so neither is broadcast.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    short = field.table(spark, sf_dir, "customer").where(c("c_acctbal") < 2000).select(
        c("c_custkey").alias("form_id"), F.lit(True).alias("repeats")
    )
    mapping = _likert_labels(spark, sf_dir).repartition(parts, "form_id").join(short.hint("merge"), "form_id", "left").withColumn(
        "score", F.when(c("repeats") & (c("score") == 1), 2).otherwise(c("score"))
    )
    return mapping.groupBy("form_id").agg(
        (
            (F.size(F.collect_set("option_key")) == 5) & (F.size(F.collect_set("score")) == 5)
            & (F.min("score") == 1) & (F.max("score") == 5)
        ).alias("bijection")
    )


@query("scl14", r"""SELECT doc_id, md5(CASE WHEN regexp_matches(text, '^[\s\x00-\x1f]*[=+\-@]') THEN '''' || text ELSE text END) AS safe_md5 FROM documents""")
def spreadsheet_safety(spark, sf_dir):
    return field.table(spark, sf_dir, "documents").select("doc_id", F.md5(L.spreadsheet_safe(c("text"))).alias("safe_md5"))


@query("scl16", S + """SELECT response_id, CASE WHEN q_flags_state = 'answered' THEN
   '{"state":"answered","value":{"kind":"multi_choice","optionKeys":' || k || ',"labels":' || k || '}}'
   ELSE '{"state":"' || q_flags_state || '"}' END AS cell FROM (SELECT response_id, q_flags_state,
     CAST(to_json(""" + FLAGS_SQL + """) AS VARCHAR) AS k FROM survey)""")
def canonical_cells(spark, sf_dir):
    return flat(spark, sf_dir).select("response_id", c("q_q_flags").alias("cell"))


@query("scl17", S + "SELECT response_id, q_flags_state = 'answered' AS backed FROM survey")
def schema_backed(spark, sf_dir):
    return flat(spark, sf_dir).select("response_id", SL.cell_schema_backed(c("q_q_flags")).alias("backed"))


@query("scl18", """SELECT event_id, 'slot' AS source, event_type IN ('click', 'view') AS valid FROM events
 UNION ALL SELECT event_id, 'props', FALSE FROM events""")
def generated_slots(spark, sf_dir):
    state = F.when(c("event_type") == "click", "answered").when(c("event_type") == "view", "skipped").otherwise(c("event_type"))
    cells = F.array(
        F.struct(F.lit("slot").alias("source"), F.to_json(F.struct(state.alias("state"))).alias("cell")),
        F.struct(F.lit("props").alias("source"), c("props").alias("cell")),
    )
    return field.table(spark, sf_dir, "events").select("event_id", F.inline(cells)).select(
        "event_id", "source", SL.cell_valid(c("cell")).alias("valid")
    )


@query("src15", S + """SELECT response_id, CAST(q_score AS DOUBLE) AS score_q_score, CAST(6 - q_score AS DOUBLE) AS score_q_priority,
   '{"state":"answered","value":{"kind":"single_choice","optionKey":"' || q_status || '","label":"' || q_status || '"}}' AS q_q_status,
   '{"state":"answered","value":{"kind":"text","text":"' || q_segment || '"}}' AS q_q_segment FROM survey""")
def flat_writer(spark, sf_dir):
    return flat(spark, sf_dir).select("response_id", "score_q_score", "score_q_priority", "q_q_status", "q_q_segment")


# Value groups.
def _slots(spark, sf_dir):
    return explode_slots(field.responses(spark, sf_dir))


VALUES_SQL = """observed AS (SELECT form_id, question_id, kind, CASE WHEN kind = 'text' THEN text ELSE option_key END AS value, count(*) AS n
   FROM slots WHERE kind IN ('single_choice', 'text') AND state = 'answered' GROUP BY 1, 2, 3, 4),
 vals AS (SELECT o.form_id, o.question_id, o.option_key AS value, o.option_key AS label, coalesce(b.n, 0) AS count, o.ord AS position
   FROM options o LEFT JOIN observed b ON b.form_id = o.form_id AND b.question_id = o.question_id AND b.value = o.option_key
   WHERE o.question_id IN ('q_status', 'q_priority')
  UNION ALL SELECT form_id, question_id, value, value, n, NULL FROM observed WHERE kind = 'text')"""
VB = BASE_SQL.rstrip() + ", " + VALUES_SQL


def values(spark, sf_dir):
    return G.observed_values(_slots(spark, sf_dir), field.options(spark, sf_dir), field.questions(spark, sf_dir))


@query("agg09", VB + " SELECT * FROM vals")
def observed_values(spark, sf_dir):
    return values(spark, sf_dir)


@query("agg11", BASE_SQL + """SELECT f.form_id, coalesce(r.n, 0) AS responses, q.n AS questions, q.unsupported FROM forms f
  LEFT JOIN (SELECT form_id, count(*) AS n FROM survey GROUP BY 1) r ON r.form_id = f.form_id
  JOIN (SELECT form_id, count(*) AS n, count(*) FILTER (WHERE kind = 'unsupported') AS unsupported FROM questions GROUP BY 1) q ON q.form_id = f.form_id""")
def revision_summary(spark, sf_dir):
    counts = field.survey(spark, sf_dir).groupBy("form_id").agg(F.count(F.lit(1)).alias("n"))
    dims = field.questions(spark, sf_dir).groupBy("form_id").agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(c("kind") == "unsupported").alias("unsupported")
    )
    return dims.join(counts, "form_id", "left").select(
        "form_id", F.coalesce("n", F.lit(0)).alias("responses"), "questions", "unsupported"
    )


@query("agg29", S + "SELECT q_status, q_priority, count(*) AS n FROM survey GROUP BY 1, 2")
def value_weights(spark, sf_dir):
    return field.survey(spark, sf_dir).groupBy("q_status", "q_priority").agg(F.count(F.lit(1)).alias("n"))


@query("src20", VB + """, named AS (SELECT form_id, group_id, question_id, trim('  ' || group_id || ' ') AS name, count(DISTINCT member) AS members FROM members GROUP BY 1, 2, 3),
  unknown AS (SELECT m.form_id, m.group_id, count(*) AS n FROM (SELECT DISTINCT form_id, group_id, question_id, member FROM members) m
    WHERE NOT EXISTS (SELECT 1 FROM vals v WHERE v.form_id = m.form_id AND v.question_id = m.question_id AND v.value = m.member) GROUP BY 1, 2)
 SELECT n.form_id, n.group_id, n.name, n.members, coalesce(u.n, 0) AS unknown_members FROM named n LEFT JOIN unknown u ON u.form_id = n.form_id AND u.group_id = n.group_id""")
def value_group_table(spark, sf_dir):
    raw = field.members(spark, sf_dir).groupBy("form_id", "group_id", "question_id").agg(
        F.concat(F.collect_list("member"), F.collect_list("member"), F.array(F.lit(""))).alias("members")
    ).withColumn("name", F.concat(F.lit("  "), "group_id", F.lit(" ")))
    groups = G.clean_groups(raw).where(c("error").isNull())
    members = groups.select("form_id", "group_id", "question_id", F.explode("members").alias("member"))
    unknown = G.unknown_members(members, values(spark, sf_dir)).groupBy("form_id", "group_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return groups.join(unknown, ["form_id", "group_id"], "left").select(
        "form_id", "group_id", "name", F.size("members").alias("members"), F.coalesce("n", F.lit(0)).alias("unknown_members")
    )


TEXT_CELL_SQL = """'{"state":"answered","value":{"kind":"text","text":"' || v || '"}}'"""
OPTION_CELL_SQL = """'{"state":"answered","value":{"kind":"single_choice","optionKey":"' || v || '","label":"' || v || '"}}'"""


@query("join06", BASE_SQL + f"""SELECT DISTINCT m.form_id, m.group_id, m.question_id, CASE WHEN m.question_id = 'q_segment' THEN {TEXT_CELL_SQL} ELSE {OPTION_CELL_SQL} END AS cell
  FROM (SELECT form_id, group_id, question_id, member AS v FROM members) m
  WHERE m.question_id = 'q_status' OR EXISTS (SELECT 1 FROM survey s WHERE s.form_id = m.form_id AND s.q_segment = m.v)""")
def group_member_cells(spark, sf_dir):
    return G.group_member_cells(_slots(spark, sf_dir), field.members(spark, sf_dir), field.options(spark, sf_dir))


CELLS_SQL = """cells AS (SELECT DISTINCT form_id, question_id, unnest(option_keys) AS option_key,
   '{"state":"answered","value":{"kind":"multi_choice","optionKeys":' || CAST(to_json(option_keys) AS VARCHAR) || ',"labels":' || CAST(to_json(option_keys) AS VARCHAR) || '}}' AS cell
  FROM slots WHERE kind = 'multi_choice' AND state = 'answered')"""


@query("join07", BASE_SQL.rstrip() + ", " + CELLS_SQL + " SELECT * FROM cells")
def option_cells(spark, sf_dir):
    return G.option_cells(_slots(spark, sf_dir))


@query("tgt09", BASE_SQL.rstrip() + ", " + CELLS_SQL + """ SELECT o.form_id, o.question_id, o.option_key, c.cell IS NULL AS schema_backed,
   coalesce(c.cell, '{"state":"answered","value":{"kind":"multi_choice","optionKeys":["' || o.option_key || '"],"labels":["' || o.option_key || '"]}}') AS cell
  FROM options o LEFT JOIN cells c ON c.form_id = o.form_id AND c.question_id = o.question_id AND c.option_key = o.option_key WHERE o.question_id = 'q_flags'""")
def option_support(spark, sf_dir):
    return G.option_support(_slots(spark, sf_dir), field.options(spark, sf_dir).where(c("question_id") == "q_flags"))


@query("set06", BASE_SQL + """SELECT form_id, question_id, count(*) AS cells FROM (
   SELECT DISTINCT form_id, question_id, option_key, option_keys, score, text FROM slots WHERE state = 'answered') GROUP BY 1, 2""")
def distinct_cells(spark, sf_dir):
    return G.observed_cells(_slots(spark, sf_dir)).groupBy("form_id", "question_id").agg(F.count(F.lit(1)).alias("cells"))


@query("join14", BASE_SQL + """SELECT DISTINCT m.form_id, m.group_id, m.question_id FROM members m
  WHERE m.question_id = 'q_status' AND m.member NOT IN ('F', 'O')""")
def invalid_groups(spark, sf_dir):
    refreshed = field.options(spark, sf_dir).where((c("question_id") != "q_status") | c("option_key").isin("F", "O"))
    return G.invalid_groups(field.members(spark, sf_dir), field.questions(spark, sf_dir), refreshed)


@query("join15", """WITH m AS (SELECT DISTINCT o_custkey AS group_id, o_orderpriority AS member FROM orders),
 p AS (SELECT member, count(*) AS n FROM m GROUP BY 1),
 pair AS (SELECT DISTINCT a.group_id, b.group_id AS other FROM m a JOIN m b ON a.member = b.member AND a.group_id <> b.group_id)
 SELECT 'priorities' AS form_id, m.group_id, (SELECT count(*) FROM pair x WHERE x.group_id = m.group_id) AS overlapping_groups
 FROM (SELECT DISTINCT group_id FROM m) m""")
def group_overlaps(spark, sf_dir):
    members = field.table(spark, sf_dir, "orders").select(
        F.lit("priorities").alias("form_id"), F.lit("q_priority").alias("question_id"),
        c("o_custkey").alias("group_id"), c("o_orderpriority").alias("member"),
    )
    return G.group_overlaps(members).select("form_id", "group_id", "overlapping_groups")


@query("sort02", """SELECT 'documents' AS form_id, source AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, source) AS rank FROM documents GROUP BY source""")
def text_values_by_frequency(spark, sf_dir):
    return G.ranked_values(_source_values(spark, sf_dir)).select("form_id", "value", "count", "rank")


def _source_values(spark, sf_dir):
    slots = field.table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("form_id"), F.lit("q_source").alias("question_id"), F.lit("text").alias("kind"),
        F.lit("answered").alias("state"), F.lit(None).cast("string").alias("option_key"), c("source").alias("text"),
    )
    return G.observed_counts(slots)


@query("sort03", """SELECT value, count, rank, n > 8 AS has_more FROM (SELECT source AS value, count(*) AS count,
   row_number() OVER (ORDER BY count(*) DESC, source) AS rank, count(*) OVER () AS n FROM documents GROUP BY source) WHERE rank <= 8""")
def first_value_page(spark, sf_dir):
    return G.value_page(_source_values(spark, sf_dir), size=8).select("value", "count", "rank", "has_more")


@query("set04", BASE_SQL + """SELECT o.form_id, o.question_id, o.option_key FROM options o WHERE NOT EXISTS (
   SELECT 1 FROM picks p WHERE p.form_id = o.form_id AND p.question_id = o.question_id AND p.option_key = o.option_key)""")
def schema_only_members(spark, sf_dir):
    seen = P.question_rows(_slots(spark, sf_dir)).select(
        "form_id", "question_id", F.explode(F.map_keys("option_counts")).alias("option_key")
    )
    return field.options(spark, sf_dir).select("form_id", "question_id", "option_key").join(
        seen, ["form_id", "question_id", "option_key"], "left_anti"
    )


@query("set07", VB + """ SELECT DISTINCT g.form_id, g.group_id, v.value FROM (SELECT DISTINCT form_id, group_id, question_id FROM members) g
  JOIN vals v ON v.form_id = g.form_id AND v.question_id = g.question_id WHERE v.count > 0 AND NOT EXISTS (
   SELECT 1 FROM members m WHERE m.form_id = g.form_id AND m.group_id = g.group_id AND m.member = v.value)""")
def non_member_support(spark, sf_dir):
    m = field.members(spark, sf_dir)
    observed = values(spark, sf_dir).where(c("count") > 0).select("form_id", "question_id", "value")
    return (
        m.select("form_id", "group_id", "question_id").distinct().join(observed, ["form_id", "question_id"])
        .join(m.withColumnRenamed("member", "value"), ["form_id", "group_id", "question_id", "value"], "left_anti")
        .select("form_id", "group_id", "value")
    )


@query("flt13", S + """SELECT response_id FROM survey WHERE NOT (q_status = 'P' AND (q_score >= 4 OR q_priority = '2-HIGH'))""")
def routing_rule_filter(spark, sf_dir):
    """Status P must leave the score and the priority empty; here low scores count as empty."""
    from canvass.plans.pool import RoutingRule, drop_misrouted

    rows = flat(spark, sf_dir)
    emptied = rows.withColumn("score_q_score", F.when(c("score_q_score") >= 4, c("score_q_score"))).withColumn(
        "q_q_priority", F.when(SL.cell_answered_option(c("q_q_priority"), "2-HIGH"), c("q_q_priority"))
        .otherwise(F.lit('{"state":"not_reached"}')),
    )
    rule = RoutingRule("q_q_status", "P", forbidden=(("score_q_score", "ordinal"), ("q_q_priority", "answer_slot")))
    return drop_misrouted(emptied, [rule]).select("response_id")
