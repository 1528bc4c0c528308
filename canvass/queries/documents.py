"""Landed form documents: every customer owns a form whose items are the customer's orders.

Priority decides the item (choice, scale/rating/file, page break, text/date/time, grid),
status its variant, and the order's lines are its options or grid rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.operators import export as X
from canvass.queries import field
from canvass.queries.registry import query
from canvass.sources import forms as SF

c = F.col


def landed_forms(spark, sf_dir):
    lines = field.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus"
        ))).alias("lines")
    )
    orders = field.table(spark, sf_dir, "orders").join(lines, c("o_orderkey") == c("l_orderkey"), "left")
    breaks = field.table(spark, sf_dir, "orders").where(c("o_orderpriority") == "3-MEDIUM").groupBy("o_custkey").agg(
        F.min("o_orderkey").alias("first_break")
    )
    priority, status = c("o_orderpriority"), c("o_orderstatus")
    own_lines = F.coalesce("lines", F.array())
    other = lambda x: (x["l_returnflag"] == "N") & (x["l_linestatus"] == "O")
    jump = F.coalesce(F.concat(F.lit("i"), c("first_break")), F.lit("nowhere"))
    choice_options = F.transform(own_lines, lambda x: F.struct(
        F.when(~other(x), F.concat(x["l_returnflag"], x["l_linestatus"])).alias("value"),
        F.when(other(x), F.lit(True)).alias("isOther"),
        F.when(x["l_linestatus"] == "F", F.when(x["l_returnflag"] == "A", "NEXT_SECTION")
               .when(x["l_returnflag"] == "N", "SUBMIT_FORM").otherwise("JUMP")).alias("goToAction"),
        F.when((x["l_linestatus"] == "O") & (x["l_returnflag"] == "R"), jump).alias("goToSectionId"),
    ))
    pick = lambda f, o, p: F.when(status == "F", f).when(status == "O", o).otherwise(p)
    is_kind = lambda digit, stat: (F.substring(priority, 1, 1) == digit) & (status == stat)
    qid = F.concat(F.lit("q"), c("o_orderkey"))
    question = F.struct(
        qid.alias("questionId"), (status == "F").alias("required"),
        F.when(F.substring(priority, 1, 1) == "1", F.struct(
            pick(F.lit("RADIO"), F.lit("CHECKBOX"), F.lit("DROP_DOWN")).alias("type"), choice_options.alias("options")
        )).alias("choiceQuestion"),
        F.when(is_kind("4", "F"), F.struct(F.lit(True).alias("paragraph"))).alias("textQuestion"),
        F.when(is_kind("2", "F"), F.struct(F.lit(1).alias("low"), (c("o_orderkey") % 7 + 3).cast("int").alias("high"))).alias("scaleQuestion"),
        F.when(is_kind("4", "O"), F.struct(F.lit(True).alias("includeTime"))).alias("dateQuestion"),
        F.when(is_kind("4", "P"), F.struct(F.lit(True).alias("duration"))).alias("timeQuestion"),
        F.when(is_kind("2", "P"), F.struct(F.array(F.lit("pdf")).alias("types"))).alias("fileUploadQuestion"),
        F.when(is_kind("2", "O"), F.struct(
            F.lit(5).alias("ratingScaleLevel"), F.when(c("o_custkey") % 2 == 0, "STAR").otherwise("MOON").alias("iconType")
        )).alias("ratingQuestion"),
    )
    grid = F.struct(
        F.transform(own_lines, lambda x, i: F.struct(
            F.concat_ws("-", qid, i).alias("questionId"),
            F.struct(F.concat(F.lit("line "), x["l_linenumber"]).alias("title")).alias("rowQuestion"),
        )).alias("questions"),
        F.struct(F.struct(
            pick(F.lit("RADIO"), F.lit("CHECKBOX"), F.lit("MATRIX")).alias("type"),
            F.array(*[F.struct(F.lit(v).alias("value")) for v in ("A", "N", "R")]).alias("options"),
        ).alias("columns")).alias("grid"),
    )
    digit = F.substring(priority, 1, 1)
    item = F.struct(
        c("o_orderkey").alias("pos"),
        F.struct(
            F.concat(F.lit("i"), c("o_orderkey")).alias("itemId"), priority.alias("title"),
            F.when(digit == "3", F.struct(F.lit(None).cast("string").alias("_"))).alias("pageBreakItem"),
            F.when(digit.isin("1", "2", "4"), F.struct(question.alias("question"))).alias("questionItem"),
            F.when(digit == "5", grid).alias("questionGroupItem"),
        ).alias("item"),
    )
    return (
        orders.join(breaks, "o_custkey", "left").groupBy("o_custkey").agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct(item["pos"].alias("pos"), F.to_json(item["item"]).alias("item")))),
                lambda x: x["item"],
            ).alias("items")
        )
        # Items are already JSON text, so the document is put together as text.
        .select(F.concat(
            F.lit('{"formId":"c'), c("o_custkey"), F.lit('","info":{"title":"Customer '), c("o_custkey"),
            F.lit('"},"items":['), F.array_join("items", ","), F.lit("]}"),
        ).alias("payload"))
    )


DOC_SQL = """WITH ln AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus) - 1 AS idx FROM lineitem),
 it AS (SELECT 'c' || o_custkey AS form_id, o_orderkey AS k, o_custkey AS cust, o_orderstatus AS st, substr(o_orderpriority, 1, 1) AS d, o_orderpriority AS title,
    CAST(sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS section_ord,
    coalesce('i' || min(CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_orderkey END) OVER (PARTITION BY o_custkey), 'nowhere') AS jump FROM orders),
 sec AS (SELECT DISTINCT form_id, '__entry__' AS section_id, '' AS title, 0 AS ord FROM it UNION ALL SELECT form_id, 'i' || k, title, section_ord FROM it WHERE d = '3'),
 qs0 AS (SELECT form_id, k, -1 AS r, 'q' || k AS question_id, section_ord, title, st = 'F' AS required, CAST(NULL AS VARCHAR) AS group_id,
     CASE d || st WHEN '1F' THEN 'single_choice' WHEN '1O' THEN 'multi_choice' WHEN '1P' THEN 'single_choice' WHEN '2F' THEN 'ordinal'
       WHEN '2O' THEN CASE WHEN cust % 2 = 0 THEN 'ordinal' ELSE 'unsupported' END WHEN '2P' THEN 'file' WHEN '4F' THEN 'text' WHEN '4O' THEN 'date' ELSE 'time' END AS kind,
     CASE WHEN d || st = '2F' THEN k % 7 + 3 WHEN d || st = '2O' AND cust % 2 = 0 THEN 5 END AS max FROM it WHERE d IN ('1', '2', '4')
   UNION ALL SELECT it.form_id, it.k, ln.idx, 'q' || it.k || '-' || ln.idx, it.section_ord, 'line ' || ln.l_linenumber, FALSE, 'i' || it.k,
     CASE it.st WHEN 'F' THEN 'single_choice' WHEN 'O' THEN 'multi_choice' ELSE 'unsupported' END, NULL FROM it JOIN ln ON ln.l_orderkey = it.k WHERE it.d = '5'),
 qs AS (SELECT *, CAST(row_number() OVER (PARTITION BY form_id ORDER BY k, r) - 1 AS INTEGER) AS ord FROM qs0),
 op AS (SELECT it.form_id, 'q' || it.k AS question_id, 'option:question:q' || it.k || ':' || ln.idx AS option_key, CAST(ln.idx AS INTEGER) AS ord,
     ln.l_returnflag = 'N' AND ln.l_linestatus = 'O' AS is_other, CASE WHEN ln.l_returnflag = 'N' AND ln.l_linestatus = 'O' THEN 'Other' ELSE ln.l_returnflag || ln.l_linestatus END AS label
    FROM it JOIN ln ON ln.l_orderkey = it.k WHERE it.d = '1'
   UNION ALL SELECT q.form_id, q.question_id, 'option:group:' || q.group_id || ':' || v.i, v.i, FALSE, v.label FROM qs0 q, (VALUES (0, 'A'), (1, 'N'), (2, 'R')) v(i, label) WHERE q.group_id IS NOT NULL),
 cand AS (SELECT it.form_id, 'q' || it.k AS question_id, 'option:question:q' || it.k || ':' || ln.idx AS option_key, it.section_ord AS source_ord,
     CASE WHEN ln.l_linestatus = 'F' THEN CASE ln.l_returnflag WHEN 'A' THEN 'next_section' WHEN 'N' THEN 'submit' END WHEN ln.l_returnflag = 'R' THEN 'section' END AS dest_type,
     CASE WHEN ln.l_linestatus = 'O' AND ln.l_returnflag = 'R' THEN it.jump END AS dest_section_id
    FROM it JOIN ln ON ln.l_orderkey = it.k WHERE it.d = '1' AND it.st <> 'O'),
 tr AS (SELECT cand.*, sec.ord AS dest_ord FROM cand LEFT JOIN sec ON sec.form_id = cand.form_id AND sec.section_id = cand.dest_section_id WHERE dest_type IS NOT NULL)
"""


def _tables(spark, sf_dir):
    return SF.normalise_forms(landed_forms(spark, sf_dir))


@query("src06", DOC_SQL + "SELECT form_id, section_id, title, ord FROM sec")
def sections(spark, sf_dir):
    return SF.build_sections(SF.form_items(landed_forms(spark, sf_dir))).select("form_id", "section_id", "title", "ord")


@query("src07", DOC_SQL + "SELECT form_id, question_id, ord, section_ord, kind, required, CAST(max AS INTEGER) AS max FROM qs")
def question_kinds(spark, sf_dir):
    return SF.build_questions(SF.form_items(landed_forms(spark, sf_dir))).select(
        "form_id", "question_id", "ord", "section_ord", "kind", "required", "max"
    )


@query("src08", DOC_SQL + """SELECT q.form_id, q.group_id, q.question_id, q.title, o.option_key, o.label FROM qs q JOIN op o
  ON o.form_id = q.form_id AND o.question_id = q.question_id WHERE q.group_id IS NOT NULL""")
def grid_rows(spark, sf_dir):
    items = SF.form_items(landed_forms(spark, sf_dir))
    grid = SF.build_questions(items).where(c("group_id").isNotNull())
    return grid.select("form_id", "group_id", "question_id", "title").join(
        SF.build_options(items), ["form_id", "question_id"]
    ).select("form_id", "group_id", "question_id", "title", "option_key", "label")


@query("src09", DOC_SQL + "SELECT form_id, question_id, option_key, label, is_other, ord FROM op")
def option_keys(spark, sf_dir):
    return SF.build_options(SF.form_items(landed_forms(spark, sf_dir)))


@query("src10", DOC_SQL + """SELECT form_id, question_id, option_key, dest_type, dest_section_id, dest_ord,
   CASE WHEN dest_type = 'section' AND dest_ord IS NULL THEN 'unknown_section' END AS error FROM tr""")
def transitions(spark, sf_dir):
    items = SF.form_items(landed_forms(spark, sf_dir))
    return SF.build_transitions(items, SF.build_sections(items)).select(
        "form_id", "question_id", "option_key", "dest_type", "dest_section_id", "dest_ord", "error"
    )


@query("src04", DOC_SQL + """SELECT f.form_id, (SELECT count(*) FROM sec x WHERE x.form_id = f.form_id) AS sections, (SELECT count(*) FROM qs x WHERE x.form_id = f.form_id) AS questions,
   (SELECT count(*) FROM op x WHERE x.form_id = f.form_id) AS options, (SELECT count(*) FROM it x WHERE x.form_id = f.form_id AND d = '5') AS groups,
   (SELECT count(*) FROM tr x WHERE x.form_id = f.form_id AND NOT (dest_type = 'section' AND dest_ord IS NULL)) AS transitions,
   (SELECT count(*) FROM tr x WHERE x.form_id = f.form_id AND dest_type = 'section' AND dest_ord IS NULL) AS errors FROM (SELECT DISTINCT form_id FROM it) f""")
def form_ingest(spark, sf_dir):
    t = _tables(spark, sf_dir)
    names = ("sections", "questions", "options", "groups", "transitions", "errors")
    counts = None
    for name in names:
        tagged = getattr(t, name).select("form_id", F.lit(name).alias("part"))
        counts = tagged if counts is None else counts.unionByName(tagged)
    return counts.groupBy("form_id").agg(*[F.count_if(c("part") == n).alias(n) for n in names])


@query("agg13")
def schema_fingerprints(spark, sf_dir):
    return SF.schema_fingerprint(_tables(spark, sf_dir))


HEADER_SQL = """, hd AS (SELECT form_id, ord, question_id, CASE WHEN group_id IS NOT NULL THEN '5-LOW — ' || title ELSE title END AS header FROM qs)"""


def _headers(spark, sf_dir):
    items = SF.form_items(landed_forms(spark, sf_dir))
    return X.question_headers(SF.build_questions(items), SF.build_groups(items))


@query("scl13", DOC_SQL.rstrip() + HEADER_SQL + " SELECT form_id, question_id, header FROM hd")
def question_headers(spark, sf_dir):
    return _headers(spark, sf_dir).select("form_id", "question_id", "header")


@query("win01", DOC_SQL.rstrip() + HEADER_SQL + f""", al AS (SELECT form_id, ord, question_id, header FROM hd UNION ALL SELECT DISTINCT form_id, -1, NULL, '{X.SUBMITTED_HEADER}' FROM it),
  nm AS (SELECT *, row_number() OVER (PARTITION BY form_id, header ORDER BY ord) AS n FROM al)
 SELECT form_id, question_id, CASE WHEN n = 1 THEN header ELSE header || ' (' || n || ')' END AS header FROM nm
  WHERE form_id IN (SELECT form_id FROM hd) """)
def disambiguated_headers(spark, sf_dir):
    return X.disambiguate(_headers(spark, sf_dir)).select("form_id", "question_id", "header")


@query("join13", DOC_SQL + """SELECT t.form_id, t.target_id, q.title AS question_title, o.label AS option_label,
   CASE WHEN q.question_id IS NULL THEN 'missing_question' WHEN o.option_key IS NULL THEN 'missing_option' END AS problem
  FROM (SELECT 'c' || o_custkey AS form_id, 't' || o_orderkey AS target_id, 'q' || o_orderkey AS question_id, 'option:question:q' || o_orderkey || ':2' AS option_key FROM orders) t
  LEFT JOIN qs q ON q.form_id = t.form_id AND q.question_id = t.question_id
  LEFT JOIN op o ON o.form_id = t.form_id AND o.question_id = t.question_id AND o.option_key = t.option_key""")
def historical_labels(spark, sf_dir):
    """Every order was once the subject of a target on its third option."""
    t = _tables(spark, sf_dir)
    key = F.concat(F.lit("q"), c("o_orderkey"))
    targets = field.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), c("o_custkey")).alias("form_id"), F.concat(F.lit("t"), c("o_orderkey")).alias("target_id"),
        key.alias("question_id"), F.concat(F.lit("option:question:"), key, F.lit(":2")).alias("option_key"),
    )
    return X.target_labels(targets, t.questions, t.options).select(
        "form_id", "target_id", "question_title", "option_label", "problem"
    )
