"""Landed form documents to dimension tables.

One form is one JSON document, so the per-form windows below never see more rows than one
document holds. All tables carry form_id and cover every landed form in one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.schema import FORM_JSON
from canvass.session import materialise

# Entry section id, default label of an "other" option, rating icons.
ENTRY_SECTION = "__entry__"
DEFAULT_OTHER_LABEL = "Other"
RATING_ICONS = {"STAR": "rating_star", "HEART": "rating_heart", "THUMB_UP": "rating_thumb_up"}
DESTINATIONS = {"NEXT_SECTION": "next_section", "SUBMIT_FORM": "submit", "RESTART_FORM": "restart"}


@dataclass(frozen=True)
class FormTables:
    sections: DataFrame
    questions: DataFrame
    options: DataFrame
    groups: DataFrame
    transitions: DataFrame
    errors: DataFrame


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def form_items(raw: DataFrame, json_column: str = "payload") -> DataFrame:
    """One row per item with its position and the order of the section it belongs to.

    A form without items keeps one row without an item; documents that are no form give none
    (:func:`malformed_forms`).
    """
    parsed = raw.select(F.from_json(json_column, FORM_JSON).alias("form")).where(~_malformed())
    items = parsed.select(F.col("form.formId").alias("form_id"), F.posexplode_outer("form.items").alias("pos", "item"))
    is_break = F.col("item.pageBreakItem").isNotNull()
    in_order = Window.partitionBy("form_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return items.withColumn("is_break", is_break).withColumn(
        "section_ord", F.sum(F.col("is_break").cast("int")).over(in_order).cast("int")
    )


def _malformed() -> Column:
    """No form id, or no list of items (an empty list is a form without questions)."""
    return F.coalesce(F.col("form.formId"), F.lit("")).eqNullSafe("") | F.col("form.items").isNull()


def malformed_forms(raw: DataFrame, json_column: str = "payload") -> DataFrame:
    """Documents that are no form: form_id (if it can be read), code, ref (hash of the document)."""
    parsed = raw.select(F.from_json(json_column, FORM_JSON).alias("form"), F.sha2(F.coalesce(F.col(json_column), F.lit("")), 256).alias("ref"))
    return parsed.where(_malformed()).select(F.col("form.formId").alias("form_id"), F.lit("malformed_form").alias("code"), "ref")


def build_sections(items: DataFrame) -> DataFrame:
    """Page breaks open sections after the entry section; ``next_section_id`` is the successor."""
    entry = items.select("form_id").distinct().select(
        "form_id", F.lit(ENTRY_SECTION).alias("section_id"), F.lit("").alias("title"), F.lit(0).alias("ord")
    )
    breaks = items.where("is_break").select(
        "form_id", F.col("item.itemId").alias("section_id"),
        F.coalesce("item.title", F.lit("")).alias("title"), F.col("section_ord").alias("ord"),
    )
    return entry.unionByName(breaks).withColumn(
        "next_section_id", F.lead("section_id").over(Window.partitionBy("form_id").orderBy("ord"))
    )


def _question_rows(items: DataFrame) -> DataFrame:
    """Plain questions and grid rows on one footing, in document order."""
    plain = items.where(F.col("item.questionItem").isNotNull()).select(
        "form_id", "pos", "section_ord", F.lit(0).alias("row"), F.col("item.questionItem.question").alias("q"),
        F.coalesce("item.title", F.lit("")).alias("title"),
        F.lit(None).cast("string").alias("group_id"), F.lit(None).cast("string").alias("grid_type"),
    )
    grid = items.where(F.col("item.questionGroupItem").isNotNull()).select(
        "form_id", "pos", "section_ord", F.posexplode("item.questionGroupItem.questions").alias("row", "q"),
        F.col("item.itemId").alias("group_id"),
        F.col("item.questionGroupItem.grid.columns.type").alias("grid_type"),
    ).withColumn("title", F.coalesce("q.rowQuestion.title", F.lit("")))
    return plain.unionByName(grid)


def question_kind(q: Column, grid_type: Column) -> Column:
    """One of the eight kinds; anything the form model does not know is ``unsupported``."""
    names = ("choice", "text", "scale", "date", "time", "fileUpload", "rating")
    present = sum((q[f"{n}Question"].isNotNull().cast("int") for n in names), F.lit(0))
    choice_type = q["choiceQuestion"]["type"]
    rating_ok = _lookup(RATING_ICONS, F.coalesce(q["ratingQuestion"]["iconType"], F.lit(""))).isNotNull() & (
        q["ratingQuestion"]["ratingScaleLevel"] >= 1
    )
    grid_kind = F.when(q["rowQuestion"].isNull(), "unsupported").when(grid_type == "RADIO", "single_choice").when(
        grid_type == "CHECKBOX", "multi_choice"
    ).otherwise("unsupported")
    plain = (
        F.when(present != 1, "unsupported")
        .when(choice_type.isin("RADIO", "DROP_DOWN"), "single_choice")
        .when(choice_type == "CHECKBOX", "multi_choice")
        .when(q["textQuestion"].isNotNull(), "text")
        .when(q["scaleQuestion"].isNotNull(), "ordinal")
        .when(q["dateQuestion"].isNotNull(), "date")
        .when(q["timeQuestion"].isNotNull(), "time")
        .when(q["fileUploadQuestion"].isNotNull(), "file")
        .when(q["ratingQuestion"].isNotNull() & F.coalesce(rating_ok, F.lit(False)), "ordinal")
        .otherwise("unsupported")
    )
    return F.when(grid_type.isNotNull(), grid_kind).otherwise(plain)


def build_questions(items: DataFrame) -> DataFrame:
    rows = _question_rows(items)
    q = F.col("q")
    rating = q["ratingQuestion"]["ratingScaleLevel"]
    in_order = Window.partitionBy("form_id").orderBy("pos", "row")
    return rows.withColumn("kind", question_kind(q, F.col("grid_type"))).select(
        "form_id", q["questionId"].alias("question_id"), "section_ord",
        (F.row_number().over(in_order) - 1).alias("ord"), "title", "kind",
        F.coalesce(q["required"], F.lit(False)).alias("required"), "group_id",
        F.when(F.col("kind") == "ordinal", F.coalesce(q["scaleQuestion"]["low"], F.lit(1))).alias("min"),
        F.when(F.col("kind") == "ordinal", F.coalesce(q["scaleQuestion"]["high"], rating)).alias("max"),
        F.when(F.col("kind") == "date", F.coalesce(q["dateQuestion"]["includeTime"], F.lit(False))).alias("include_time"),
        F.when(F.col("kind") == "date", F.coalesce(q["dateQuestion"]["includeYear"], F.lit(False))).alias("include_year"),
        F.when(F.col("kind") == "time", F.coalesce(q["timeQuestion"]["duration"], F.lit(False))).alias("duration"),
    )


def _options_of(rows: DataFrame, scope: Column) -> DataFrame:
    is_other = F.coalesce(F.col("o.isOther"), F.lit(False))
    return rows.withColumn("option_key", F.concat_ws(":", F.lit("option"), scope, F.col("index"))).withColumn(
        "is_other", is_other
    ).withColumn("label", F.coalesce("o.value", F.when(is_other, F.lit(DEFAULT_OTHER_LABEL))))


def _plain_options(items: DataFrame) -> DataFrame:
    q = F.col("item.questionItem.question")
    rows = items.where(q["choiceQuestion"].isNotNull()).select(
        "form_id", q["questionId"].alias("question_id"), q["choiceQuestion"]["type"].alias("type"), "section_ord",
        F.posexplode(q["choiceQuestion"]["options"]).alias("index", "o"),
    )
    return _options_of(rows, F.concat(F.lit("question:"), F.col("question_id")))


def build_options(items: DataFrame) -> DataFrame:
    """Position-stable option keys; the rows of a grid share the options of their group."""
    plain = _plain_options(items).where(F.col("type").isin("RADIO", "DROP_DOWN", "CHECKBOX"))
    grid = items.where(F.col("item.questionGroupItem").isNotNull()).select(
        "form_id", F.col("item.itemId").alias("group_id"),
        F.explode("item.questionGroupItem.questions.questionId").alias("question_id"),
        F.col("item.questionGroupItem.grid.columns.options").alias("opts"),
    ).select("form_id", "group_id", "question_id", F.posexplode("opts").alias("index", "o"))
    columns = ["form_id", "question_id", "option_key", "label", "is_other", F.col("index").alias("ord")]
    return plain.select(*columns).unionByName(
        _options_of(grid, F.concat(F.lit("group:"), F.col("group_id"))).select(*columns)
    )


def build_groups(items: DataFrame) -> DataFrame:
    grid = F.col("item.questionGroupItem")
    return items.where(grid.isNotNull()).select(
        "form_id", F.col("item.itemId").alias("group_id"), F.coalesce("item.title", F.lit("")).alias("title"),
        _lookup({"RADIO": "radio", "CHECKBOX": "checkbox"}, grid["grid"]["columns"]["type"]).alias("presentation"),
        F.size(grid["questions"]).alias("question_count"),
        F.coalesce(grid["grid"]["shuffleQuestions"], F.lit(False)).alias("shuffle_questions"),
    )


def routing_candidates(items: DataFrame) -> DataFrame:
    """Go-to options of single-choice questions, with the typed destination where one is known."""
    rows = _plain_options(items).where(F.col("type").isin("RADIO", "DROP_DOWN")).where(
        (F.coalesce("o.goToAction", F.lit("")) != "") | (F.coalesce("o.goToSectionId", F.lit("")) != "")
    )
    to_section = F.coalesce(F.col("o.goToSectionId"), F.lit("")) != ""
    return rows.select(
        "form_id", "question_id", "option_key", F.col("section_ord").alias("source_ord"),
        F.when(to_section, "section").otherwise(
            _lookup(DESTINATIONS, F.coalesce("o.goToAction", F.lit("")))
        ).alias("dest_type"),
        F.when(to_section, F.col("o.goToSectionId")).alias("dest_section_id"),
    )


def build_transitions(items: DataFrame, sections: DataFrame) -> DataFrame:
    """Typed transitions. Unknown actions are dropped; an unknown section sets ``error``."""
    known = sections.select(
        "form_id", F.col("section_id").alias("dest_section_id"), F.col("ord").alias("dest_ord")
    )
    return (
        routing_candidates(items).where(F.col("dest_type").isNotNull())
        .join(known.hint("merge"), ["form_id", "dest_section_id"], "left")
        .withColumn(
            "error",
            F.when((F.col("dest_type") == "section") & F.col("dest_ord").isNull(), "unknown_section"),
        )
    )


def normalise_forms(raw: DataFrame, json_column: str = "payload") -> FormTables:
    # Documents are parsed once; every table below reads the stored items. Tables that grow with the forms are
    # merged, never broadcast: their compressed bytes say little about the rows in a hashed relation.
    items = materialise(form_items(raw, json_column))
    sections, questions, options = build_sections(items), build_questions(items), build_options(items)
    transitions = build_transitions(items, sections)
    navigation = transitions.where(F.col("error").isNull()).select("form_id", "question_id").distinct().withColumn(
        "affects_navigation", F.lit(True)
    )
    questions = (
        questions.join(navigation.hint("merge"), ["form_id", "question_id"], "left")
        .withColumn("affects_navigation", F.coalesce("affects_navigation", F.lit(False)))
        .join(
            sections.select("form_id", F.col("ord").alias("section_ord"), "section_id").hint("merge"),
            ["form_id", "section_ord"], "left",
        )
    )

    def repeated(df: DataFrame, column: str, code: str) -> DataFrame:
        return df.groupBy("form_id", F.col(column).alias("ref")).agg(F.count(F.lit(1)).alias("n")).where(
            F.col("n") > 1
        ).select("form_id", F.lit(code).alias("code"), "ref")

    errors = (
        malformed_forms(raw, json_column).unionByName(repeated(sections, "section_id", "duplicate_section"))
        .unionByName(repeated(questions, "question_id", "duplicate_question"))
        .unionByName(
            transitions.where(F.col("error").isNotNull()).select(
                "form_id", F.col("error").alias("code"), F.col("option_key").alias("ref")
            )
        )
        .unionByName(
            options.where(F.col("label").isNull()).select(
                "form_id", F.lit("invalid_option").alias("code"), F.col("option_key").alias("ref")
            )
        )
        .unionByName(
            questions.where(F.col("max") < F.col("min")).select(
                "form_id", F.lit("invalid_bounds").alias("code"), F.col("question_id").alias("ref")
            )
        )
    )
    return FormTables(
        sections, questions, options, build_groups(items),
        transitions.where(F.col("error").isNull()).drop("error"), errors,
    )


def schema_fingerprint(tables: FormTables) -> DataFrame:
    """sha256 per form over its sorted dimension rows; capture time is not part of it."""
    parts = None
    for name in ("sections", "questions", "options", "groups", "transitions"):
        df = getattr(tables, name)
        columns = sorted(c for c in df.columns if c != "form_id")
        rows = df.select(
            "form_id", F.sha2(F.to_json(F.struct(F.lit(name).alias("table"), *columns)), 256).alias("row")
        )
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.groupBy("form_id").agg(
        F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("row"))), 256).alias("schema_hash")
    )
