"""Landed response documents to typed answers.

One document stays one row from parsing to the completed slots: questions and options are
looked up in the form's index row, so typing the answers moves no data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.labels import label_keys
from canvass.functions.parsing import parse_date, parse_ordinal, parse_time, submission_time
from canvass.functions.slots import slot
from canvass.schema import ANSWERED, RESPONSE_JSON


def answer_index(questions: DataFrame, options: DataFrame) -> DataFrame:
    """One row per form: question id -> kind, bounds, flags, options by label key, sole Other option."""
    keyed = options.withColumn("label_key", label_keys(F.array("label"))[0])
    per_label = keyed.groupBy("form_id", "question_id", "label_key").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("option_key", "label", "is_other"), "ord").alias("o")
    )
    per_question = per_label.groupBy("form_id", "question_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct("label_key", F.struct("n", "o.option_key", "o.label", "o.is_other")))
        ).alias("by_label")
    )
    others = options.where("is_other").groupBy("form_id", "question_id").agg(
        F.when(F.count(F.lit(1)) == 1, F.min("option_key")).alias("other_key")
    )
    have = set(questions.columns)
    optional = {
        "min": "int", "max": "int", "include_time": "boolean", "include_year": "boolean", "duration": "boolean",
    }
    q = questions.select(
        "form_id", "question_id", "kind",
        *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in optional.items()],
    )
    full = q.join(per_question, ["form_id", "question_id"], "left").join(others, ["form_id", "question_id"], "left")
    return full.groupBy("form_id").agg(
        F.map_from_entries(
            F.collect_list(
                F.struct("question_id", F.struct("kind", *optional, "by_label", "other_key").alias("spec"))
            )
        ).alias("specs")
    )


def parse_responses(raw: DataFrame, json_column: str = "payload") -> DataFrame:
    """form_id, response_id, submitted_at, entries: array of (question_id, texts, files)."""
    doc = raw.select("form_id", F.from_json(json_column, RESPONSE_JSON).alias("doc"))
    entries = F.transform(
        F.map_entries("doc.answers"),
        lambda e: F.struct(
            e["key"].alias("question_id"),
            F.coalesce(F.transform(e["value"]["textAnswers"]["answers"], lambda t: t["value"]), F.array()).alias("texts"),
            F.coalesce(
                F.transform(
                    e["value"]["fileUploadAnswers"]["answers"],
                    lambda f: F.struct(
                        f["fileName"].alias("file_name"), f["mimeType"].alias("mime_type"), f["fileId"].alias("file_id")
                    ),
                ),
                F.array(),
            ).alias("files"),
        ),
    )
    return doc.select(
        "form_id", F.col("doc.responseId").alias("response_id"),
        submission_time(F.col("doc.lastSubmittedTime"), F.col("doc.createTime")).alias("submitted_at"),
        F.coalesce(entries, F.array()).alias("entries"),
    )


def _picked(entry: Column) -> Column:
    """The entry with one pick per text: matched option, else the sole Other option."""
    spec = entry["spec"]
    hits = F.transform(
        F.arrays_zip(entry["texts"].alias("raw"), entry["keys"].alias("key")),
        lambda t: F.struct(t["raw"].alias("raw"), F.element_at(spec["by_label"], t["key"]).alias("hit")),
    )
    picks = F.transform(
        hits,
        lambda h: F.struct(
            F.coalesce(h["hit"]["option_key"], spec["other_key"]).alias("option_key"),
            F.when(
                h["hit"].isNull() | (h["hit"]["is_other"] & (h["raw"] != h["hit"]["label"])), h["raw"]
            ).alias("other_value"),
            (F.coalesce(h["hit"]["n"], F.lit(1)) > 1).alias("ambiguous"),
        ),
    )
    is_choice = spec["kind"].isin("single_choice", "multi_choice")
    return F.struct(
        entry["question_id"].alias("question_id"), entry["texts"].alias("texts"), entry["files"].alias("files"),
        spec.alias("spec"), F.when(is_choice, picks).alias("picks"),
    )


def _nameless(file: Column) -> Column:
    """A file answer without name, type and id."""
    return F.concat_ws("", file["file_name"], file["mime_type"], file["file_id"]) == ""


def _typed(entry: Column) -> Column:
    """One typed slot and the error that kept the answer out, if any."""
    spec, texts, picks = entry["spec"], entry["texts"], entry["picks"]
    first, pick, kind = F.get(texts, F.lit(0)), F.get(picks, F.lit(0)), spec["kind"]
    option_keys = F.transform(picks, lambda p: p["option_key"])
    other_values = F.filter(F.transform(picks, lambda p: p["other_value"]), lambda v: v.isNotNull())
    choice_error = (
        F.when(F.exists(picks, lambda p: p["ambiguous"]), "ambiguous_option")
        .when(F.exists(option_keys, lambda k: k.isNull()), "unknown_option")
    )
    ordinal = parse_ordinal(first, spec["min"], spec["max"])
    date = parse_date(first, F.coalesce(spec["include_year"], F.lit(False)), F.coalesce(spec["include_time"], F.lit(False)))
    clock = parse_time(first, F.coalesce(spec["duration"], F.lit(False)))
    file_names = F.transform(
        entry["files"], lambda f: F.coalesce(f["file_name"], f["mime_type"], F.lit("file"))
    )

    def typed(error: Column | None = None, **fields: Column) -> Column:
        own = slot(question_id=entry["question_id"], kind=kind, state=F.lit(ANSWERED), **fields)
        return F.struct((F.lit(None) if error is None else error).cast("string").alias("error"), own.alias("slot"))

    # The kind is asked for once: inside a lambda every condition is interpreted for every answer.
    return (
        F.when(kind == "single_choice", typed(
            F.when(F.size(texts) == 0, "no_choice").otherwise(
                F.when(pick["ambiguous"], "ambiguous_option").when(pick["option_key"].isNull(), "unknown_option")),
            option_key=pick["option_key"], label=first, other_value=pick["other_value"],
        ))
        .when(kind == "multi_choice", typed(
            F.coalesce(
                choice_error,
                F.when(F.size(other_values) > 1, "several_other_values"),
                F.when(F.size(F.array_distinct(option_keys)) != F.size(option_keys), "repeated_option")),
            other_value=F.get(other_values, F.lit(0)), option_keys=option_keys, labels=texts,
        ))
        .when(kind == "ordinal", typed(
            F.coalesce(ordinal["error"], F.when(first.isNull(), "invalid_ordinal")), score=ordinal["value"],
        ))
        .when(kind == "text", typed(text=F.array_join(texts, "\n")))
        .when(kind == "date", typed(F.coalesce(date["error"], F.when(first.isNull(), "invalid_date")), text=first))
        .when(kind == "time", typed(F.coalesce(clock["error"], F.when(first.isNull(), "invalid_time")), text=first))
        .when(kind == "file", typed(
            F.when(F.exists(entry["files"], _nameless), "invalid_file"),
            files=F.transform(entry["files"], lambda f: F.struct(f["file_name"].alias("file_name"), f["mime_type"].alias("mime_type"))),
        ))
        .when(kind == "unsupported", typed(values=F.concat(texts, file_names)))
        .otherwise(typed())
    )


def type_answers(parsed: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``answers`` (answered slots) and ``answer_errors`` (question id, code).

    Every response stays: one of a form without questions has no answers, one without a readable
    time gets the error ``invalid_submission_time`` (no question id). Unknown question ids and empty answers are no answers. Only choice texts go through the
    Unicode step, as one Arrow batch per response array.
    """
    rows = parsed.join(index, "form_id", "left")
    known = F.filter(
        F.transform(
            "entries",
            lambda e: F.struct(
                e["question_id"].alias("question_id"), e["texts"].alias("texts"), e["files"].alias("files"),
                F.element_at("specs", e["question_id"]).alias("spec"),
            ),
        ),
        lambda e: e["spec"].isNotNull() & ((F.size(e["texts"]) > 0) | (F.size(e["files"]) > 0)),
    )
    rows = rows.withColumn("known", known)
    # Texts of all choice answers in one flat array; offsets give each answer its slice back.
    choice_texts = F.transform(
        "known",
        lambda e: F.when(e["spec"]["kind"].isin("single_choice", "multi_choice"), e["texts"]).otherwise(
            F.array().cast("array<string>")
        ),
    )
    rows = rows.withColumn("choice_texts", choice_texts).withColumn(
        "flat_keys", label_keys(F.flatten("choice_texts"))
    )
    # Summed in place: Spark would put an array of all starts into the lambda below and make it once for each answer.
    start = lambda i: F.aggregate(F.slice("choice_texts", F.lit(1), i), F.lit(0), lambda acc, t: acc + F.size(t))
    keyed = F.transform(
        "known",
        lambda e, i: F.struct(
            e["question_id"].alias("question_id"), e["texts"].alias("texts"), e["files"].alias("files"),
            e["spec"].alias("spec"),
            F.slice("flat_keys", start(i) + 1, F.size(F.get("choice_texts", i))).alias("keys"),
        ),
    )
    rows = rows.withColumn("picked", F.transform(keyed, _picked)).withColumn("typed", F.transform("picked", _typed))
    return rows.select(
        "form_id", "response_id", "submitted_at",
        F.transform(F.filter("typed", lambda t: t["error"].isNull()), lambda t: t["slot"]).alias("answers"),
        F.concat(
            F.when(
                F.col("submitted_at").isNull(),
                F.array(F.struct(F.lit(None).cast("string").alias("question_id"), F.lit("invalid_submission_time").alias("code"))),
            ).otherwise(F.array()),
            F.transform(
                F.filter("typed", lambda t: t["error"].isNotNull()),
                lambda t: F.struct(t["slot"]["question_id"].alias("question_id"), t["error"].alias("code")),
            ),
        ).alias("answer_errors"),
    )


def fail_on_errors(typed: DataFrame) -> DataFrame:
    """All-or-nothing import: the job stops at the first answer that does not fit its question."""
    bad = F.size("answer_errors") > 0
    message = F.concat(F.lit("answer does not fit its question: "), F.to_json("answer_errors"))
    return typed.withColumn(
        "answers", F.when(bad, F.raise_error(message).cast(typed.schema["answers"].dataType)).otherwise(F.col("answers"))
    )


def answer_quality(typed: DataFrame) -> DataFrame:
    """Rejected answers per form, question and code."""
    return typed.select("form_id", F.explode("answer_errors").alias("e")).groupBy(
        "form_id", "e.question_id", "e.code"
    ).agg(F.count(F.lit(1)).alias("rejected"))
