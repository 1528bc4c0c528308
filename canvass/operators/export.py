"""Ordered, typed and formula-safe tables for people, and their CSV form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.functions.labels import spreadsheet_safe
from canvass.functions.parsing import (
    DATE_PATTERN, DATETIME_PATTERN, EXPORT_TIME_PATTERN, valid_calendar_date, valid_clock_time,
)
from canvass.schema import ANSWERED

# Header of the submission time column, joiners of grid headers and checkbox labels.
SUBMITTED_HEADER = "응답 제출 시간"
GRID_JOINER = " — "
LIST_JOINER = ", "


def question_headers(questions: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Title of each question; rows of a grid read ``<group> — <row>``."""
    if groups is None:
        return questions.select("form_id", "question_id", "ord", F.col("title").alias("header"))
    titles = groups.select("form_id", "group_id", F.col("title").alias("group_title"))
    return questions.join(titles, ["form_id", "group_id"], "left").select(
        "form_id", "question_id", "ord",
        F.when(F.col("group_title").isNotNull(), F.concat("group_title", F.lit(GRID_JOINER), "title"))
        .otherwise(F.col("title")).alias("header"),
    )


def disambiguate(headers: DataFrame) -> DataFrame:
    """Second and later occurrences of a header in one form get `` (n)``.

    Equal headers of one form meet in one window, which is at most one form document.
    """
    submitted = headers.select("form_id").distinct().select(
        "form_id", F.lit(None).cast("string").alias("question_id"), F.lit(-1).alias("ord"),
        F.lit(SUBMITTED_HEADER).alias("header"),
    )
    nth = F.row_number().over(Window.partitionBy("form_id", "header").orderBy("ord"))
    return headers.select("form_id", "question_id", "ord", "header").unionByName(submitted).withColumn(
        "header", F.when(nth == 1, F.col("header")).otherwise(F.concat("header", F.lit(" ("), nth, F.lit(")")))
    )


def ordered_checkbox_text(option_keys: Column, form_options: Column, other_value: Column) -> Column:
    """Labels in form order, the free text of Other last. ``form_options``: array of
    (option_key, label) in form order."""
    labels = F.transform(
        F.filter(form_options, lambda o: F.array_contains(option_keys, o["option_key"])), lambda o: o["label"]
    )
    extra = F.when(F.coalesce(other_value, F.lit("")) != "", F.array(other_value)).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_join(F.concat(labels, extra), LIST_JOINER)


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def export_cells(slots: DataFrame, form_options: DataFrame, flags: DataFrame) -> DataFrame:
    """Typed cell of every slot: cell_kind, text_value, number_value, seconds_value, iso_value.

    ``form_options``: form_id, question_id, form_options. ``flags``: form_id, question_id,
    include_year, include_time, duration. Slots that are not answered, and files, are empty.
    """
    rows = slots.join(form_options, ["form_id", "question_id"], "left").join(flags, ["form_id", "question_id"], "left")
    c = F.col
    text, kind = c("text"), c("kind")
    year_flag, time_flag = F.coalesce("include_year", F.lit(False)), F.coalesce("include_time", F.lit(False))
    day = valid_calendar_date(_part(text, DATE_PATTERN, 1), _part(text, DATE_PATTERN, 2), _part(text, DATE_PATTERN, 3))
    moment_day = valid_calendar_date(
        _part(text, DATETIME_PATTERN, 1), _part(text, DATETIME_PATTERN, 2), _part(text, DATETIME_PATTERN, 3)
    )
    moment_ok = moment_day & valid_clock_time(
        _part(text, DATETIME_PATTERN, 4), _part(text, DATETIME_PATTERN, 5)
    )
    hours, minutes = _part(text, EXPORT_TIME_PATTERN, 1), _part(text, EXPORT_TIME_PATTERN, 2)
    clock_ok = F.coalesce(
        text.rlike(EXPORT_TIME_PATTERN) & (minutes <= 59) & (F.coalesce("duration", F.lit(False)) | (hours <= 23)),
        F.lit(False),
    )
    is_day = (kind == "date") & year_flag & ~time_flag & day
    is_moment = (kind == "date") & year_flag & time_flag & F.coalesce(moment_ok, F.lit(False))
    is_clock = (kind == "time") & clock_ok
    answered = F.coalesce(c("state") == ANSWERED, F.lit(False))
    plain = (
        F.when(kind == "single_choice", F.coalesce("other_value", "label"))
        .when(kind == "multi_choice", ordered_checkbox_text(c("option_keys"), c("form_options"), c("other_value")))
        .when(kind == "unsupported", F.array_join("values", LIST_JOINER))
        .otherwise(text)
    )
    cell_kind = (
        F.when(~answered | (kind == "file"), "empty").when(kind == "ordinal", "number")
        .when(is_day, "date").when(is_moment, "datetime").when(is_clock, "time").otherwise("text")
    )
    rows = rows.withColumn("cell_kind", cell_kind)
    is_kind = lambda k: c("cell_kind") == k
    return rows.withColumn("text_value", F.when(is_kind("text"), plain)).withColumn(
        "number_value", F.when(is_kind("number"), c("score"))
    ).withColumn("seconds_value", F.when(is_kind("time"), hours * 3600 + minutes * 60)).withColumn(
        "iso_value",
        F.when(is_kind("date"), text).when(is_kind("datetime"), F.concat(F.translate(text, " ", "T"), F.lit(":00.000Z"))),
    )


def csv_cell() -> Column:
    """CSV text of a typed cell (quoting is left to the writer)."""
    kind, seconds = F.col("cell_kind"), F.col("seconds_value")
    hours = F.floor(seconds / 3600).cast("string")
    minutes = F.floor((seconds % 3600) / 60).cast("string")
    two = lambda s: F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s)
    return (
        F.when(kind == "empty", "").when(kind == "text", spreadsheet_safe(F.col("text_value")))
        .when(kind == "number", F.col("number_value").cast("string"))
        .when(kind == "time", F.concat(two(hours), F.lit(":"), two(minutes)))
        .otherwise(F.col("iso_value"))
    )


def csv_quoted(text: Column) -> Column:
    return F.when(text.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def header_map(headers: DataFrame, form_id: str) -> dict[str | None, str]:
    """question id -> header of one form, in form order; None is the submission time column."""
    rows = headers.where(F.col("form_id") == form_id).orderBy("ord").select("question_id", "header").collect()
    return {r["question_id"]: r["header"] for r in rows}


def export_table(cells: DataFrame, titles: dict[str | None, str], *, keep_origin: bool = True) -> DataFrame:
    """The wide export: submission time, then one CSV-text column per question of ``titles``.

    ``cells`` come from ``export_cells`` for one form (or forms with the same questions). Rows
    are ordered by (submitted_at, response_id). The origin of each row stays in the table;
    leaving it out is the caller's explicit choice.
    """
    base = ["submitted_at", "response_id"] + (["origin"] if keep_origin else [])
    questions = [q for q in titles if q is not None]
    wide = cells.withColumn("csv", csv_cell()).groupBy(*base).pivot("question_id", questions).agg(F.first("csv"))
    ordered = wide.orderBy("submitted_at", "response_id")
    stamp = F.date_format("submitted_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return ordered.select(
        stamp.alias(titles[None]), *[F.coalesce(F.col(f"`{q}`"), F.lit("")).alias(titles[q]) for q in questions],
        *([F.col("origin").alias("__origin")] if keep_origin else []),
    )


def write_csv(table: DataFrame, path: str) -> None:
    """Part files with CRLF lines and doubled quotes; cells come from ``csv_cell``, which already
    made text formula-safe. Spark starts no file with a byte order mark."""
    headers = [f"'{x}" if x.lstrip().startswith(("=", "+", "-", "@")) else x for x in table.columns]
    table.toDF(*headers).write.mode("errorifexists").csv(
        path, header=True, lineSep="\r\n", quote='"', escape='"', emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def target_labels(targets: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """Question title and option label of each frozen target; what the form lacks sets ``problem``."""
    q = questions.select("form_id", "question_id", F.col("title").alias("question_title"), F.lit(True).alias("has_question"))
    o = options.select("form_id", "question_id", "option_key", F.col("label").alias("option_label"), F.lit(True).alias("has_option"))
    joined = targets.join(q, ["form_id", "question_id"], "left").join(
        o, ["form_id", "question_id", "option_key"], "left"
    )
    return joined.withColumn(
        "problem",
        F.when(F.col("has_question").isNull(), "missing_question")
        .when(F.col("option_key").isNotNull() & F.col("has_option").isNull(), "missing_option"),
    ).drop("has_question", "has_option")
