"""The check of finished rows: what a run is about to hand out, against its source, its form and its plan.

Every finding is a row (code, response_id, detail), so a report shows all of them; ``stop_on``
turns them into the refusal of the run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.slots import cell_valid, slot
from canvass.operators import routing as R
from canvass.plans import selection as SEL
from canvass.plans import vectors as V
from canvass.plans.pool import Job, misrouted

#: What a cell holds, as JSON.
_CELL = (
    "struct<state:string,value:struct<kind:string,optionKey:string,label:string,optionKeys:array<string>,"
    "labels:array<string>,otherValue:string,value:int,text:string>>"
)

#: Codes of rows, in the order in which a row's first finding is named.
ROW_CODES = (
    "invalid_origin", "invalid_timestamp", "invalid_score", "unmapped_score", "invalid_cell", "routing_conflict",
    "required_skipped",
)
#: Codes of ids and of the table.
TABLE_CODES = (
    "repeated_response_id", "unknown_source_row", "changed_source_row", "lost_source_row", "row_count", "original_count",
    "target_disagrees", "target_support", "count_missed",
)


@dataclass(frozen=True)
class FormCheck:
    """What rebuilding a generated row needs of its form.

    ``index`` is the form's row of :func:`canvass.operators.routing.form_index`; ``scores`` maps score columns to
    (question, option scores or None for an ordinal); ``cells`` maps cell columns to questions.
    """

    form_id: str
    index: DataFrame
    scores: Mapping[str, tuple[str, Mapping[str, int] | None]] = field(default_factory=dict)
    cells: Mapping[str, str] = field(default_factory=dict)


def _row_findings(rows: DataFrame, job: Job) -> DataFrame:
    """Findings that one row shows by itself; generated rows only, but for origin and time."""
    synthetic = F.col("origin") == "synthetic"
    tests: list[tuple[str, Column, Column]] = [
        ("invalid_origin", ~F.coalesce(F.col("origin").isin("original", "synthetic"), F.lit(False)), F.col("origin"))
    ]
    if job.time_column:
        tests.append(("invalid_timestamp", F.col(job.time_column).isNull(), F.lit(job.time_column)))
    for mean in job.means:
        score = F.col(mean.column).try_cast("double")
        whole = (score == F.floor(score)) & score.between(mean.minimum, mean.maximum)
        tests.append(("invalid_score", synthetic & F.col(mean.column).isNotNull() & ~F.coalesce(whole, F.lit(False)), F.lit(mean.column)))
    for name in job.categorical:
        # Plain columns may hold any text; what begins like a slot has to be one.
        slotted = F.ltrim(F.col(name)).startswith("{") & ~cell_valid(F.col(name))
        tests.append(("invalid_cell", synthetic & (F.col(name).isNull() | slotted), F.lit(name)))
    if job.rules:
        tests.append(("routing_conflict", synthetic & misrouted(job.rules), F.lit("confirmed rule")))
    found = F.array(*[
        F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail"))) for code, test, detail in tests
    ])
    return rows.select(F.col("response_id").cast("string").alias("response_id"), F.explode(F.array_compact(found)).alias("f")).select("f.code", "response_id", "f.detail")


def rebuilt(rows: DataFrame, form: FormCheck) -> DataFrame:
    """Generated flat rows as responses of their form: form_id, response_id, answers, unmapped (score columns)."""
    slots, unmapped = [], []
    for name, (question, options) in form.scores.items():
        score = F.col(name).try_cast("double")
        answered = dict(question_id=F.lit(question), state=F.lit("answered"))
        empty = slot(question_id=F.lit(question), state=F.lit("skipped"))
        if options is None:
            value = slot(**answered, kind=F.lit("ordinal"), score=score.cast("int"))
        else:
            keys = F.create_map(*[F.lit(x) for key, n in options.items() for x in (float(n), key)])
            option = F.try_element_at(keys, score)
            unmapped.append(F.when(score.isNotNull() & option.isNull(), F.lit(name)))
            value = slot(**answered, kind=F.lit("single_choice"), option_key=option, label=option)
        slots.append(F.when(score.isNull(), empty).otherwise(value))
    for name, question in form.cells.items():
        cell = F.from_json(F.col(name), _CELL)
        v = cell["value"]
        slots.append(slot(
            question_id=F.lit(question), kind=v["kind"], state=cell["state"], option_key=v["optionKey"], label=v["label"],
            option_keys=v["optionKeys"], labels=v["labels"], other_value=v["otherValue"], score=v["value"], text=v["text"],
        ))
    return rows.select(
        F.lit(form.form_id).alias("form_id"), F.col("response_id").cast("string").alias("response_id"), F.array(*slots).alias("answers"),
        (F.array_compact(F.array(*unmapped)) if unmapped else F.array().cast("array<string>")).alias("unmapped"),
    )


def _form_findings(rows: DataFrame, form: FormCheck) -> DataFrame:
    """Scores no option stands for, answers the form routes around, required questions left open."""
    responses = rebuilt(rows.where("origin = 'synthetic'"), form)
    unmapped = responses.select(F.lit("unmapped_score").alias("code"), "response_id", F.explode("unmapped").alias("detail"))
    plain = responses.drop("unmapped")
    away = R.routing_violations(plain, form.index).select(F.lit("routing_conflict").alias("code"), "response_id", F.col("question_id").alias("detail"))
    done = R.complete_slots(R.resolve_paths(plain, form.index), synthetic=True).where("required_skipped > 0")
    skipped = done.select(F.lit("required_skipped").alias("code"), "response_id", F.col("required_skipped").cast("string").alias("detail"))
    return unmapped.unionByName(away).unionByName(skipped)


def _id_findings(final: DataFrame, source: DataFrame, columns: Sequence[str], all_kept: bool) -> DataFrame:
    """Both tables meet once, by id: repeated ids, originals that are unknown, changed or lost."""
    content = F.xxhash64(*[F.col(x).cast("string") for x in columns], *[F.col(x).isNull() for x in columns])
    side = lambda df, original, mine: df.select(
        F.col("response_id").cast("string").alias("response_id"), original.alias("original"), F.lit(mine).alias("given"), content.alias("content")
    )
    both = side(final, F.coalesce(F.col("origin") == "original", F.lit(False)), False).unionByName(side(source, F.lit(True), True))
    per_id = both.groupBy("response_id").agg(
        F.count_if(~F.col("given")).alias("n"), F.count_if(~F.col("given") & F.col("original")).alias("originals"),
        F.count_if("given").alias("sources"),
        F.collect_set(F.when(F.col("original"), F.col("content"))).alias("contents"),
    )
    code = F.array_compact(F.array(
        F.when(F.col("n") > 1, "repeated_response_id"),
        F.when((F.col("originals") > 0) & (F.col("sources") == 0), "unknown_source_row"),
        F.when((F.col("originals") > 0) & (F.col("sources") > 0) & (F.size("contents") > 1), "changed_source_row"),
        F.when((F.col("originals") == 0) & (F.col("sources") > 0) & F.lit(all_kept), "lost_source_row"),
    ))
    return per_id.select(F.explode(code).alias("code"), "response_id", F.lit(None).cast("string").alias("detail"))


def _table_finding(df: DataFrame, code: str, test: Column, detail: Column) -> DataFrame:
    return df.where(test).select(F.lit(code).alias("code"), F.lit(None).cast("string").alias("response_id"), detail.cast("string").alias("detail"))


def finished_findings(
    final: DataFrame,
    source: DataFrame,
    job: Job,
    *,
    removed_count: int = 0,
    planned: DataFrame | None = None,
    plans: Mapping[str, dict] | None = None,
    form: FormCheck | None = None,
) -> DataFrame:
    """code, response_id, detail of everything wrong with finished rows; no rows if they may be handed out.

    ``removed_count`` source rows may be missing (a replacement); otherwise all have to be there, unchanged.
    ``planned`` is the outcome the selection claimed (:func:`canvass.plans.vectors.outcomes`), measured again here;
    ``plans`` are the support plans an appended table may not fall short of. Detail is a column, target or number.
    """
    columns = [x for x in ([job.time_column] if job.time_column else []) + [*job.scores, *job.categorical] if x in source.columns]
    parts = [_row_findings(final, job), _id_findings(final, source, columns, removed_count == 0)]
    if form is not None:
        parts.append(_form_findings(final, form))
    sizes = final.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("origin") == "original").alias("originals"))
    # One-row tables side by side.
    sizes = sizes.join(source.agg(F.count(F.lit(1)).alias("sources")))
    parts.append(_table_finding(sizes, "row_count", F.col("n") != job.final_count, F.col("n")))
    parts.append(_table_finding(sizes, "original_count", F.col("originals") != F.col("sources") - removed_count, F.col("originals")))
    if job.targets:
        outcome = V.outcomes(final, job.targets)
        if planned is not None:
            parts.append(_table_finding(V.cross_check(final, job.targets, planned), "target_disagrees", F.lit(True), F.col("target_id")))
        if plans is not None and not removed_count:
            parts.append(_table_finding(SEL.support_violations(outcome, dict(plans), job), "target_support", F.lit(True), F.col("target_ids")))
        if removed_count and job.counts:
            missed = (F.col("kind") == "count") & (F.col("absolute_error") > 0)
            parts.append(_table_finding(outcome, "count_missed", missed, F.col("target_id")))
    return reduce(DataFrame.unionByName, parts)


def stop_on(findings: DataFrame, shown: int = 5) -> None:
    """Refuse the run if there is any finding; names a few of them and counts all by code."""
    counts = {r["code"]: r["n"] for r in findings.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts:
        some = [f"{r['code']}({r['response_id'] or ''} {r['detail'] or ''})" for r in findings.orderBy("code", "response_id", "detail").limit(shown).collect()]
        raise SEL.Infeasible("finished_rows", f"{dict(sorted(counts.items()))}, e.g. {', '.join(some)}")
