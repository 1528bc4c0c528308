"""Which questions a response reached, skipped, or never saw.

The rules of one form are packed into one index row and joined to its responses; all
marks are then worked out inside the response row with array functions. No shuffle of
answers happens, so the cost is one narrow pass whatever the skew between forms.
Sections are numbered 0..n-1 in form order and paths are sets of these numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.slots import slot
from canvass.schema import ANSWERED, INDETERMINATE, NOT_REACHED, SKIPPED

_SEP = "\x1f"


def form_index(sections: DataFrame, questions: DataFrame, transitions: DataFrame) -> DataFrame:
    """One row per form: questions in order, question map, transition map, restart questions.

    A row is as large as the form document itself. ``questions`` needs section_ord;
    ``transitions`` needs dest_type and dest_ord.
    """
    per_form = questions.groupBy("form_id").agg(
        F.array_sort(
            F.collect_list(F.struct("ord", "question_id", "section_ord", "required", "kind"))
        ).alias("questions")
    )
    hops = transitions.groupBy("form_id").agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    F.concat_ws(_SEP, "question_id", "option_key").alias("key"),
                    F.struct("dest_type", "dest_ord").alias("value"),
                )
            )
        ).alias("hops"),
        F.array_sort(F.collect_set(F.when(F.col("dest_type") == "restart", F.col("question_id")))).alias("restarts"),
    )
    last = sections.groupBy("form_id").agg(F.max("ord").alias("last_ord"))
    index = per_form.join(last, "form_id", "left").join(hops, "form_id", "left")
    return index.withColumn(
        "question_map",
        F.map_from_entries(F.transform("questions", lambda q: F.struct(q["question_id"], q))),
    )


def with_marks(responses: DataFrame, index: DataFrame) -> DataFrame:
    """Join the form index and add what the answers prove: section marks and conflicts.

    A response of a form without questions stays, with an empty path.
    """
    none = F.array().cast(index.schema["questions"].dataType)
    rows = responses.join(index, "form_id", "left").withColumn("questions", F.coalesce("questions", none))
    answered = F.filter("answers", lambda a: a["state"] == ANSWERED)

    def step(a: Column) -> Column:
        key = F.concat_ws(_SEP, a["question_id"], a["option_key"])
        hop = F.when(a["kind"] == "single_choice", F.element_at("hops", key))
        return F.struct(
            a["question_id"].alias("question_id"),
            F.element_at("question_map", a["question_id"])["section_ord"].alias("at"),
            hop["dest_type"].alias("dest_type"),
            hop["dest_ord"].alias("dest_ord"),
        )

    rows = rows.withColumn("steps", F.filter(F.transform(answered, step), lambda s: s["at"].isNotNull()))
    last = F.col("last_ord")

    def skipped_sections(s: Column) -> Column:
        after = s["at"] + 1
        upto = F.when(s["dest_type"] == "submit", last).when(s["dest_type"] == "section", s["dest_ord"] - 1)
        return F.when(upto >= after, F.sequence(after, upto)).otherwise(F.array().cast("array<int>"))

    next_of = F.transform(
        F.filter("steps", lambda s: (s["dest_type"] == "next_section") & (s["at"] < last)), lambda s: s["at"] + 1
    )
    jumps = F.transform(
        F.filter("steps", lambda s: (s["dest_type"] == "section") & s["dest_ord"].isNotNull()),
        lambda s: s["dest_ord"],
    )
    rows = rows.withColumn("answered_ords", F.array_distinct(F.transform("steps", lambda s: s["at"])))
    rows = rows.withColumn("not_reached_ords", F.array_distinct(F.flatten(F.transform("steps", skipped_sections))))
    rows = rows.withColumn(
        "reached_ords", F.array_distinct(F.concat(F.array(F.lit(0)), "answered_ords", next_of, jumps))
    )
    conflict = F.arrays_overlap("not_reached_ords", "answered_ords") | F.exists(
        "steps", lambda s: F.coalesce((s["dest_type"] == "section") & (s["dest_ord"] < s["at"]), F.lit(False))
    )
    return rows.withColumn("routing_conflict", F.coalesce(conflict, F.lit(False)))


def resolve_paths(responses: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``path`` (question -> reached / not_reached / indeterminate), confidence and restart flags.

    Precedence is order-free: reached beats not reached beats unknown.
    """
    rows = with_marks(responses, index)
    answered_ids = F.transform("steps", lambda s: s["question_id"])
    rows = rows.withColumn("answered_ids", answered_ids)

    def reach(q: Column) -> Column:
        state = (
            F.when(F.array_contains("answered_ids", q["question_id"]), "reached")
            .when(q["section_ord"].isNotNull() & F.array_contains("reached_ords", q["section_ord"]), "reached")
            .when(q["section_ord"].isNotNull() & F.array_contains("not_reached_ords", q["section_ord"]), "not_reached")
            .otherwise("indeterminate")
        )
        return F.struct(q["question_id"].alias("question_id"), state.alias("reach"))

    rows = rows.withColumn("path", F.transform("questions", reach))
    has_restart = F.coalesce(F.size("restarts") > 0, F.lit(False))
    restart_observed = F.exists("steps", lambda s: F.coalesce(s["dest_type"] == "restart", F.lit(False)))
    single_choice_ids = F.transform(
        F.filter("answers", lambda a: (a["state"] == ANSWERED) & (a["kind"] == "single_choice")),
        lambda a: a["question_id"],
    )
    rows = rows.withColumn("single_ids", single_choice_ids).withColumn(
        "unreached_ids",
        F.transform(F.filter("path", lambda p: p["reach"] == "not_reached"), lambda p: p["question_id"]),
    )
    # A restart question proves nothing went back when it was answered with another option
    # (no restart step seen for it) or was not reached at all.
    restarted_ids = F.transform(
        F.filter("steps", lambda s: F.coalesce(s["dest_type"] == "restart", F.lit(False))),
        lambda s: s["question_id"],
    )
    rows = rows.withColumn("restarted_ids", restarted_ids)
    harmless = ~has_restart | F.forall(
        F.coalesce("restarts", F.array().cast("array<string>")),
        lambda q: F.when(F.array_contains("single_ids", q), ~F.array_contains("restarted_ids", q)).otherwise(
            F.array_contains("unreached_ids", q)
        ),
    )
    unknown = F.exists("path", lambda p: p["reach"] == "indeterminate")
    has_rules = F.coalesce(F.size("hops") > 0, F.lit(False))
    confidence = (
        F.when(restart_observed | (has_restart & unknown & ~harmless), "ambiguous")
        .when((unknown | F.col("routing_conflict")) & has_rules, "partial")
        .when(unknown | F.col("routing_conflict"), "ambiguous")
        .otherwise("certain")
    )
    return rows.withColumn("restart_irrelevant", harmless).withColumn("confidence", confidence).drop(
        "answered_ids", "single_ids", "unreached_ids", "restarted_ids"
    )


def complete_slots(paths: DataFrame, *, synthetic: bool = False) -> DataFrame:
    """Every question of the form gets a slot; unanswered ones get the state the path supports.

    Imported rows: reached and required but unanswered is ``indeterminate``. Synthetic rows:
    it is a conflict, counted in ``required_skipped``.
    """
    answered = F.filter("answers", lambda a: a["state"] == ANSWERED)
    by_id = F.map_from_entries(F.transform(answered, lambda a: F.struct(a["question_id"], a)))
    reach = F.map_from_entries(F.transform("path", lambda p: F.struct(p["question_id"], p["reach"])))
    rows = paths.withColumn("__by_id", by_id).withColumn("__reach", reach)

    def slot_for(q: Column) -> Column:
        where = F.element_at("__reach", q["question_id"])
        can_skip = (where == "reached") if synthetic else (where == "reached") & ~q["required"]
        state = F.when(can_skip, SKIPPED).when(where == "not_reached", NOT_REACHED).otherwise(INDETERMINATE)
        empty = slot(question_id=q["question_id"], kind=q["kind"], state=state)
        return F.coalesce(F.element_at("__by_id", q["question_id"]), empty)

    rows = rows.withColumn("answers", F.transform("questions", slot_for))
    skipped_ids = F.transform(F.filter("answers", lambda a: a["state"] == SKIPPED), lambda a: a["question_id"])
    required = F.filter("questions", lambda q: q["required"] & F.array_contains(skipped_ids, q["question_id"]))
    return rows.withColumn("required_skipped", F.size(required)).drop("__by_id", "__reach")


def routing_violations(responses: DataFrame, index: DataFrame) -> DataFrame:
    """Answered questions that lie in a section the answers route around."""
    rows = with_marks(responses, index)
    bad = F.filter("steps", lambda s: F.array_contains("not_reached_ords", s["at"]))
    return rows.select("form_id", "response_id", F.explode_outer(bad).alias("s")).where(F.col("s").isNotNull()).select(
        "form_id", "response_id", F.col("s.question_id").alias("question_id")
    )


def skipped_sections(transitions: DataFrame, sections: DataFrame) -> DataFrame:
    """Transition -> each section it routes around (forward jumps and submit)."""
    last = sections.groupBy("form_id").agg(F.max("ord").alias("last_ord"))
    upto = F.when(F.col("dest_type") == "submit", F.col("last_ord")).when(
        F.col("dest_type") == "section", F.col("dest_ord") - 1
    )
    after = F.col("source_ord") + 1
    return (
        transitions.join(last, "form_id")
        .withColumn("upto", upto)
        .where(F.col("upto") >= after)
        .select("form_id", "question_id", "option_key", F.explode(F.sequence(after, F.col("upto"))).alias("ord"))
        .join(sections.select("form_id", "ord", "section_id"), ["form_id", "ord"])
    )


def routing_rules(
    transitions: DataFrame, sections: DataFrame, questions: DataFrame, scored: DataFrame | None = None
) -> DataFrame:
    """Confirmed rules: (question, option) -> questions that must stay empty / must be answered.

    ``scored`` lists questions that carry a score column; they cannot be a rule's source.
    Backward jumps and restarts give no rule.
    """
    source = transitions
    if scored is not None:
        source = source.join(scored.select("form_id", "question_id"), ["form_id", "question_id"], "left_anti")
    keys = ["form_id", "question_id", "option_key"]
    held = questions.select("form_id", F.col("question_id").alias("held"), F.col("section_ord").alias("ord"), "required")
    forbidden = (
        skipped_sections(source, sections).join(held, ["form_id", "ord"])
        .groupBy(*keys).agg(F.array_sort(F.collect_set("held")).alias("forbidden"))
    )
    last = sections.groupBy("form_id").agg(F.max("ord").alias("last_ord"))
    lands_on = F.when(F.col("dest_type") == "section", F.when(F.col("dest_ord") > F.col("source_ord"), F.col("dest_ord"))).when(
        (F.col("dest_type") == "next_section") & (F.col("source_ord") < F.col("last_ord")), F.col("source_ord") + 1
    )
    required = (
        source.join(last, "form_id").withColumn("ord", lands_on).where(F.col("ord").isNotNull())
        .join(held.where("required"), ["form_id", "ord"])
        .groupBy(*keys).agg(F.array_sort(F.collect_set("held")).alias("required"))
    )
    none = F.array().cast("array<string>")
    return forbidden.join(required, keys, "full").select(
        *keys, F.coalesce("forbidden", none).alias("forbidden"), F.coalesce("required", none).alias("required")
    )
