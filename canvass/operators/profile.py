"""Counts, shares, means, distributions and conditional shares of every form in one pass.

The whole profile needs two aggregates. Slots are counted by content before the shuffle: what
crosses the network is one row per (form, question, content) and task, however skewed the
forms are, and no metric scans the responses again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.slots import eligible, explode_slots, group_value
from canvass.scale import broadcast_if_small
from canvass.schema import ANSWERED
from canvass.session import materialise


def share_of(count: Column, denominator: Column) -> Column:
    """Profile shares of an empty denominator are 0."""
    return F.when(denominator > 0, count / denominator).otherwise(F.lit(0.0))


def with_scores(slots: DataFrame, score_map: DataFrame | None = None) -> DataFrame:
    """``mapped_score``: ordinal value, or the Likert score of a single-choice option."""
    if score_map is None:
        return slots.withColumn(
            "mapped_score", F.when(F.col("state") == ANSWERED, F.col("score"))
        )
    scored = slots.join(
        score_map.select("form_id", "question_id", "option_key", F.col("score").alias("__likert")),
        ["form_id", "question_id", "option_key"],
        "left",
    )
    return scored.withColumn(
        "mapped_score",
        F.when(
            F.col("state") == ANSWERED,
            F.coalesce(
                F.when(F.col("kind") == "ordinal", F.col("score")),
                F.when(F.col("kind") == "single_choice", F.col("__likert")),
            ),
        ),
    ).drop("__likert")


def question_rows(slots: DataFrame, score_map: DataFrame | None = None) -> DataFrame:
    """One row per (form, question): eligible, option -> count, score -> count.

    Slots are first counted by content (state, picked options, score): one plain hash
    aggregate over the long table. Everything else, the Likert join and the unpacking of
    checkbox combinations included, works on those few cells. The maps hold what a form
    defines (options, scores), never free text.
    """
    cells = slots.groupBy("form_id", "question_id", "kind", "state", "option_key", "option_keys", "score").agg(
        F.count(F.lit(1)).alias("n")
    )
    rows = with_scores(cells, score_map)
    answered = F.col("state") == ANSWERED
    fact = lambda name, key: F.struct(F.lit(name).alias("fact"), key.cast("string").alias("key"))
    picks = F.when(answered & (F.col("kind") == "single_choice"), F.array("option_key")).when(
        answered & (F.col("kind") == "multi_choice"), F.array_distinct("option_keys")
    )
    facts = F.concat(
        F.when(eligible(F.col("state")), F.array(fact("eligible", F.lit(None)))).otherwise(F.array()),
        F.coalesce(F.transform(picks, lambda k: fact("option", k)), F.array()),
        F.when(
            F.col("mapped_score").isNotNull(), F.array(fact("score", F.col("mapped_score")))
        ).otherwise(F.array()),
    )
    counted = (
        rows.select("form_id", "question_id", "n", F.explode_outer(facts).alias("f")).where(F.col("f").isNotNull())
        .groupBy("form_id", "question_id", F.col("f.fact").alias("fact"), F.col("f.key").alias("key"))
        .agg(F.sum("n").alias("n"))
    )
    pairs = lambda name: F.map_from_entries(
        F.filter(F.collect_list(F.when(F.col("fact") == name, F.struct("key", "n"))), lambda e: e["key"].isNotNull())
    )
    return counted.groupBy("form_id", "question_id").agg(
        F.sum(F.when(F.col("fact") == "eligible", F.col("n"))).alias("eligible"),
        pairs("option").alias("option_counts"), pairs("score").alias("score_counts"),
    )


def option_metrics(rows: DataFrame, options: DataFrame) -> DataFrame:
    """Count and share of every form option, single choice and checkbox, zero-filled."""
    n = F.coalesce(F.element_at("option_counts", F.col("option_key")), F.lit(0))
    d = F.coalesce("eligible", F.lit(0))
    return options.select("form_id", "question_id", "option_key").join(
        rows, ["form_id", "question_id"], "left"
    ).select(
        "form_id", "question_id", "option_key",
        n.alias("count"), d.alias("denominator_count"), share_of(n, d).alias("share"),
    )


def _score_sums(rows: DataFrame) -> DataFrame:
    entries = F.coalesce(F.map_entries("score_counts"), F.array().cast("array<struct<key:string,value:bigint>>"))
    zero = F.lit(0).cast("long")
    return rows.withColumn("answered", F.aggregate(entries, zero, lambda acc, e: acc + e["value"])).withColumn(
        "total", F.aggregate(entries, zero, lambda acc, e: acc + e["key"].cast("long") * e["value"])
    )


def mean_metrics(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Mean over answered scores for every scored question; an empty one has mean 0."""
    joined = _score_sums(questions.select("form_id", "question_id").join(rows, ["form_id", "question_id"], "left"))
    return joined.select(
        "form_id", "question_id", F.col("answered").alias("denominator_count"),
        share_of(F.col("total"), F.col("answered")).alias("mean"),
    )


def ordinal_distribution(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Count and share of every value in [ceil(min), floor(max)], zero-filled.

    ``bounds`` has form_id, question_id, min, max.
    """
    values = bounds.where(F.ceil("min") <= F.floor("max")).select(
        "form_id", "question_id",
        F.explode(F.sequence(F.ceil("min").cast("long"), F.floor("max").cast("long"))).alias("value"),
    )
    joined = _score_sums(values.join(rows, ["form_id", "question_id"], "left"))
    n = F.coalesce(F.element_at("score_counts", F.col("value").cast("string")), F.lit(0))
    d = F.col("answered")
    return joined.select(
        "form_id", "question_id", "value",
        n.alias("count"), d.alias("denominator_count"), share_of(n, d).alias("share"),
    )


def group_members(members: DataFrame) -> DataFrame:
    return members.select("form_id", "group_id", "question_id", "member").distinct()


def group_hits(responses: DataFrame, members: DataFrame) -> DataFrame:
    """(response, group) pairs, carrying the response's eligible checkbox slots.

    Exploding inside the row and carrying the checkbox slots along replaces the self join
    that a long table would need for conditional shares. Members are broadcast after a count
    of them, so that values of no group never leave their task.
    """
    checks = F.transform(
        F.filter("answers", lambda a: (a["kind"] == "multi_choice") & eligible(a["state"])),
        lambda a: F.struct(
            a["question_id"].alias("question_id"), a["state"].alias("state"), a["option_keys"].alias("option_keys")
        ),
    )
    values = F.filter(
        F.transform(
            "answers",
            lambda a: F.struct(a["question_id"].alias("question_id"), group_value(a).alias("member")),
        ),
        lambda v: v["member"].isNotNull(),
    )
    return (
        responses.select("form_id", "response_id", checks.alias("checks"), F.explode_outer(values).alias("v"))
        .where(F.col("v").isNotNull())
        .select("form_id", "response_id", "checks", "v.question_id", "v.member")
        .join(broadcast_if_small(group_members(members)), ["form_id", "question_id", "member"])
    )


def group_cells(responses: DataFrame, members: DataFrame) -> DataFrame:
    """(form, group, question, option, n): all that group metrics need, as facts of the group's responses.

    A fact without a question counts the group, one without an option the eligible cells of a
    checkbox question. Facts are made in the response's row and added up before they move: what is
    shuffled is bounded by groups times options, however many checkbox questions there are.
    """
    picked = lambda c: F.when(
        c["state"] == ANSWERED, F.coalesce(F.array_distinct(c["option_keys"]), F.array())
    ).otherwise(F.array())
    fact = lambda question, option: F.struct(question.alias("question_id"), option.alias("option_key"))
    none = F.lit(None).cast("string")
    of_checks = F.flatten(F.transform(
        "checks", lambda c: F.transform(F.concat(F.array(none), picked(c)), lambda k: fact(c["question_id"], k))
    ))
    return (
        group_hits(responses, members)
        .select("form_id", "group_id", F.explode(F.concat(F.array(fact(none, none)), of_checks)).alias("f"))
        .groupBy("form_id", "group_id", "f.question_id", "f.option_key").agg(F.count(F.lit(1)).alias("n"))
    )


def group_metrics(cells: DataFrame, rows: DataFrame, members: DataFrame) -> DataFrame:
    """Count and share of every value group; groups may overlap."""
    counts = cells.where(F.col("question_id").isNull()).select("form_id", "group_id", "n")
    n, d = F.coalesce("n", F.lit(0)), F.coalesce("eligible", F.lit(0))
    return (
        members.select("form_id", "group_id", "question_id").distinct()
        .join(counts, ["form_id", "group_id"], "left")
        .join(rows.select("form_id", "question_id", "eligible"), ["form_id", "question_id"], "left")
        .select(
            "form_id", "group_id", "question_id",
            n.alias("count"), d.alias("denominator_count"), share_of(n, d).alias("share"),
        )
    )


def conditional_metrics(cells: DataFrame, members: DataFrame, options: DataFrame) -> DataFrame:
    """Among group members with an eligible checkbox cell, the share that holds each option.

    ``options`` lists the checkbox options to report.
    """
    counts = cells.where(F.col("question_id").isNotNull())
    # The null key counts the population; the map holds the options of one question.
    per_question = counts.groupBy("form_id", "group_id", "question_id").agg(
        F.sum(F.when(F.col("option_key").isNull(), F.col("n"))).alias("population"),
        F.map_from_entries(
            F.filter(F.collect_list(F.struct("option_key", "n")), lambda e: e["option_key"].isNotNull())
        ).alias("option_counts"),
    )
    n = F.coalesce(F.element_at("option_counts", F.col("option_key")), F.lit(0))
    d = F.coalesce("population", F.lit(0))
    return (
        members.select("form_id", "group_id").distinct()
        .join(options.select("form_id", "question_id", "option_key"), "form_id")
        .join(per_question, ["form_id", "group_id", "question_id"], "left")
        .select(
            "form_id", "group_id", "question_id", "option_key",
            n.alias("count"), d.alias("denominator_count"), share_of(n, d).alias("share"),
        )
    )


def profile(
    responses: DataFrame,
    questions: DataFrame,
    options: DataFrame,
    members: DataFrame,
    score_map: DataFrame | None = None,
) -> DataFrame:
    """Every metric of every form in one long table.

    ``questions`` has form_id, question_id, kind, min, max; questions of the score map are
    scored from 1 to 5. Columns: form_id, metric, group_id, question_id, item, count,
    denominator_count, value.
    """
    # Two aggregates read the responses; their few result rows are written once and feed every metric.
    facts = materialise(question_rows(explode_slots(responses), score_map))
    cells = materialise(group_cells(responses, members))
    bounds = questions.where(F.col("kind") == "ordinal").select("form_id", "question_id", "min", "max")
    if score_map is not None:
        bounds = bounds.unionByName(
            score_map.select("form_id", "question_id").distinct().select(
                "form_id", "question_id", F.lit(1).alias("min"), F.lit(5).alias("max")
            )
        )
    checkbox = options.join(
        questions.where(F.col("kind") == "multi_choice").select("form_id", "question_id"),
        ["form_id", "question_id"],
    )

    def rows(df: DataFrame, metric: str, item: Column, value: str, group: Column | None = None) -> DataFrame:
        none = F.lit(None).cast("string")
        count = F.col("count") if "count" in df.columns else F.lit(None).cast("long")
        return df.select(
            "form_id", F.lit(metric).alias("metric"),
            (none if group is None else group).alias("group_id"), "question_id",
            item.cast("string").alias("item"), count.alias("count"), "denominator_count",
            F.col(value).alias("value"),
        )

    none = F.lit(None).cast("string")
    return (
        rows(option_metrics(facts, options), "option", F.col("option_key"), "share")
        .unionByName(rows(mean_metrics(facts, bounds), "mean", none, "mean"))
        .unionByName(rows(ordinal_distribution(facts, bounds), "distribution", F.col("value"), "share"))
        .unionByName(
            rows(group_metrics(cells, facts, members), "value_group", none, "share", F.col("group_id"))
        )
        .unionByName(
            rows(
                conditional_metrics(cells, members, checkbox),
                "conditional_share", F.col("option_key"), "share", F.col("group_id"),
            )
        )
    )
