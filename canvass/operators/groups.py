"""Value groups: observed values, membership checks, member cells, overlaps, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.functions.labels import TRIMMED
from canvass.functions.slots import canonical_cell, group_value
from canvass.scale import hash_order, number_by_hash, prefix_sums
from canvass.schema import ANSWERED

GROUPABLE = ("single_choice", "text")


def observed_counts(slots: DataFrame) -> DataFrame:
    """Answered values of groupable questions with their frequency (empty text is no value)."""
    value = group_value()
    return (
        slots.where(F.col("kind").isin(*GROUPABLE))
        .select("form_id", "question_id", "kind", value.alias("value"))
        .where(F.col("value") != "")
        .groupBy("form_id", "question_id", "kind", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def observed_values(slots: DataFrame, options: DataFrame, questions: DataFrame) -> DataFrame:
    """Choice questions list every form option, zero-filled; text questions list what occurs.

    ``position`` is the form order for choices; text values have none (they are ordered by
    frequency at the sink).
    """
    counts = observed_counts(slots)
    choice = options.join(
        questions.where(F.col("kind") == "single_choice").select("form_id", "question_id"),
        ["form_id", "question_id"],
    ).select("form_id", "question_id", F.col("option_key").alias("value"), "label", F.col("ord").alias("position"))
    zero_filled = choice.join(
        counts.where(F.col("kind") == "single_choice").drop("kind"),
        ["form_id", "question_id", "value"], "left",
    ).select("form_id", "question_id", "value", "label", F.coalesce("count", F.lit(0)).alias("count"), "position")
    texts = counts.where(F.col("kind") == "text").select(
        "form_id", "question_id", "value", F.col("value").alias("label"), "count",
        F.lit(None).cast("int").alias("position"),
    )
    return zero_filled.unionByName(texts)


def value_page(values: DataFrame, size: int = 80) -> DataFrame:
    """The first page by (count desc, value) with ``has_more``: one top-k of size + 1."""
    top = values.orderBy(F.desc("count"), "value").limit(size + 1)
    rank = F.row_number().over(Window.orderBy(F.desc("count"), "value"))
    ranked = top.withColumn("rank", rank)
    more = F.max("rank").over(Window.partitionBy()) > size
    return ranked.withColumn("has_more", more).where(F.col("rank") <= size)


def ranked_values(values: DataFrame) -> DataFrame:
    """All values with their ``rank`` by (count desc, value), numbered over range partitions."""
    return prefix_sums(values, [F.desc("count"), "value"], {"rank": F.lit(1).cast("long")})


def clean_groups(groups: DataFrame) -> DataFrame:
    """Trim names and drop empty and repeated members, keeping first positions.

    Input: form_id, group_id, question_id, name, members array<string>. ``error`` is set
    when the name or the member list ends up empty.
    """
    members = F.array_distinct(F.filter("members", lambda m: F.length(m) > 0))
    return groups.select(
        "form_id", "group_id", "question_id", F.btrim(F.col("name"), F.lit(TRIMMED)).alias("name"), members.alias("members")
    ).withColumn(
        "error",
        F.when(F.col("name") == "", "name_required").when(F.size("members") == 0, "members_required"),
    )


def unknown_members(members: DataFrame, values: DataFrame) -> DataFrame:
    """Members that are neither form options nor observed texts."""
    known = values.select("form_id", "question_id", F.col("value").alias("member"))
    return members.join(known, ["form_id", "question_id", "member"], "left_anti")


def invalid_groups(members: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """Groups whose question vanished or is not groupable, or with a vanished option key."""
    groups = members.select("form_id", "group_id", "question_id").distinct()
    groupable = questions.where(F.col("kind").isin(*GROUPABLE)).select("form_id", "question_id")
    orphaned = groups.join(groupable, ["form_id", "question_id"], "left_anti")
    choice = questions.where(F.col("kind") == "single_choice").select("form_id", "question_id")
    vanished = (
        members.join(choice, ["form_id", "question_id"])
        .join(
            options.select("form_id", "question_id", F.col("option_key").alias("member")),
            ["form_id", "question_id", "member"], "left_anti",
        )
        .select("form_id", "group_id", "question_id")
    )
    return orphaned.unionByName(vanished).distinct()


def group_overlaps(members: DataFrame) -> DataFrame:
    """For every group, how many other groups of its question share a member.

    Groups are numbered per question, every member gets bitmaps of the groups that list it, and a
    group's overlaps are the bits of its members' bitmaps put together. No pair of groups is ever a
    row: a member listed by n groups costs n bits for each distinct set it is in. Groups with
    equal sets share that work.
    """
    keys = ["form_id", "question_id"]
    sets = members.groupBy(*keys, "group_id").agg(F.array_sort(F.collect_set("member")).alias("member_set"))
    numbered = number_by_hash(sets, keys, hash_order(1, "group_id"), tie=["group_id"], out="no")
    bits = numbered.select(
        *keys, F.explode("member_set").alias("member"), F.bitmap_bucket_number("no").alias("bucket"), F.bitmap_bit_position("no").alias("bit")
    ).groupBy(*keys, "member", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    listed = sets.select(*keys, "member_set").distinct().select(*keys, "member_set", F.explode("member_set").alias("member"))
    overlapping = (
        listed.join(bits, [*keys, "member"])
        .groupBy(*keys, "member_set", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
        .groupBy(*keys, "member_set").agg((F.sum("n") - 1).alias("overlapping_groups"))
    )
    return sets.join(overlapping, [*keys, "member_set"], "left").select(
        *keys, "group_id", F.coalesce("overlapping_groups", F.lit(0)).cast("long").alias("overlapping_groups")
    )


def observed_cells(slots: DataFrame) -> DataFrame:
    """Distinct answered cells per question; the hash aggregate removes repeats before the shuffle."""
    return slots.where(F.col("state") == ANSWERED).select(
        "form_id", "question_id", "kind", group_value().alias("member"), "option_keys",
        canonical_cell().alias("cell"),
    ).distinct()


def schema_option_cell(kind: str, option_key: Column, label: Column) -> Column:
    """The cell a form option would have if someone had chosen it alone."""
    single = kind == "single_choice"
    value = (
        F.struct(F.lit(kind).alias("kind"), option_key.alias("optionKey"), label.alias("label"))
        if single
        else F.struct(
            F.lit(kind).alias("kind"), F.array(option_key).alias("optionKeys"), F.array(label).alias("labels")
        )
    )
    return F.to_json(F.struct(F.lit(ANSWERED).alias("state"), value.alias("value")))


def group_member_cells(slots: DataFrame, members: DataFrame, options: DataFrame) -> DataFrame:
    """Cells of a group: observed member cells plus form-backed option cells."""
    keys = ["form_id", "question_id", "member"]
    own = members.select("form_id", "group_id", "question_id", "member").distinct()
    seen = observed_cells(slots.where(F.col("kind").isin(*GROUPABLE))).join(own, keys)
    backed = options.select(
        "form_id", "question_id", F.col("option_key").alias("member"),
        schema_option_cell("single_choice", F.col("option_key"), F.col("label")).alias("cell"),
    ).join(own, keys)
    columns = ["form_id", "group_id", "question_id", "cell"]
    return seen.select(*columns).unionByName(backed.select(*columns)).distinct()


def option_cells(slots: DataFrame) -> DataFrame:
    """Checkbox option -> observed answered cells that contain it."""
    cells = observed_cells(slots.where(F.col("kind") == "multi_choice"))
    return cells.select(
        "form_id", "question_id", F.explode(F.array_distinct("option_keys")).alias("option_key"), "cell"
    ).distinct()


def option_support(slots: DataFrame, options: DataFrame) -> DataFrame:
    """Observed cells of each checkbox option, or one form-backed cell when none occurs.

    ``options`` holds the checkbox options; ``schema_backed`` marks the fallback cells.
    """
    keys = ["form_id", "question_id", "option_key"]
    seen = option_cells(slots)
    backed = schema_option_cell("multi_choice", F.col("option_key"), F.col("label"))
    return options.select(*keys, "label").join(seen, keys, "left").select(
        *keys,
        F.coalesce("cell", backed).alias("cell"),
        F.col("cell").isNull().alias("schema_backed"),
    )


def targets_using_group(targets: DataFrame) -> DataFrame:
    """(draft, target, group) for every target whose subject or population is a value group."""
    return targets.where(F.col("group_id").isNotNull()).select("draft_id", "target_id", "group_id")


def repair_targets(targets: DataFrame, removed_groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets that depend on removed groups, and the drafts' targets without them."""
    keys = ["form_id", "group_id"]
    dependents = targets.join(removed_groups.select(*keys).distinct(), keys, "left_semi")
    kept = targets.join(removed_groups.select(*keys).distinct(), keys, "left_anti")
    return dependents, kept
