"""Several augmentation runs over disjoint scopes of one base revision, as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.operators.scope import Scope


def untouched(base: DataFrame, rules: dict[str, Scope]) -> DataFrame:
    """Base rows outside every rule's scope. Scopes are predicates, so no anti join is needed."""
    claimed = F.lit(False)
    for scope in rules.values():
        claimed = claimed | scope.predicate()
    return base.where(~claimed)


def not_claimed(base: DataFrame, child_rows: DataFrame) -> DataFrame:
    """Base rows that no child's recorded scope holds, by response id."""
    return base.join(child_rows.select("response_id").distinct(), "response_id", "left_anti")


def compose(base: DataFrame, rules: dict[str, Scope], children: DataFrame) -> DataFrame:
    """Remainder of the base plus the rows of every child run.

    ``children``: rule_id plus the columns of ``base`` (response_id, submitted_at, origin, ...).
    Synthetic ids get the rule as prefix, because two rules may share a seed.
    """
    columns = base.columns
    prefixed = children.withColumn(
        "response_id",
        F.when(F.col("origin") == "synthetic", F.concat_ws(":", "rule_id", "response_id")).otherwise(F.col("response_id")),
    )
    return untouched(base, rules).select(*columns).unionByName(prefixed.select(*columns))


def composite_checks(base: DataFrame, rules: dict[str, Scope], children: DataFrame, composed: DataFrame) -> DataFrame:
    """One row of counts: unique ids, and base + sum(final - scope) = total."""
    scope_rows = base.agg(
        F.count(F.lit(1)).alias("base_rows"),
        sum((F.count_if(scope.predicate()) for scope in rules.values()), F.lit(0)).alias("scope_rows"),
    )
    child = children.agg(F.count(F.lit(1)).alias("child_rows"))
    ids = composed.groupBy("response_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("composed_rows"), F.count(F.lit(1)).alias("distinct_ids")
    )
    # Three one-row tables side by side.
    return scope_rows.join(child).join(ids).select(
        "base_rows", "scope_rows", "child_rows", "composed_rows", "distinct_ids",
        (F.col("composed_rows") == F.col("base_rows") + F.col("child_rows") - F.col("scope_rows")).alias("count_holds"),
        (F.col("composed_rows") == F.col("distinct_ids")).alias("ids_unique"),
    )
