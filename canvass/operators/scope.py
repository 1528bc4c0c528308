"""Source scopes: all responses, or an inclusive window of submission times."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """``start`` / ``end`` are ISO timestamps in UTC; both empty means every response."""

    start: str | None = None
    end: str | None = None

    def __post_init__(self) -> None:
        if self.start and self.end and self.start > self.end:
            raise ValueError("scope start must not be after its end")

    def predicate(self, column: str = "submitted_at") -> Column:
        ts = F.col(column)
        keep = F.lit(True)
        if self.start:
            keep = keep & (ts >= F.lit(self.start).cast("timestamp_ntz"))
        if self.end:
            keep = keep & (ts <= F.lit(self.end).cast("timestamp_ntz"))
        return keep


def in_scope(df: DataFrame, scope: Scope, column: str = "submitted_at") -> DataFrame:
    """Plain comparison on the stored column, so that the bound reaches the Parquet scan."""
    return df.where(scope.predicate(column)) if scope.start or scope.end else df


def scope_overlaps(df: DataFrame, rules: dict[str, Scope], id_column: str = "response_id") -> DataFrame:
    """Responses claimed by two or more rules, with the first two rules in rule order.

    Claims are worked out inside each row: no join and no shuffle.
    """
    claims = F.filter(
        F.array(*[F.when(scope.predicate(), F.lit(rule)) for rule, scope in rules.items()]),
        lambda rule: rule.isNotNull(),
    )
    return (
        df.select(F.col(id_column), claims.alias("claims"))
        .where(F.size("claims") > 1)
        .select(
            id_column,
            F.col("claims")[0].alias("first_rule"),
            F.col("claims")[1].alias("second_rule"),
            F.size("claims").alias("claim_count"),
        )
    )


def timestamp_range(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min("submitted_at").alias("first_submitted_at"),
        F.max("submitted_at").alias("last_submitted_at"),
    )
