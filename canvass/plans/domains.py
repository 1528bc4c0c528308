"""What candidates may hold: time range, category domains, and refusals before anything is generated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions.slots import cell_schema_backed


class SupportRefused(ValueError):
    """A source or target that no candidate can be generated for."""


def valid_time(time: Column, first: Any, last: Any) -> Column:
    """The time is there and inside [first, last]; an open side is None."""
    inside = F.lit(True)
    if first is not None:
        inside = inside & (time >= F.lit(first))
    if last is not None:
        inside = inside & (time <= F.lit(last))
    return F.coalesce(time.isNotNull() & inside, F.lit(False))


def in_domains(rows: DataFrame, allowed: Mapping[str, DataFrame]) -> DataFrame:
    """Rows whose value of every named column is one of the allowed ones (a table with that column each)."""
    for column, values in allowed.items():
        rows = rows.join(values.select(column).distinct(), column, "left_semi")
    return rows


def category_check(source: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, rows, nulls, valid: a modelled category is text and never null. One pass for all columns."""
    text = {f.name: isinstance(f.dataType, T.StringType) for f in source.schema.fields}
    counted = source.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(x).isNull()).alias(f"n{i}") for i, x in enumerate(columns)]
    )
    found = [
        F.struct(F.lit(x).alias("column"), F.col("rows"), F.col(f"n{i}").alias("nulls"), ((F.col(f"n{i}") == 0) & F.lit(text[x])).alias("valid"))
        for i, x in enumerate(columns)
    ]
    return counted.select(F.inline(F.array(*found)))


def support_refusals(source: DataFrame, job) -> DataFrame:
    """target_id, column, value, code of members that neither occur in the source nor stand in its form.

    Members of shares and counts, and schema members of conditionals, may be unseen if they are answered
    slots of the form; a population has to occur, and so has any other option. Targets on columns that
    are not modelled are refused whole.
    """
    spark = source.sparkSession
    wanted: list[tuple[str, str, str, str, bool]] = []
    for t in (*job.shares, *job.counts):
        wanted += [(t.id, t.column, v, "unseen_member", True) for v in t.members]
    for t in job.conditionals:
        wanted += [(t.id, t.population_column, v, "unseen_population", False) for v in t.population_members]
        wanted += [(t.id, t.option_column, v, "unseen_option", v in t.schema_members) for v in t.option_members]
        wanted += [(t.id, t.option_column, v, "schema_member_outside", False) for v in t.schema_members - t.option_members]
    schema = "target_id string, column string, value string, code string, from_form boolean"
    members = spark.createDataFrame(wanted, schema)
    columns = sorted({w[1] for w in wanted} & set(job.categorical))
    cells = [F.struct(F.lit(x).alias("column"), F.col(x).cast("string").alias("value")) for x in columns]
    observed = source.select(F.explode(F.array(*cells)).alias("c")).select("c.column", "c.value").distinct() if cells else members.limit(0).select("column", "value")
    known = members.join(observed.withColumn("seen", F.lit(True)), ["column", "value"], "left")
    fine = F.coalesce("seen", F.lit(False)) | (F.col("from_form") & cell_schema_backed(F.col("value")))
    outside = ~F.col("column").isin(list(job.categorical)) if job.categorical else F.lit(True)
    code = F.when(outside, "not_categorical").when(~fine | (F.col("code") == "schema_member_outside"), F.col("code"))
    return known.select("target_id", "column", "value", code.alias("code")).where("code is not null")


def refuse_unsupported(source: DataFrame, job) -> None:
    """Stop before a model is fitted, naming what cannot be generated."""
    if job.categorical:
        bad = [r["column"] for r in category_check(source, job.categorical).where("not valid").collect()]
        if bad:
            raise SupportRefused(f"categorical source columns must hold text and no nulls: {', '.join(bad)}")
    if job.shares or job.counts or job.conditionals:
        refused = support_refusals(source, job).orderBy("target_id", "column", "value").limit(5).collect()
        if refused:
            raise SupportRefused("; ".join(f"{r['code']}: {r['value']} of {r['target_id']} in {r['column']}" for r in refused))
