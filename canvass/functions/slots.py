"""Predicates and projections over answer slots and their JSON cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.schema import ANSWERED, ELIGIBLE_STATES, SLOT_FIELDS, STATES


def eligible(state: Column) -> Column:
    """Share denominators hold answered and skipped slots only."""
    return F.coalesce(state.isin(*ELIGIBLE_STATES), F.lit(False))


def cell_state(cell: Column) -> Column:
    return F.get_json_object(cell, "$.state")


def cell_eligible(cell: Column) -> Column:
    """JSON cell form: a cell that is no slot, or has an unknown state, counts as eligible.

    The cell is read once and the answer is never null, so that joins and aggregates on it need no
    filter that would read the cell again.
    """
    return F.coalesce(~cell_state(cell).isin(*[s for s in STATES if s not in ELIGIBLE_STATES]), F.lit(True))


def cell_answered(cell: Column) -> Column:
    return F.coalesce(cell_state(cell) == ANSWERED, F.lit(False))


def cell_answered_option(cell: Column, option_key: str | Column) -> Column:
    """The cell is an answered single choice that holds this option."""
    key = F.lit(option_key) if isinstance(option_key, str) else option_key
    return F.coalesce(
        (cell_state(cell) == ANSWERED)
        & (F.get_json_object(cell, "$.value.kind") == "single_choice")
        & (F.get_json_object(cell, "$.value.optionKey") == key),
        F.lit(False),
    )


def cell_schema_backed(cell: Column) -> Column:
    """An answered JSON slot whose value is an object."""
    return F.coalesce(
        (cell_state(cell) == ANSWERED)
        & F.get_json_object(cell, "$.value").startswith("{"),
        F.lit(False),
    )


def cell_valid(cell: Column) -> Column:
    """A generated cell must be a JSON object with one of the four states."""
    return F.coalesce(
        cell.isNotNull() & F.ltrim(cell).startswith("{") & cell_state(cell).isin(*STATES), F.lit(False)
    )


def group_value(slot: Column | None = None, prefix: str = "") -> Column:
    """The value a value group matches on: option key of a single choice, text of a text answer."""
    get = (lambda n: slot[n]) if slot is not None else (lambda n: F.col(prefix + n))
    return F.when(
        get("state") == ANSWERED,
        F.when(get("kind") == "single_choice", get("option_key")).when(
            get("kind") == "text", get("text")
        ),
    )


def canonical_cell(prefix: str = "") -> Column:
    """Cell identity: the slot as JSON with fixed field order and without nulls."""
    col = lambda n: F.col(prefix + n)
    kind = col("kind")
    value = F.when(
        col("state") == ANSWERED,
        F.struct(
            kind.alias("kind"),
            col("option_key").alias("optionKey"),
            F.when(kind == "single_choice", col("label")).alias("label"),
            col("option_keys").alias("optionKeys"),
            F.when(kind == "multi_choice", col("labels")).alias("labels"),
            col("other_value").alias("otherValue"),
            F.when(kind == "ordinal", col("score")).alias("value"),
            F.when(kind.isin("text", "date", "time"), col("text")).alias("text"),
        ),
    )
    return F.to_json(F.struct(col("state").alias("state"), value.alias("value")))


def explode_slots(responses: DataFrame, *carry: str) -> DataFrame:
    """Row form to long form: one row per (response, question); no shuffle.

    The outer explode keeps Spark from adding a ``size(answers) > 0`` filter, which would
    evaluate the expression behind ``answers`` a second time.
    """
    base = [c for c in ("form_id", "response_id", "submitted_at", *carry) if c in responses.columns]
    return responses.select(*base, F.explode_outer("answers").alias("s")).where(F.col("s").isNotNull()).select(
        *base, *[F.col(f"s.{name}").alias(name) for name in SLOT_FIELDS]
    )


def slot(**fields: Column) -> Column:
    """Build a slot struct; absent fields are typed nulls."""
    types = {
        "option_keys": "array<string>", "labels": "array<string>", "values": "array<string>",
        "files": "array<struct<file_name:string,mime_type:string>>", "score": "int",
    }
    return F.struct(
        *[
            fields.get(name, F.lit(None)).cast(types.get(name, "string")).alias(name)
            for name in SLOT_FIELDS
        ]
    )
