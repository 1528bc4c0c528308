"""Wide tables for modelling and selection, and the way back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.slots import canonical_cell
from canvass.schema import ANSWERED


def flat_table(
    responses: DataFrame,
    questions: Sequence[str],
    scored: Mapping[str, Mapping[str, int] | None] | None = None,
) -> DataFrame:
    """response_id, submitted_at, ``score_<q>`` for scored questions, ``q_<q>`` cells for all.

    ``scored`` maps a question to None (ordinal) or to its option scores. Slots are picked out
    of the response's own array, so the pivot needs no shuffle.
    """
    scored = dict(scored or {})
    pick = lambda q: F.try_element_at(F.filter("answers", lambda a: a["question_id"] == q), F.lit(1))
    wanted = list(dict.fromkeys([*questions, *scored]))
    base = [x for x in ("form_id", "response_id", "submitted_at", "origin") if x in responses.columns]
    slots = responses.select(*base, *[pick(q).alias(f"s_{q}") for q in wanted])
    columns = []
    for q, mapping in scored.items():
        s = F.col(f"s_{q}")
        value = s["score"].cast("double")
        if mapping:
            pairs = [F.lit(x) for kv in mapping.items() for x in (kv[0], float(kv[1]))]
            value = F.element_at(F.create_map(*pairs), s["option_key"])
        columns.append(F.when(s["state"] == ANSWERED, value).alias(f"score_{q}"))
    return slots.select(*base, *columns, *[canonical_cell(f"s_{q}.").alias(f"q_{q}") for q in questions])


def wrong_scores(slots: DataFrame, scored_ids: Sequence[str], score_map: DataFrame) -> DataFrame:
    """Answered slots of scored questions that carry neither an ordinal nor a mapped option."""
    mapped = score_map.select("form_id", "question_id", "option_key", F.lit(True).alias("mapped"))
    return (
        slots.where(F.col("question_id").isin(*scored_ids) & (F.col("state") == ANSWERED))
        .join(mapped, ["form_id", "question_id", "option_key"], "left")
        .where((F.col("kind") != "ordinal") & F.col("mapped").isNull())
    )


def decode_result(result: DataFrame, source: DataFrame) -> DataFrame:
    """Result rows with their source payload; originals without a source row set ``problem``."""
    payload = source.select("response_id", F.struct(*[x for x in source.columns if x != "response_id"]).alias("source"))
    joined = result.join(payload, "response_id", "left")
    return joined.withColumn(
        "problem",
        F.when(~F.coalesce(F.col("origin").isin("original", "synthetic"), F.lit(False)), "invalid_origin")
        .when((F.col("origin") == "original") & F.col("source").isNull(), "unknown_source_row")
        .when(F.col("submitted_at").isNull(), "invalid_timestamp"),
    )
