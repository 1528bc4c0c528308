"""Label keys: Unicode compatibility form, Likert scales, spreadsheet-safe text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Agreement scales recognised as five-point Likert, best first (score 5 to 1).
LIKERT_SCALES = (
    ("매우 그렇다", "그렇다", "보통이다", "그렇지 않다", "전혀 그렇지 않다"),
    ("Strongly Agree", "Agree", "Neutral", "Disagree", "Strongly Disagree"),
    ("非常认同", "比较认同", "一般", "比较不认同", "非常不认同"),
    ("非常にそう思う", "ややそう思う", "どちらともいえない", "あまりそう思わない", "全くそう思わない"),
)
# Fixed value: the characters that trimming removes, as literal characters for strip and btrim.
TRIMMED = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Fixed value: text a spreadsheet would run as a formula.
FORMULA_PREFIX = rf"^[{TRIMMED}\x00-\x1f]*[=+\-@]"


def label_keys(values: Column) -> Column:
    """NFKC + trim of every string in an array column (Spark has no Unicode normal forms)."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def normal_forms(batch):
        import unicodedata

        return batch.map(
            lambda items: None
            if items is None
            else [None if v is None else unicodedata.normalize("NFKC", v).strip(TRIMMED) for v in items]
        )

    return normal_forms(values)


def likert_label(label: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(label, F.lit(TRIMMED)), f"[{TRIMMED}]+", " "))


def likert_score_of(label_key: Column, scale: int) -> Column:
    """Score of a normalised label inside one scale, or null."""
    entries = [
        part
        for index, text in enumerate(LIKERT_SCALES[scale])
        for part in (F.lit(text.lower()), F.lit(5 - index))
    ]
    return F.element_at(F.create_map(*entries), label_key)


def spreadsheet_safe(text: Column) -> Column:
    return F.when(text.rlike(FORMULA_PREFIX), F.concat(F.lit("'"), text)).otherwise(text)
