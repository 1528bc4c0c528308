"""Strict answer parsers as column expressions.

Each parser returns ``struct<value, error>``: exactly one side is set for a non-null input.
``failures`` turns a parsed column into a count, and ``strict`` fails the job on the first
bad value where the caller wants the all-or-nothing contract.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Answer formats and numeric bounds. \z, not $: Java lets $ match before a final line break.
ORDINAL_PATTERN = r"^-?[0-9]+\z"
DATE_PATTERN = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})\z"
DATETIME_PATTERN = r"^([0-9]{4})-([0-9]{2})-([0-9]{2}) ([0-9]{2}):([0-9]{2})\z"
YEARLESS_DATE_PATTERN = r"^([0-9]{2})-([0-9]{2})\z"
YEARLESS_DATETIME_PATTERN = r"^([0-9]{2})-([0-9]{2}) ([0-9]{2}):([0-9]{2})\z"
TIME_PATTERN = r"^([0-9]{2}):([0-9]{2})\z"
EXPORT_TIME_PATTERN = r"^([0-9]+):([0-9]{2})\z"
MAX_SAFE_INTEGER = 9007199254740991
LEAP_YEAR_FOR_YEARLESS_DATES = 2000


def _result(ok: Column, value: Column, error: str) -> Column:
    passed = F.coalesce(ok, F.lit(False))
    return F.struct(
        F.when(passed, value).alias("value"),
        F.when(~passed, F.lit(error)).alias("error"),
    )


def parse_ordinal(raw: Column, minimum: Column, maximum: Column) -> Column:
    number = F.when(raw.rlike(ORDINAL_PATTERN), raw.try_cast("decimal(38,0)"))
    ok = (
        number.isNotNull()
        & (F.abs(number) <= F.lit(MAX_SAFE_INTEGER))
        & number.between(minimum, maximum)
    )
    return _result(ok, number.cast("long"), "invalid_ordinal")


def _int_group(raw: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(raw, pattern, group).try_cast("int")


def valid_calendar_date(year: Column, month: Column, day: Column) -> Column:
    """Year 1..9999 and a day the proleptic calendar has; plain arithmetic, so it stays in generated code."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce(
        year.between(1, 9999) & month.between(1, 12) & (day >= 1) & (day <= last), F.lit(False)
    )


def valid_clock_time(hour: Column, minute: Column) -> Column:
    return F.coalesce(hour.between(0, 23) & minute.between(0, 59), F.lit(False))


def parse_date(raw: Column, include_year: Column, include_time: Column) -> Column:
    shapes = (
        (include_year & include_time, DATETIME_PATTERN, 1, True),
        (include_year & ~include_time, DATE_PATTERN, 1, False),
        (~include_year & include_time, YEARLESS_DATETIME_PATTERN, 0, True),
        (~include_year & ~include_time, YEARLESS_DATE_PATTERN, 0, False),
    )
    ok = F.lit(False)
    for applies, pattern, shift, timed in shapes:
        year = _int_group(raw, pattern, 1) if shift else F.lit(LEAP_YEAR_FOR_YEARLESS_DATES)
        good = raw.rlike(pattern) & valid_calendar_date(
            year, _int_group(raw, pattern, 1 + shift), _int_group(raw, pattern, 2 + shift)
        )
        if timed:
            good = good & valid_clock_time(
                _int_group(raw, pattern, 3 + shift), _int_group(raw, pattern, 4 + shift)
            )
        ok = F.when(applies, good).otherwise(ok)
    return _result(ok, raw, "invalid_date")


def parse_time(raw: Column, duration: Column) -> Column:
    hour, minute = _int_group(raw, TIME_PATTERN, 1), _int_group(raw, TIME_PATTERN, 2)
    ok = raw.rlike(TIME_PATTERN) & (minute <= 59) & (duration | (hour <= 23))
    return _result(ok, raw, "invalid_time")


def submission_time(last_submitted: Column, created: Column) -> Column:
    """Last submission, else creation; null when neither parses."""
    return F.try_to_timestamp(
        F.coalesce(F.when(last_submitted != "", last_submitted), created)
    )


def valid_score(score: Column, minimum: Column, maximum: Column) -> Column:
    """Whole number within 1e-9 and inside the ordinal domain; null is not valid."""
    nearest = F.rint(score)
    return F.coalesce(
        (F.abs(score - nearest) <= F.lit(1e-9)) & nearest.between(minimum, maximum), F.lit(False)
    )


def half_up(value: Column) -> Column:
    """floor(x + 0.5), the rounding of plans and previews."""
    return F.floor(value + F.lit(0.5))


def half_even(value: Column) -> Column:
    """Banker's rounding, used for request weights and generated scores."""
    return F.rint(value)
