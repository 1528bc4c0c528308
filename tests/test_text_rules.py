"""Final line breaks, trimmed characters, and ranks over all values."""

from pyspark.sql import functions as F

from canvass.functions import labels as L
from canvass.functions import parsing as Q
from canvass.operators import groups as G


def test_final_line_break_is_refused(spark):
    df = spark.createDataFrame([("5\n", "2024-01-05\n", "10:30\n"), ("5", "2024-01-05", "10:30")], "n string, d string, t string")
    yes, no = F.lit(True), F.lit(False)
    got = df.select(
        Q.parse_ordinal(F.col("n"), F.lit(1), F.lit(9)).error.isNull(), Q.parse_date(F.col("d"), yes, no).error.isNull(),
        Q.parse_time(F.col("t"), no).error.isNull(),
    ).collect()
    assert sorted(map(tuple, got)) == [(False,) * 3, (True,) * 3]


def test_trimmed_characters(spark):
    df = spark.createDataFrame([("﻿\tAgree 　",), ("\x85Agree\x1f",)], "x string")
    got = df.select(L.label_keys(F.array("x"))[0], L.likert_label(F.col("x"))).collect()
    assert sorted(map(tuple, got)) == [("Agree", "agree"), ("\x85Agree\x1f", "\x85agree\x1f")]


def test_ranks_of_all_values(spark):
    values = spark.createDataFrame([(f"v{i:03}", i % 7) for i in range(500)], "value string, count long").repartition(5)
    got = [r.value for r in G.ranked_values(values).orderBy("rank").collect()]
    assert got == [v for _, v in sorted((-(i % 7), f"v{i:03}") for i in range(500))]
