"""Refusals before generation, and the domains that candidates are held to."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from canvass.plans import domains as D
from canvass.plans import vectors as V
from canvass.plans.pool import Job, generate_pool

SLOT = '{{"state":"answered","value":{{"kind":"single_choice","optionKey":"{0}","label":"{0}"}}}}'
SHARE = V.ShareTarget("s", "g", frozenset({"A"}), 0.5)
COND = V.ConditionalTarget("c", "h", frozenset({"x"}), "g", frozenset({"A"}), 0.5)
JOB = Job(6, categorical=("g", "h"), time_column="at")


@pytest.fixture(scope="module")
def source(spark):
    rows = [("A", "x", dt.datetime(2026, 1, 1)), ("B", "y", dt.datetime(2026, 1, 2)), ("B", "x", dt.datetime(2026, 1, 3)), (SLOT.format("o"), "y", dt.datetime(2026, 1, 4))]
    return spark.createDataFrame(rows, "g string, h string, at timestamp_ntz")


@pytest.mark.parametrize(
    "job, refused",
    [
        (replace(JOB, shares=(SHARE,), conditionals=(COND,)), []),
        (replace(JOB, shares=(replace(SHARE, members=frozenset({"A", "C"})),)), [("s", "C", "unseen_member")]),
        (replace(JOB, shares=(replace(SHARE, members=frozenset({"A", SLOT.format("new")})),)), []),
        (replace(JOB, shares=(replace(SHARE, members=frozenset({'{"state":"skipped"}'})),)), [("s", '{"state":"skipped"}', "unseen_member")]),
        (replace(JOB, counts=(V.CountTarget("n", "g", frozenset({"C"}), 1),)), [("n", "C", "unseen_member")]),
        (replace(JOB, shares=(replace(SHARE, column="other"),)), [("s", "A", "not_categorical")]),
        (replace(JOB, conditionals=(replace(COND, population_members=frozenset({"x", SLOT.format("new")})),)), [("c", SLOT.format("new"), "unseen_population")]),
        (replace(JOB, conditionals=(replace(COND, option_members=frozenset({"A", SLOT.format("new")})),)), [("c", SLOT.format("new"), "unseen_option")]),
        (replace(JOB, conditionals=(replace(COND, option_members=frozenset({"A", SLOT.format("new")}), schema_members=frozenset({SLOT.format("new")})),)), []),
        (replace(JOB, conditionals=(replace(COND, schema_members=frozenset({SLOT.format("new")})),)), [("c", SLOT.format("new"), "schema_member_outside")]),
    ],
)
def test_members_outside_the_support(source, job, refused):
    assert sorted((r.target_id, r.value, r.code) for r in D.support_refusals(source, job).collect()) == refused
    if refused:
        with pytest.raises(D.SupportRefused):
            generate_pool(source, job, 2, 40, {})


def test_categories_are_text_without_gaps(spark, source):
    spoiled = source.withColumn("n", F.lit(1)).withColumn("gap", F.when(F.col("h") == "x", F.col("h")))
    got = {r["column"]: (r["rows"], r["nulls"], r["valid"]) for r in D.category_check(spoiled, ["g", "n", "gap"]).collect()}
    assert got == {"g": (4, 0, True), "n": (4, 0, False), "gap": (4, 2, False)}
    for bad in ("n", "gap"):
        with pytest.raises(D.SupportRefused):
            D.refuse_unsupported(spoiled, replace(JOB, categorical=("g", bad)))
    assert {r["valid"] for r in D.category_check(spoiled.limit(0), ["g"]).collect()} == {True}


def test_domains_of_candidates(spark, source):
    first, last = dt.datetime(2026, 1, 2), dt.datetime(2026, 1, 3)
    rows = source.unionByName(spark.createDataFrame([("A", "x", None)], source.schema))
    count = lambda *ends: rows.where(D.valid_time(F.col("at"), *ends)).count()
    assert (count(first, last), count(None, last), count(first, None), count(None, None)) == (2, 3, 3, 4)
    assert D.in_domains(rows, {"g": source.where("g = 'A'"), "h": source}).count() == 2
