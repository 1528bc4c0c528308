"""One refusal per test: finished rows that must not be handed out."""

from dataclasses import replace

import pytest

from canvass.operators.routing import form_index
from canvass.plans import finished as FIN
from canvass.plans import pipeline as PL
from canvass.plans import selection as SEL
from canvass.plans import vectors as V
from canvass.plans.pool import Job, RoutingRule

OPTION = '{{"state":"answered","value":{{"kind":"single_choice","optionKey":"{0}","label":"{0}"}}}}'
TEXT = '{"state":"answered","value":{"kind":"text","text":"x"}}'
SKIPPED, AWAY = '{"state":"skipped"}', '{"state":"not_reached"}'
SCHEMA = "response_id string, submitted_at timestamp, score double, branch string, detail string, origin string"
JOB = Job(
    6, means=(V.MeanTarget("m", "score", 3.0, 1, 5),), categorical=("branch", "detail"),
    rules=(RoutingRule("branch", "end", forbidden=(("detail", "answer_slot"),)),),
)


def rows():
    at = __import__("datetime").datetime(2026, 8, 1)
    source = [[f"r{i}", at, float(1 + i), OPTION.format("on"), TEXT, "original"] for i in range(4)]
    made = [["s1", at, 4.0, OPTION.format("on"), TEXT, "synthetic"], ["s2", at, 4.0, OPTION.format("end"), AWAY, "synthetic"]]
    return source + made


def findings(spark, final, job=JOB, **more):
    source = spark.createDataFrame(rows()[:4], SCHEMA).drop("origin")
    final = spark.createDataFrame(final, SCHEMA)
    return sorted((r["code"], r["response_id"]) for r in FIN.finished_findings(final, source, job, **more).collect())


def test_good_rows_pass(spark):
    planned = V.outcomes(spark.createDataFrame(rows(), SCHEMA), JOB.targets)
    assert findings(spark, rows(), planned=planned, plans={"m": {"error": 0.0}}) == []


@pytest.mark.parametrize(
    "row, column, value, found",
    [
        (4, 5, "made", [("invalid_origin", "s1")]),
        (4, 5, None, [("invalid_origin", "s1")]),
        (4, 1, None, [("invalid_timestamp", "s1")]),
        (4, 2, 4.5, [("invalid_score", "s1")]),
        (4, 2, 6.0, [("invalid_score", "s1")]),
        (4, 4, '{"state":"guessed"}', [("invalid_cell", "s1")]),
        (4, 4, None, [("invalid_cell", "s1")]),
        (5, 4, TEXT, [("routing_conflict", "s2")]),
        (5, 0, "s1", [("repeated_response_id", "s1")]),
        (0, 2, 2.0, [("changed_source_row", "r0")]),
        (0, 0, "ghost", [("lost_source_row", "r0"), ("unknown_source_row", "ghost")]),
    ],
)
def test_row_refusals(spark, row, column, value, found):
    final = rows()
    final[row][column] = value
    assert findings(spark, final) == found


def test_sizes_are_refused(spark):
    assert findings(spark, rows()[1:]) == [("lost_source_row", "r0"), ("original_count", None), ("row_count", None)]
    # A replacement may miss exactly the rows it says it removed.
    more = rows()[1:] + [["s3", *rows()[4][1:]]]
    assert findings(spark, more, removed_count=1) == []
    assert findings(spark, more, removed_count=2) == [("original_count", None)]


def test_targets_are_measured_again(spark):
    job = replace(JOB, counts=(V.CountTarget("n", "branch", frozenset({OPTION.format("end")}), 2),))
    planned = V.outcomes(spark.createDataFrame([*rows()[:5], ["s2", *rows()[4][1:]]], SCHEMA), job.targets)
    assert findings(spark, rows(), job, planned=planned) == [("target_disagrees", None)]
    assert findings(spark, rows(), replace(JOB, means=(V.MeanTarget("m", "score", 3.1, 1, 5),)), plans={"m": {"error": 0.01}}) == [("target_support", None)]
    final = rows()[1:] + [["s3", *rows()[4][1:]]]
    assert findings(spark, final, job, removed_count=1) == [("count_missed", None)]


def form(spark, required=True):
    sections = spark.createDataFrame([("f", 0), ("f", 1)], "form_id string, ord int")
    questions = spark.createDataFrame(
        [("f", 0, "grade", 0, True, "single_choice"), ("f", 1, "branch", 0, True, "single_choice"), ("f", 2, "detail", 1, required, "text")],
        "form_id string, ord int, question_id string, section_ord int, required boolean, kind string",
    )
    hops = spark.createDataFrame(
        [("f", "branch", "on", "next_section", None), ("f", "branch", "end", "submit", None)], "form_id string, question_id string, option_key string, dest_type string, dest_ord int"
    )
    grades = {"low": 1, "mid": 3, "high": 4}
    return FIN.FormCheck("f", form_index(sections, questions, hops), {"score": ("grade", grades)}, {"branch": "branch", "detail": "detail"})


def test_rows_are_led_through_their_form(spark):
    job = replace(JOB, rules=())
    assert findings(spark, rows(), job, form=form(spark)) == []
    for row, column, value, found in (
        (4, 2, 2.0, [("unmapped_score", "s1")]),
        (5, 4, TEXT, [("routing_conflict", "s2")]),
        (4, 4, SKIPPED, [("required_skipped", "s1")]),
        (4, 2, None, [("required_skipped", "s1")]),
    ):
        final = rows()
        final[row][column] = value
        assert findings(spark, final, job, form=form(spark)) == found
    final = rows()
    final[4][4] = SKIPPED
    assert findings(spark, final, job, form=form(spark, required=False)) == []


def test_a_finding_stops_the_run(spark, monkeypatch):
    FIN.stop_on(spark.createDataFrame([], "code string, response_id string, detail string"))
    source = spark.createDataFrame(rows()[:4] * 1, SCHEMA).drop("origin")
    job = Job(6, means=(V.MeanTarget("m", "score", 3.0, 1, 5),), categorical=("branch", "detail"))
    assert PL.augment(source, job).final.count() == 6
    monkeypatch.setattr(PL, "_with_ids", lambda rows, *_: rows.drop("cand_id", "request_id").selectExpr("'same' AS response_id", "*", "'synthetic' AS origin"))
    with pytest.raises(SEL.Infeasible) as error:
        PL.augment(source, job)
    assert error.value.code == "finished_rows" and "repeated_response_id" in str(error.value)
