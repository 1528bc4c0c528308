"""Landed documents that are empty, broken or unknown: every one leaves a row or an error."""

import json

from canvass.operators import routing as R
from canvass.sources import forms as SF
from canvass.sources import responses as SR


def question(qid, **kind):
    return {"itemId": f"i-{qid}", "title": qid, "questionItem": {"question": {"questionId": qid, "required": False, **kind}}}


FORMS = [
    json.dumps({"formId": "full", "items": [question("t", textQuestion={"paragraph": False}), question("u", fileUploadQuestion={"maxFiles": 1})]}),
    json.dumps({"formId": "empty", "items": []}),
    json.dumps({"formId": "listless", "info": {"title": "x"}}),
    json.dumps({"formId": "", "items": []}),
    "{not json",
    None,
]


def tables(spark):
    return SF.normalise_forms(spark.createDataFrame([(x,) for x in FORMS], "payload string"))


def test_every_form_leaves_a_section_or_an_error(spark):
    done = tables(spark)
    assert {(r.form_id, r.ord) for r in done.sections.collect()} == {("full", 0), ("empty", 0)}
    assert sorted(r.question_id for r in done.questions.collect()) == ["t", "u"]
    errors = sorted((r.form_id or "", r.code) for r in done.errors.collect())
    assert errors == [("", "malformed_form")] * 3 + [("listless", "malformed_form")]
    assert {r.form_id for r in SF.schema_fingerprint(done).collect()} == {"full", "empty"}


def response(rid, form, time="2026-08-01T00:00:00Z", **answers):
    return form, json.dumps({"responseId": rid, "createTime": time, "lastSubmittedTime": "", "answers": answers})


def text(value):
    return {"textAnswers": {"answers": [{"value": value}]}}


def files(**file):
    return {"fileUploadAnswers": {"answers": [file]}}


def test_every_response_stays(spark):
    done = tables(spark)
    raw = spark.createDataFrame([
        response("a", "full", t=text("hi"), u=files(fileName="f.pdf")),
        response("b", "empty", t=text("hi")),
        response("c", "unknown", t=text("hi")),
        response("d", "full", time="yesterday", t=text("hi")),
        response("e", "full", u=files(fileName="", mimeType="", fileId="")),
        response("f", "full", u=files(fileId="x")),
    ], "form_id string, payload string")
    typed = SR.type_answers(SR.parse_responses(raw), SR.answer_index(done.questions, done.options))
    got = {r.response_id: r for r in typed.collect()}
    assert {k: [s.question_id for s in r.answers] for k, r in got.items()} == {"a": ["t", "u"], "b": [], "c": [], "d": ["t"], "e": [], "f": ["u"]}
    errors = {k: [(e.question_id, e.code) for e in r.answer_errors] for k, r in got.items() if r.answer_errors}
    assert errors == {"d": [(None, "invalid_submission_time")], "e": [("u", "invalid_file")]}
    index = R.form_index(done.sections, done.questions, done.transitions.withColumnRenamed("source_section_ord", "source_ord"))
    paths = {r.response_id: r for r in R.resolve_paths(typed, index).collect()}
    assert len(paths) == 6 and paths["b"].path == [] and [p.reach for p in paths["a"].path] == ["reached", "reached"]
    assert {r.response_id: len(r.answers) for r in R.complete_slots(R.resolve_paths(typed, index)).collect()} == {"a": 2, "b": 0, "c": 0, "d": 2, "e": 2, "f": 2}
