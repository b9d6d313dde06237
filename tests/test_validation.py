"""Validation: one row per rule, several errors on one row, JSON types,
malformed JSON, blank names, and the reference-shaped case file."""
import json
import os

from pyspark.sql import functions as F

from guestflow.operators.validate import split_valid, with_validation
from guestflow.plans.process import with_decision, draft_replies, RESPONSE_COLUMNS
from guestflow.sources.inbound import parse_payload, read_cases

GOOD = {"source": "whatsapp", "guest_name": "Ana Silva", "message": "Any vacancy?",
        "timestamp": "2026-05-05T10:30:00Z", "property_id": "villa-1"}


def payloads(spark, bodies):
    rows = [(f"t{i}", b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return with_validation(parse_payload(spark.createDataFrame(rows, "message_id string, raw string"),
                                         check_types=True))


def errors_by_id(df):
    return {r.message_id: [(e.field, e.issue) for e in r.errors] for r in df.collect()}


def test_one_rule_each(spark):
    bodies = [GOOD,
              {**GOOD, "source": "telegram"},
              {**GOOD, "guest_name": ""},
              {**GOOD, "message": ""},
              {**GOOD, "timestamp": "not-a-timestamp"},
              {k: v for k, v in GOOD.items() if k != "property_id"},
              {**GOOD, "timestamp": "10:30"},
              {**GOOD, "timestamp": "2026"},
              {**GOOD, "timestamp": "2026-05-05"},
              {**GOOD, "booking_ref": None}]
    e = errors_by_id(payloads(spark, bodies))
    assert e["t0"] == [] and e["t8"] == [] and e["t9"] == []
    assert e["t1"] == [("body → source", "Input should be 'whatsapp', 'booking_com', 'airbnb', 'instagram' or 'direct'")]
    assert e["t2"] == [("body → guest_name", "String should have at least 1 character")]
    assert e["t3"] == [("body → message", "String should have at least 1 character")]
    assert e["t4"] == [("body → timestamp", "Input should be a valid datetime")]
    assert e["t5"] == [("body → property_id", "Field required")]
    assert e["t6"] and e["t7"]


def test_all_errors_reported(spark):
    e = errors_by_id(payloads(spark, [{"source": "sms", "guest_name": "", "message": ""}]))
    fields = [f for f, _ in e["t0"]]
    assert fields == ["body → source", "body → guest_name", "body → message", "body → timestamp",
                      "body → property_id"]


def test_json_types_and_malformed(spark):
    df = payloads(spark, [{**GOOD, "message": 5}, {**GOOD, "booking_ref": {"a": 1}}, "{not json"])
    e = errors_by_id(df)
    assert ("body → message", "Input should be a valid string") in e["t0"]
    assert ("body → booking_ref", "Input should be a valid string") in e["t1"]
    assert ("body", "JSON decode error") in e["t2"]
    assert df.filter("is_valid").count() == 0


def test_blank_name_is_processing_error(spark):
    ok, bad, failed = split_valid(payloads(spark, [{**GOOD, "guest_name": "   "}, GOOD]))
    assert (ok.count(), bad.count(), failed.count()) == (1, 0, 1)


def test_case_file(spark):
    path = os.path.join(os.path.dirname(__file__), "data", "cases.json")
    cases = with_validation(read_cases(spark, path))
    ok, bad, failed = split_valid(cases)
    assert sorted(r.case_id for r in bad.collect()) == ["C-E1", "C-E2", "C-E3", "C-E4"]
    assert failed.count() == 0
    out = draft_replies(with_decision(ok)).select("case_id", "expected_query_type", "expected_action",
                                                  *RESPONSE_COLUMNS[1:])
    scores = {"C-01": 0.82, "C-02": 0.87, "C-03": 0.40, "C-04": 0.90, "C-05": 0.80}
    for r in out.collect():
        assert r.query_type == r.expected_query_type and r.action == r.expected_action, r
        assert abs(r.confidence_score - scores[r.case_id]) < 1e-9
        assert r.drafted_reply.startswith("Hi " + {"C-01": "Asha", "C-02": "Meera", "C-03": "Vikram",
                                                    "C-04": "Lena", "C-05": "Kiran"}[r.case_id] + ",")
    statuses = cases.select("case_id", "expected_status").collect()
    assert {r.case_id: r.expected_status for r in statuses}["C-01"] == 200


def test_missing_null_wrong_type_and_malformed_are_told_apart(spark):
    good = json.dumps(GOOD)
    source = "Input should be 'whatsapp', 'booking_com', 'airbnb', 'instagram' or 'direct'"
    cases = [(good, []),
             ({**GOOD, "booking_ref": None}, []),
             ({**GOOD, "booking_ref": 5}, [("body → booking_ref", "Input should be a valid string", "5")]),
             ({**GOOD, "guest_name": None}, [("body → guest_name", "Input should be a valid string", None)]),
             ({**GOOD, "source": 5}, [("body → source", source, "5")]),
             ({**GOOD, "source": None}, [("body → source", source, None)]),
             ({**GOOD, "message": {"a": 1}}, [("body → message", "Input should be a valid string", '{"a":1}')]),
             ({**GOOD, "timestamp": None}, [("body → timestamp", "Input should be a valid datetime", None)]),
             ("{oops", [("body", "JSON decode error", None)]),
             ("[1,2]", [("body", "Input should be a valid dictionary or object to extract fields from", "[1,2]")])]
    df = payloads(spark, [b for b, _ in cases])
    got = {r.message_id: [(e.field, e.issue, e.received) for e in r.errors] for r in df.collect()}
    assert got == {f"t{i}": want for i, (_, want) in enumerate(cases)}
    assert {r.message_id for r in df.filter("is_valid").collect()} == {"t0", "t1"}


def test_cases_keep_what_they_send(spark, tmp_path):
    """Wrong types, explicit nulls and absent fields reach the validator as such."""
    from guestflow.operators.reports import run_summary
    from guestflow.plans.process import case_outcomes
    cases = [("ok", GOOD, 200), ("null ref", {**GOOD, "booking_ref": None}, 200), ("number", {**GOOD, "guest_name": 5}, 422),
             ("object", {**GOOD, "message": {"a": 1}}, 422), ("null", {**GOOD, "property_id": None}, 422),
             ("absent", {k: v for k, v in GOOD.items() if k != "timestamp"}, 422), ("list", [GOOD], 422), ("text", json.dumps(GOOD), 422),
             ("no payload", None, 422), ("source", {**GOOD, "source": "telegram"}, 422), ("blank", {**GOOD, "guest_name": " "}, 500)]
    doc = {"test_cases": [{"id": i, "payload": p, "expected_query_type": "pre_sales_availability", "expected_action": "escalate"}
                          | ({"expected_status": s} if s != 200 else {}) for i, p, s in cases] + [{"id": "empty", "expected_status": 422}]}
    (tmp_path / "cases.json").write_text(json.dumps(doc, indent=1))
    read = read_cases(spark, str(tmp_path / "cases.json"))
    out = case_outcomes(read).collect()
    assert {r.case_id: r.status for r in out} == {i: s for i, _, s in cases} | {"empty": 422}
    assert {r.case_id: (r.query_type, r.action) for r in out if r.status == 200} == dict.fromkeys(["ok", "null ref"], ("pre_sales_availability", "auto_send"))
    errors = {r.case_id: [(e.field, e.issue, e.received) for e in r.errors] for r in with_validation(read).collect()}
    assert errors["number"] == [("body → guest_name", "Input should be a valid string", "5")]
    assert errors["object"] == [("body → message", "Input should be a valid string", '{"a":1}')]
    assert errors["null"] == [("body → property_id", "Input should be a valid string", None)]
    assert [e[:2] for e in errors["absent"]] == [("body → timestamp", "Field required")]
    assert errors["list"][0][:2] == errors["text"][0][:2] == ("body", "Input should be a valid dictionary or object to extract fields from")
    s = run_summary(case_outcomes(read)).first().asDict()
    assert s == {"n_cases": 12, "n_passed": 12, "n_failed": 0, "n_rejected": 9, "n_errors": 1, "n_rejects_expected": 9, "n_answers_expected": 2,
                 "n_types_met": 2, "n_actions_met": 0}
