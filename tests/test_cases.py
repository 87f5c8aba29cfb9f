import json

import pytest

from casekit.operators import cases as C
from casekit.plans.case_flow import run_case_batch
from casekit.schemas import CUSTOMER, DEVICE, PAYMENT

PAYMENTS = [
    ("ALERT-001", 18250.0, "INR", "STELLAR GADGETS HK", 5732, "ecom", "HKG", 99231, 123, "203.0.113.54",
     "2025-08-18T22:44:21Z", ["velocity_alert", "geo_anomaly"]),
    ("ALERT-002", 50000.0, "INR", "LOCAL MART IND", 5411, "pos", "IND", 99231, 123, "203.0.113.54",
     "2025-08-19T10:14:00Z", []),
    ("ALERT-003", 100.0, "INR", "X", 1, "pos", None, 5, 123, "ip", "t", []),      # unknown customer
    ("ALERT-004", 100.0, "INR", "X", 1, "pos", None, 99231, 999, "ip", "t", []),  # unknown device
]
CUSTOMERS = [(99231, "FULL", "Retail-Premium", 4.2, "k.k@example.com", "+91", "IND", False, 1500, 45000, 0),
             # duplicate key: the row with the smallest column tuple wins
             (99231, "ZZZ", "Other", 1.0, "z@example.com", "+1", "USA", True, 1, 1, 0)]
DEVICES = [(123, "low", True, False, 5, "8.3.1")]


def _batch(spark, completions=None):
    return run_case_batch(spark.createDataFrame(PAYMENTS, PAYMENT), spark.createDataFrame(CUSTOMERS, CUSTOMER),
                          spark.createDataFrame(DEVICES, DEVICE), completions, audit_ts="T")


def test_reference_alerts(spark):
    cases, errors = _batch(spark)
    got = {r.txn_id: r for r in cases.collect()}
    assert set(got) == {"ALERT-001", "ALERT-002"}
    assert got["ALERT-001"].rule_hits == ["RULE:HIGH_AMOUNT_ECOM", "RULE:GEO_MISMATCH"]
    assert got["ALERT-002"].rule_hits == []
    assert all(r.model_score == 0.5 and r.decision == "escalate" for r in got.values())
    assert got["ALERT-001"].home_country == "IND"  # deterministic pick among duplicate keys
    errs = {r.txn_id: r.missing for r in errors.collect()}
    assert errs == {"ALERT-003": "customer", "ALERT-004": "device"}


@pytest.mark.parametrize("text,score,decision", [
    ("0.8 high", 0.8, "deny"), ("0.75", 0.75, "escalate"), ("0.45", 0.45, "escalate"), ("0.1", 0.1, "approve"),
    ("85%", 0.5, "escalate"), ("85", 85.0, "deny"), ("nan", None, "approve"), ("1_0", 10.0, "deny"),
    ("1.0d", 0.5, "escalate"), ("", 0.5, "escalate"), ("  -inf ", float("-inf"), "approve"), ("1__0", 0.5, "escalate"),
])
def test_score_texts(spark, text, score, decision):
    comp = spark.createDataFrame([("ALERT-002", "model", text)], "case_id string, step string, text string")
    cases, _ = _batch(spark, comp)
    r = cases.filter("txn_id = 'ALERT-002'").first()
    if score is None:
        assert r.model_score != r.model_score  # NaN
    else:
        assert r.model_score == score
    assert r.decision == decision


def test_audit_log(spark):
    comp = spark.createDataFrame([("ALERT-001", "triage", "t1"), ("ALERT-001", "model", "0.9"),
                                  ("ALERT-001", "investigator", "n1")], "case_id string, step string, text string")
    cases, _ = _batch(spark, comp)
    audit = C.audit_table(cases).filter("txn_id = 'ALERT-001'").orderBy("seq").collect()
    assert [a.event for a in audit] == C.AUDIT_EVENTS and [a.seq for a in audit] == list(range(1, 7))
    assert json.loads(audit[0].payload) == {"summary": "t1"}
    assert json.loads(audit[1].payload)["device"]["seen_before"] is True
    assert json.loads(audit[5].payload) == {"decision": "deny", "score": 0.9}


def test_prompts_long_form(spark):
    cases, _ = _batch(spark)
    ps = {(r.case_id, r.step): r.prompt for r in C.case_prompts(cases).collect()}
    assert len(ps) == 6
    p = ps[("ALERT-001", "model")]
    assert p.startswith(C.MODEL_PROMPT) and json.loads(p[len(C.MODEL_PROMPT):]) == \
        {"amount": 18250.0, "channel": "ecom", "new_device": False}
    assert ps[("ALERT-002", "investigator")].endswith(", rules [], score 0.5")
    assert '"channel": "ecom", "country": "HKG"' in ps[("ALERT-001", "triage")]
    assert '"flags": ["velocity_alert", "geo_anomaly"]}' in ps[("ALERT-001", "triage")]
    assert ', rules ["RULE:HIGH_AMOUNT_ECOM", "RULE:GEO_MISMATCH"], score' in ps[("ALERT-001", "investigator")]
    warm = {r.step: (r.temperature, r.system) for r in C.case_prompts(cases).collect()}
    assert {k: v[0] for k, v in warm.items()} == {"triage": 0.2, "model": 0.0, "investigator": 0.2}
    assert all(v[1].startswith("You are a bank fraud investigation assistant.") for v in warm.values())


def test_first_per_key_is_deterministic(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, "c", 1), (1, "a", 3)], "k int, s string, v int")
    out = {r.k: (r.s, r.v) for r in C.first_per_key(df, "k").collect()}
    assert out == {1: ("a", 3), 2: ("c", 1)}


def test_checkpointed_batch_matches(spark):
    plain, plain_err = _batch(spark)
    from casekit.schemas import CUSTOMER, DEVICE, PAYMENT
    cp, cp_err = run_case_batch(spark.createDataFrame(PAYMENTS, PAYMENT), spark.createDataFrame(CUSTOMERS, CUSTOMER),
                                spark.createDataFrame(DEVICES, DEVICE), None, audit_ts="T", checkpoint=True)
    cols = ["txn_id", "decision", "model_score"]
    assert sorted(cp.select(*cols).collect()) == sorted(plain.select(*cols).collect())
    assert sorted(cp_err.collect()) == sorted(plain_err.collect())
