import json

import pytest
from pyspark.sql import functions as F

from casekit.operators import transfers as TR
from casekit.plans.transfer_flow import run_case, score_transfers
from casekit.schemas import TRANSFER_COLUMNS, TRANSFER_TEXT
from casekit.sources.adapters import parse_transfer_text
from fixtures import EXPECTED, TRANSFERS, transfer_df


def _scored(spark, records=TRANSFERS, completions=None):
    return score_transfers(transfer_df(spark, records), completions, run_id="t", created_at="2025-01-01T00:00:00+00:00")


def test_golden_transfers(spark):
    rows = _scored(spark).select(
        "txn_id", F.array_join(F.array_sort(F.map_keys("flags")), ",").alias("f"),
        "rule_score", "ml_score", "decision_score", "verdict", "sla_priority", "is_young_customer").collect()
    got = {r.txn_id: r for r in rows}
    assert set(got) == set(EXPECTED)
    for tx, (flags, rule, ml, comp, verdict, sla) in EXPECTED.items():
        r = got[tx]
        assert (r.f, r.rule_score, r.ml_score, r.decision_score, r.verdict, r.sla_priority) == \
            (flags, rule, ml, comp, verdict, sla), tx
    assert [tx for tx, r in got.items() if r.is_young_customer] == ["TX-3001"]


def test_reasons_order_and_narrative(spark):
    r = _scored(spark).filter("txn_id = 'TX-3003'").first()
    assert r.reasons == ["High amount internal transfer >= 5000", "First‑time or very new beneficiary",
                         "New or unknown device for this account"]
    assert r.decision_reasons[-3:] == ["ML score=0.56", "Rule score=0.33", "Investigator suggested REVIEW"]
    assert r.investigator_notes.split("\n")[1:3] == ["ML risk score=0.564", "RECOMMENDATION: REVIEW"]
    s = _scored(spark).filter("txn_id = 'TX-3002'").first().summary
    assert s == ("Transfer TX-3002 350.00 USD INTERNAL from ACC-002 to ACC-003. Dest US. "
                 "ML=0.03, Rules=0.00, Verdict=APPROVE.")


def test_report_json_roundtrip(spark):
    rep = TR.report_json(_scored(spark)).filter("txn_id = 'TX-3001'").first()
    doc = json.loads(rep.report_json)
    assert doc["decision"]["verdict"] == "DECLINE"
    assert doc["enrichment"]["velocity"] == {"out_1h": 7, "out_24h": 18}
    assert len(doc["rules"]["flags"]) == 9 and doc["rules"]["rule_score"] == 1.0


@pytest.mark.parametrize("text,rec,verdict,suggested", [
    ("x\nRecommendation: decline", "DECLINE", "DECLINE", True),
    ("RECOMMENDATION: APPROVE\nlater\n recommendation: REVIEW  ", "REVIEW", "REVIEW", True),
    ("RECOMMENDATION: APPROVE|REVIEW", "APPROVE|REVIEW", "APPROVE", True),   # invalid: composite decides
    ("no recommendation here", "", "APPROVE", False),
    ("RECOMMENDATION:", "", "APPROVE", False),
    ("a\r\nRECOMMENDATION: DECLINE\r\n", "DECLINE", "DECLINE", True),
    ("x\n\u00a0RECOMMENDATION: DECLINE", "DECLINE", "DECLINE", True),
    ("RECOMMENDATION: APPROVE\x1cRECOMMENDATION: DECLINE", "DECLINE", "DECLINE", True),
    ("RECOMMENDATION: \u3000REVIEW\u2003\x1f", "REVIEW", "REVIEW", True),
    ("", "", "APPROVE", False),
])
def test_completion_parsing(spark, text, rec, verdict, suggested):
    comp = spark.createDataFrame([("TX-3002", "investigator", text)], "case_id string, step string, text string")
    r = _scored(spark, [TRANSFERS[1]], comp).first()
    assert r.notes_source == "model"
    assert r.recommendation == rec and r.verdict == verdict
    assert (r.decision_reasons[-1] == f"Investigator suggested {rec}") == suggested


def test_completion_without_text_is_heuristic(spark):
    comp = spark.createDataFrame([("TX-3002", "investigator", None)], "case_id string, step string, text string")
    assert _scored(spark, [TRANSFERS[1]], comp).first().notes_source == "heuristic"


def test_enrichment_null_rules(spark):
    base = dict(TRANSFERS[1])
    cases = [
        dict(base, txn_id="a", payee_first_seen_days=None, new_beneficiary=None),   # not new (code, not comment)
        dict(base, txn_id="b", payee_first_seen_days=0, new_beneficiary=None),      # new
        dict(base, txn_id="c", origin_account_tenure_days=None),                    # device unknown, tenure 0
        dict(base, txn_id="d", device_id=""),                                       # device unknown
        dict(base, txn_id="e", transfer_type="external", destination_country="ng"),
        dict(base, txn_id="f", memo="Gift Cards"), dict(base, txn_id="g", memo="student loans"),
    ]
    got = {r.txn_id: r for r in TR.enrich_transfers(transfer_df(spark, cases)).collect()}
    assert not got["a"].is_new_beneficiary and got["b"].is_new_beneficiary
    assert not got["c"].device_known and got["c"].origin_tenure_days == 0 and not got["d"].device_known
    assert got["e"].is_external and got["e"].geo_risk == "HIGH" and got["e"].dest_country == "NG"
    assert got["f"].memo_risky and got["g"].memo_risky and not got["a"].memo_risky


def test_validation_rejects(spark):
    good = {c: (None if v is None else str(v).lower() if isinstance(v, bool) else str(v))
            for c, v in TRANSFERS[0].items()}
    rows = [
        dict(good, txn_id="ok1"),
        dict(good, txn_id="bad_amount", amount="12,5"),
        dict(good, txn_id="no_channel", channel=None),
        dict(good, txn_id="nan_amount", amount="nan"),
        dict(good, txn_id="soft", customer_age="old"),
        dict(good, txn_id="underscore", amount="12_500"),
    ]
    df = spark.createDataFrame([tuple(r.get(c) for c in TRANSFER_COLUMNS) + (None,) for r in rows], TRANSFER_TEXT)
    valid, rejected = TR.validate_transfers(df)
    assert sorted(r.txn_id for r in valid.collect()) == ["ok1", "underscore"]
    rej = {r.txn_id: r.reject_reasons for r in rejected.collect()}
    assert rej["bad_amount"] == ["amount: not a valid double"]
    assert rej["no_channel"] == ["channel: missing"]
    assert rej["nan_amount"] == ["amount: NaN"]
    assert rej["soft"] == ["customer_age: not a valid int"]
    assert valid.filter("txn_id = 'underscore'").first().amount == 12500.0


def test_malformed_json_kept_apart(spark):
    lines = [json.dumps(TRANSFERS[0]), '{"txn_id": "broken", "amount": 1', json.dumps(dict(TRANSFERS[1], amount="5200"))]
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    valid, rejected = TR.validate_transfers(parse_transfer_text(raw))
    assert sorted(r.txn_id for r in valid.collect()) == ["TX-3001", "TX-3002"]
    assert [r.reject_reasons for r in rejected.collect()] == [["malformed record"]]


def test_run_case_single_record(spark):
    report, rejected = run_case(spark, TRANSFERS[2], run_id="x", created_at="now")
    r = report.first()
    assert (r.verdict, r.decision_score, r.sla_priority) == ("REVIEW", 0.472, "P2")
    assert rejected.count() == 0


def test_prompt_context_is_json(spark):
    df = TR.ml_risk(TR.score_rules(TR.enrich_transfers(transfer_df(spark, TRANSFERS))))
    p = TR.investigator_prompts(df).filter("case_id = 'TX-3005'").first()
    ctx = json.loads(p.prompt.split("\n", 1)[1])
    assert ctx["transfer"]["device_id"] is None and ctx["ml_score"] == 0.774
    assert "RECOMMENDATION: APPROVE|REVIEW|DECLINE" in p.system
