import json
import os

from casekit.functions.parallel import spread
from casekit.plans.case_flow import run_case_batch
from casekit.plans.transfer_flow import score_transfers
from casekit.schemas import CUSTOMER, DEVICE, PAYMENT
from casekit.sources.sinks import case_listing, write_case_listing, write_case_reports
from fixtures import TRANSFERS, transfer_df
from test_cases import CUSTOMERS, DEVICES, PAYMENTS


def test_report_sinks(spark, scratch):
    scored = score_transfers(transfer_df(spark, TRANSFERS), run_id="s", created_at="t0")
    write_case_reports(scored, os.path.join(scratch, "json"), fmt="json")
    write_case_reports(scored, os.path.join(scratch, "pq"), fmt="parquet")
    docs = [json.loads(r.value) for r in spark.read.text(os.path.join(scratch, "json")).collect()]
    assert sorted(d["txn_id"] for d in docs) == [t["txn_id"] for t in TRANSFERS]
    assert {d["created_at"] for d in docs} == {"t0"}
    pq = spark.read.parquet(os.path.join(scratch, "pq"))
    assert pq.count() == 5 and pq.filter("report.decision.verdict = 'DECLINE'").count() == 2


def test_case_listing(spark, scratch):
    cases, _ = run_case_batch(spark.createDataFrame(PAYMENTS, PAYMENT), spark.createDataFrame(CUSTOMERS, CUSTOMER),
                              spark.createDataFrame(DEVICES, DEVICE), None, audit_ts="T")
    rows = {r.case_id: r for r in case_listing(cases).collect()}
    assert rows["ALERT-001"].model_score == "0.5" and rows["ALERT-001"].decision == "escalate"
    assert rows["ALERT-001"].rule_hits == "RULE:HIGH_AMOUNT_ECOM,RULE:GEO_MISMATCH"
    write_case_listing(cases, os.path.join(scratch, "listing"))
    assert spark.read.parquet(os.path.join(scratch, "listing")).count() == 2


def test_spread_only_by_setting(spark):
    from casekit.functions.parallel import INPUT_PARTITIONS, spread
    df = spark.range(0, 100, 1, 2)
    assert spread(df) is df
    spark.conf.set(INPUT_PARTITIONS, "5")
    try:
        out = spread(df)
    finally:
        spark.conf.unset(INPUT_PARTITIONS)
    assert out.count() == 100 and len({r.p for r in out.selectExpr("spark_partition_id() p").collect()}) > 2
