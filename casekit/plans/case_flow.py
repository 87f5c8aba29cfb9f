"""Job B as one lazy plan: triage -> enrichment -> rules -> model -> investigator -> decision.

Returns the resolved cases (with rule hits, score, decision and audit log)
and the cases whose customer or device did not resolve; both derive from
the same joined plan.  When both are written, ``checkpoint=True`` first
materialises the joined frame with a reliable ``checkpoint()`` into the
session's ``spark.checkpoint.dir`` (shared storage on a cluster), so the
joins run once and a lost executor does not replay them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from casekit.operators import cases as C
from casekit.session import checkpoint_dir


def run_case_batch(payments: DataFrame, customers: DataFrame, devices: DataFrame,
                   completions: DataFrame | None = None,
                   audit_ts: str | None = None, checkpoint: bool = False) -> tuple[DataFrame, DataFrame]:
    joined = C.enrich_cases(payments, customers, devices)
    if checkpoint:
        checkpoint_dir(payments.sparkSession)
        joined = joined.checkpoint(eager=True)
    errors = C.case_errors(joined)
    cust_cols = [c for c in customers.columns if c != "customer_id"]
    dev_cols = [c for c in devices.columns if c != "device_id"]
    cases = (joined.transform(C.resolved)
                   .transform(C.attach_case_completions, completions)
                   .transform(C.score_case_rules)
                   .transform(C.parse_model_score)
                   .transform(C.decide_cases)
                   .transform(C.with_audit, ["customer_id"] + cust_cols, ["device_id"] + dev_cols, audit_ts))
    return cases, errors
