"""Registered queries and their DuckDB oracles.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs a library operator over
the whole given tables; ``ORACLE[name]`` is an independent SQL rendering of
the same result for DuckDB (tables registered as views).  Outputs are flat
(arrays/maps become text) so values can be hashed across engines; every
computed column carries the same alias on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casekit.operators import cases as CS
from casekit.operators import derived as DER
from casekit.operators import documents as DOC
from casekit.operators import features as FE
from casekit.operators import terms as TERMS
from casekit.operators import tools as TOOLS
from casekit.operators import vector_index as IDX
from casekit.operators import vectors as VEC
from casekit.operators import transfers as TR
from casekit.functions.parse import PY_FLOAT_TOKEN
from casekit.plans.case_flow import run_case_batch
from casekit.plans.search_flow import search_documents
from casekit.plans.transfer_flow import score_transfers
from casekit.sources import adapters as A
from casekit.sources import sinks as SINKS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RUN_ID = "casekit"
CREATED_AT = "2025-01-01T00:00:00+00:00"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# =========================================================== job A (SQL) ==
def _transfer_cte(with_completions: bool, source_sql: str = A.TRANSFERS_SQL) -> str:
    memo_hit = " OR ".join(f"contains(lower(coalesce(memo, '')), '{w}')" for w in TR.RISKY_MEMO_KEYWORDS)
    countries = ", ".join(f"'{c}'" for c in TR.HIGH_RISK_COUNTRIES)
    preds = [
        "is_external AND amount >= 10000",
        "NOT is_external AND amount >= 5000",
        "is_new_beneficiary",
        "geo_risk = 'HIGH'",
        "NOT device_known",
        "out_1h >= 5",
        "out_24h >= 15",
        "prior_fraud > 0",
        "origin_tenure_days < 30 AND amount >= 2000",
        "memo_risky",
    ]
    names = ", ".join(f"CASE WHEN {p} THEN '{n}' END" for p, (n, _) in zip(preds, TR.RULE_TEXTS))
    reasons = ", ".join(f"CASE WHEN {p} THEN '{r}' END" for p, (_, r) in zip(preds, TR.RULE_TEXTS))
    header = TR.DEFAULT_NOTES_HEADER.replace("'", "''")
    fallback = (
        f"concat_ws(chr(10), '{header}', 'ML risk score=' || printf('%.3f', ml_score), "
        "'RECOMMENDATION: ' || CASE WHEN ml_score >= 0.75 OR rule_score >= 0.75 THEN 'DECLINE' "
        "WHEN ml_score >= 0.45 OR rule_score >= 0.45 THEN 'REVIEW' ELSE 'APPROVE' END, "
        "CASE WHEN ml_score >= 0.75 OR rule_score >= 0.75 THEN 'Key drivers: high rules and/or ML score' "
        "WHEN ml_score >= 0.45 OR rule_score >= 0.45 THEN 'Key drivers: moderate risk indicators' "
        "ELSE 'Low combined signals' END)"
    )
    if with_completions:
        notes = (f"n AS (SELECT m.*, coalesce(c.text, {fallback}) AS investigator_notes, "
                 "CASE WHEN c.text IS NOT NULL THEN 'model' ELSE 'heuristic' END AS notes_source "
                 f"FROM m LEFT JOIN (SELECT case_id, max(text) AS text FROM ({A.TRANSFER_NOTES_SQL}) "
                 "GROUP BY case_id) c ON m.txn_id = c.case_id)")
    else:
        notes = f"n AS (SELECT m.*, {fallback} AS investigator_notes, 'heuristic' AS notes_source FROM m)"
    split = r"'\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]'"
    white = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    return f"""
WITH t AS ({source_sql}),
e AS (
  SELECT *,
    upper(coalesce(transfer_type, '')) = 'EXTERNAL' AS is_external,
    coalesce(new_beneficiary, FALSE) OR coalesce(payee_first_seen_days <= 0, FALSE) AS is_new_beneficiary,
    coalesce(device_id, '') <> '' AND coalesce(origin_account_tenure_days > 60, FALSE) AS device_known,
    CASE WHEN upper(coalesce(destination_country, '')) IN ({countries}) THEN 'HIGH' ELSE 'LOW' END AS geo_risk,
    coalesce({memo_hit}, FALSE) AS memo_risky,
    coalesce(outbound_velocity_1h_count, 0) AS out_1h,
    coalesce(outbound_velocity_24h_count, 0) AS out_24h,
    coalesce(previous_fraud_reports, 0) AS prior_fraud,
    coalesce(customer_age <> 0 AND customer_age < 21, FALSE) AS is_young_customer,
    coalesce(origin_account_tenure_days, 0) AS origin_tenure_days,
    coalesce(beneficiary_account_tenure_days, 0) AS beneficiary_tenure_days,
    upper(coalesce(destination_country, '')) AS dest_country
  FROM t),
r0 AS (
  SELECT *,
    list_filter([{names}], lambda x: x IS NOT NULL) AS flag_names,
    list_filter([{reasons}], lambda x: x IS NOT NULL) AS reasons
  FROM e),
r AS (
  SELECT *, len(flag_names) AS n_flags,
    CAST(printf('%.3f', least(1.0::DOUBLE, len(flag_names) / 9.0::DOUBLE)) AS DOUBLE) AS rule_score
  FROM r0),
m AS (
  SELECT *, CAST(printf('%.3f', greatest(0.0::DOUBLE, least(
      least(amount / CASE WHEN is_external THEN 15000.0::DOUBLE ELSE 8000.0::DOUBLE END, 1.0::DOUBLE) * 0.35::DOUBLE
      + CASE WHEN geo_risk = 'HIGH' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN is_new_beneficiary THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN NOT device_known THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END
      + least(out_1h / 10.0::DOUBLE, 1.0::DOUBLE) * 0.10::DOUBLE
      + least(prior_fraud / 3.0::DOUBLE, 1.0::DOUBLE) * 0.05::DOUBLE
      + CASE WHEN origin_tenure_days < 30 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN memo_risky THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END
      + rule_score * 0.20::DOUBLE, 1.0::DOUBLE))) AS DOUBLE) AS ml_score
  FROM r),
{notes},
d0 AS (
  SELECT *,
    coalesce(regexp_replace(replace(list_filter(list_transform(list_reverse(
        string_split_regex(investigator_notes, {split})),
        lambda l: upper(regexp_replace(l, '^{white}+|{white}+$', '', 'g'))),
        lambda l: starts_with(l, 'RECOMMENDATION:'))[1], 'RECOMMENDATION:', ''), '^{white}+|{white}+$', '', 'g'), '')
      AS recommendation,
    least(1.0::DOUBLE, ml_score * 0.6::DOUBLE + rule_score * 0.4::DOUBLE) AS composite
  FROM n),
d1 AS (
  SELECT *,
    CASE WHEN recommendation IN ('APPROVE', 'REVIEW', 'DECLINE') THEN recommendation
         WHEN composite >= 0.75 THEN 'DECLINE' WHEN composite >= 0.45 THEN 'REVIEW' ELSE 'APPROVE' END AS verdict
  FROM d0),
d AS (
  SELECT *,
    list_concat(reasons, ['ML score=' || printf('%.2f', ml_score), 'Rule score=' || printf('%.2f', rule_score)],
      CASE WHEN recommendation <> '' THEN ['Investigator suggested ' || recommendation] ELSE [] END) AS decision_reasons,
    CASE verdict WHEN 'DECLINE' THEN 'P1' WHEN 'REVIEW' THEN 'P2' ELSE 'P3' END AS sla_priority,
    CAST(printf('%.3f', composite) AS DOUBLE) AS decision_score,
    sha256(txn_id || '|' || '{RUN_ID}') AS case_id,
    'Transfer ' || txn_id || ' ' || printf('%.2f', amount) || ' ' || currency || ' ' || transfer_type
      || ' from ' || origin_account_id || ' to ' || destination_account_id
      || '. Dest ' || coalesce(nullif(destination_country, ''), 'N/A')
      || '. ML=' || printf('%.2f', ml_score) || ', Rules=' || printf('%.2f', rule_score)
      || ', Verdict=' || verdict || '.' AS summary
  FROM d1)
"""


def _scored(spark: SparkSession, sf_dir: str, with_completions: bool = False) -> DataFrame:
    comp = A.transfer_notes(spark, sf_dir) if with_completions else None
    return score_transfers(A.transfers(spark, sf_dir), comp, run_id=RUN_ID, created_at=CREATED_AT)


def _joined(col: str, sep: str = " | ") -> F.Column:
    return F.array_join(F.col(col), sep)


_ENRICH_OUT = ["txn_id"] + TR.ENRICHMENT_COLUMNS


@register("transfer_enrich", _transfer_cte(False) + f"SELECT {', '.join(_ENRICH_OUT)} FROM d")
def q_transfer_enrich(spark, sf_dir):
    return A.transfers(spark, sf_dir).transform(TR.enrich_transfers).select(*_ENRICH_OUT)


@register("transfer_rules", _transfer_cte(False) + """
SELECT txn_id, array_to_string(list_sort(flag_names), ',') AS flags,
       array_to_string(reasons, ' | ') AS reasons, CAST(n_flags AS INTEGER) AS n_flags, rule_score FROM d""")
def q_transfer_rules(spark, sf_dir):
    df = A.transfers(spark, sf_dir).transform(TR.enrich_transfers).transform(TR.score_rules)
    return df.select("txn_id", F.array_join(F.array_sort(F.map_keys("flags")), ",").alias("flags"),
                     _joined("reasons").alias("reasons"), "n_flags", "rule_score")


@register("transfer_ml_score", _transfer_cte(False) + "SELECT txn_id, rule_score, ml_score FROM d")
def q_transfer_ml_score(spark, sf_dir):
    df = (A.transfers(spark, sf_dir).transform(TR.enrich_transfers)
          .transform(TR.score_rules).transform(TR.ml_risk))
    return df.select("txn_id", "rule_score", "ml_score")


_DECISION_SQL = """
SELECT txn_id, recommendation, verdict, decision_score, sla_priority,
       array_to_string(decision_reasons, ' | ') AS decision_reasons{extra} FROM d"""


def _decision_cols(df: DataFrame, extra: list[str] = ()) -> DataFrame:
    return df.select("txn_id", "recommendation", "verdict", "decision_score", "sla_priority",
                     _joined("decision_reasons").alias("decision_reasons"), *extra)


@register("transfer_decision", _transfer_cte(False) + _DECISION_SQL.format(extra=""))
def q_transfer_decision(spark, sf_dir):
    return _decision_cols(_scored(spark, sf_dir))


@register("transfer_notes", _transfer_cte(False) + "SELECT txn_id, investigator_notes FROM d")
def q_transfer_notes(spark, sf_dir):
    return _scored(spark, sf_dir).select("txn_id", "investigator_notes")


@register("transfer_narrative", _transfer_cte(False) + "SELECT txn_id, case_id, summary FROM d")
def q_transfer_narrative(spark, sf_dir):
    return _scored(spark, sf_dir).select("txn_id", "case_id", "summary")


@register("transfer_decision_completions",
          _transfer_cte(True) + _DECISION_SQL.format(extra=", notes_source"))
def q_transfer_decision_completions(spark, sf_dir):
    return _decision_cols(_scored(spark, sf_dir, True), ["notes_source"])


# ------------------------------------------------ S2 / P1: JSON + rejects --
def _json_transfers(spark: SparkSession, sf_dir: str):
    raw = A.parse_transfer_text(A.transfers_json(spark, sf_dir))
    return TR.validate_transfers(raw, keep=["record_no"])


@register("transfer_rejects", f"""
SELECT record_no,
  CASE WHEN record_no % 107 = 0 OR record_no % 103 = 0 THEN NULL ELSE txn_id END AS txn_id,
  CASE WHEN record_no % 107 = 0 THEN 'malformed record'
       ELSE array_to_string(list_filter([
         CASE WHEN record_no % 103 = 0 THEN 'txn_id: missing' END,
         CASE WHEN record_no % 101 = 0 THEN 'amount: not a valid double' END,
         CASE WHEN record_no % 109 = 0 THEN 'customer_age: not a valid int' END],
         lambda x: x IS NOT NULL), '; ') END AS reject_reasons
FROM ({A.TRANSFERS_SQL})
WHERE record_no % 107 = 0 OR record_no % 103 = 0 OR record_no % 101 = 0 OR record_no % 109 = 0""")
def q_transfer_rejects(spark, sf_dir):
    _, rejected = _json_transfers(spark, sf_dir)
    return rejected.select("record_no", "txn_id",
                           F.array_join("reject_reasons", "; ").alias("reject_reasons"))


_JSON_VALID_SQL = f"""
SELECT * FROM ({A.TRANSFERS_SQL})
WHERE NOT (record_no % 107 = 0 OR record_no % 103 = 0 OR record_no % 101 = 0 OR record_no % 109 = 0)"""


@register("transfer_json_decision",
          _transfer_cte(False, _JSON_VALID_SQL) + _DECISION_SQL.format(extra=""))
def q_transfer_json_decision(spark, sf_dir):
    valid, _ = _json_transfers(spark, sf_dir)
    return _decision_cols(score_transfers(valid.drop("record_no"), run_id=RUN_ID, created_at=CREATED_AT))


# ------------------------------------------------------------ P4 / P5 --
_TRANSFER_FIELDS_JSON = ", ".join(
    f"'{c}': {c}" if c != "timestamp" else "'timestamp': \"timestamp\"" for c in TR.TRANSFER_COLUMNS)


@register("transfer_prompts", _transfer_cte(False) + f"""
SELECT txn_id AS case_id, 'investigator' AS step,
  'Context JSON:' || chr(10) || to_json({{
    'transfer': {{{_TRANSFER_FIELDS_JSON}}},
    'enrichment': {{'is_external': is_external, 'is_new_beneficiary': is_new_beneficiary,
      'device_known': device_known, 'geo_risk': geo_risk, 'memo_risky': memo_risky,
      'velocity': {{'out_1h': out_1h, 'out_24h': out_24h}}, 'prior_fraud': prior_fraud,
      'is_young_customer': is_young_customer, 'origin_tenure_days': origin_tenure_days,
      'beneficiary_tenure_days': beneficiary_tenure_days, 'destination_country': dest_country}},
    'rule_flags': map_from_entries(list_transform(flag_names, lambda x: {{'k': x, 'v': TRUE}})),
    'rule_reasons': reasons, 'rule_score': rule_score, 'ml_score': ml_score}}) AS prompt
FROM d""")
def q_transfer_prompts(spark, sf_dir):
    df = (A.transfers(spark, sf_dir).transform(TR.enrich_transfers)
          .transform(TR.score_rules).transform(TR.ml_risk))
    return TR.investigator_prompts(df).select("case_id", "step", "prompt")


# =========================================================== job B (cases) ==
AUDIT_TS = "2025-01-01 00:00:00"
_CUST_COLS = ["customer_id", "kyc_level", "risk_segment", "tenure_years", "email", "phone", "home_country",
              "vip", "account_age_days", "avg_monthly_spend", "chargeback_count_12m"]
_DEV_COLS = ["device_id", "reputation", "seen_before", "rooted", "distance_km_from_home", "app_version"]


def _case_cte() -> str:
    rx = PY_FLOAT_TOKEN.replace("'", "''")
    return rf"""
WITH p AS ({A.PAYMENTS_SQL}),
cu AS (SELECT * EXCLUDE (pick) FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY kyc_level) AS pick
       FROM ({A.CUSTOMERS_SQL})) WHERE pick = 1),
dv AS (SELECT * EXCLUDE (pick) FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY reputation) AS pick
       FROM ({A.DEVICES_SQL})) WHERE pick = 1),
cc AS ({A.CASE_COMPLETIONS_SQL}),
j AS (
  SELECT p.*, cu.* EXCLUDE (customer_id), dv.* EXCLUDE (device_id),
         cu.customer_id IS NOT NULL AS customer_found, dv.device_id IS NOT NULL AS device_found
  FROM p LEFT JOIN cu ON p.customer_id = cu.customer_id LEFT JOIN dv ON p.device_id = dv.device_id),
r AS (
  SELECT j.*, cc.triage_summary, cc.score_text, cc.investigation_notes
  FROM j LEFT JOIN cc ON j.txn_id = cc.case_id WHERE customer_found AND device_found),
h AS (
  SELECT *,
    list_filter([CASE WHEN amount > 15000 AND channel = 'ecom' THEN 'RULE:HIGH_AMOUNT_ECOM' END,
                 CASE WHEN NOT coalesce(seen_before, FALSE) THEN 'RULE:NEW_DEVICE' END,
                 CASE WHEN country IS DISTINCT FROM home_country THEN 'RULE:GEO_MISMATCH' END],
                lambda x: x IS NOT NULL) AS rule_hits,
    regexp_extract(coalesce(score_text, ''), '^\s*(\S+)', 1) AS score_token
  FROM r),
s AS (
  SELECT *, CASE WHEN regexp_matches(score_token, '{rx}') THEN CAST(replace(score_token, '_', '') AS DOUBLE)
                 ELSE 0.5::DOUBLE END AS model_score
  FROM h),
d AS (
  SELECT *,
    CASE WHEN isnan(model_score) THEN 'approve' WHEN model_score > 0.75 THEN 'deny'
         WHEN model_score >= 0.45 THEN 'escalate' ELSE 'approve' END AS decision,
    NOT isnan(model_score) AND model_score >= 0 AND model_score <= 1 AS score_in_range,
    CASE WHEN isnan(model_score) OR isinf(model_score) THEN NULL ELSE model_score END AS json_score
  FROM s)
"""


def _cases(spark: SparkSession, sf_dir: str):
    return run_case_batch(A.payments(spark, sf_dir), A.customers(spark, sf_dir), A.devices(spark, sf_dir),
                          A.case_completions(spark, sf_dir), audit_ts=AUDIT_TS)


@register("case_enrich", _case_cte() + """
SELECT txn_id, customer_id, device_id, customer_found, device_found, home_country, seen_before FROM j""")
def q_case_enrich(spark, sf_dir):
    df = CS.enrich_cases(A.payments(spark, sf_dir), A.customers(spark, sf_dir), A.devices(spark, sf_dir))
    return df.select("txn_id", "customer_id", "device_id", "customer_found", "device_found",
                     "home_country", "seen_before")


@register("case_rules", _case_cte() + """
SELECT txn_id, array_to_string(rule_hits, ',') AS rule_hits, CAST(len(rule_hits) AS INTEGER) AS n_rule_hits FROM d""")
def q_case_rules(spark, sf_dir):
    cases, _ = _cases(spark, sf_dir)
    return cases.select("txn_id", F.array_join("rule_hits", ",").alias("rule_hits"), "n_rule_hits")


@register("case_score_parse", _case_cte() + """
SELECT txn_id, score_text, score_token, json_score AS model_score, isnan(model_score) AS score_is_nan,
       score_in_range FROM d""")
def q_case_score_parse(spark, sf_dir):
    cases, _ = _cases(spark, sf_dir)
    return cases.select("txn_id", "score_text", "score_token",
                        CS.json_number(F.col("model_score")).alias("model_score"),
                        F.isnan("model_score").alias("score_is_nan"), "score_in_range")


@register("case_decision", _case_cte() + """
SELECT txn_id, array_to_string(rule_hits, ',') AS rule_hits, json_score AS model_score, decision FROM d""")
def q_case_decision(spark, sf_dir):
    cases, _ = _cases(spark, sf_dir)
    return cases.select("txn_id", F.array_join("rule_hits", ",").alias("rule_hits"),
                        CS.json_number(F.col("model_score")).alias("model_score"), "decision")


@register("case_errors", _case_cte() + """
SELECT txn_id, customer_id, device_id,
       concat_ws(',', CASE WHEN NOT customer_found THEN 'customer' END,
                      CASE WHEN NOT device_found THEN 'device' END) AS missing
FROM j WHERE NOT customer_found OR NOT device_found""")
def q_case_errors(spark, sf_dir):
    _, errors = _cases(spark, sf_dir)
    return errors


def _struct_sql(cols):
    return "{" + ", ".join(f"'{c}': {c}" for c in cols) + "}"


_AUDIT_PAYLOADS = [
    "to_json({'summary': triage_summary})",
    f"to_json({{'customer': {_struct_sql(_CUST_COLS)}, 'device': {_struct_sql(_DEV_COLS)}}})",
    "to_json({'rule_hits': rule_hits})",
    "to_json({'score': json_score})",
    "to_json({'notes': investigation_notes})",
    "to_json({'decision': decision, 'score': json_score})",
]


@register("case_audit", _case_cte() + " UNION ALL ".join(
    f"SELECT txn_id, {i + 1}::INTEGER AS seq, '{AUDIT_TS}' AS ts, '{ev}' AS event, CAST({pl} AS VARCHAR) AS payload FROM d"
    for i, (ev, pl) in enumerate(zip(CS.AUDIT_EVENTS, _AUDIT_PAYLOADS))))
def q_case_audit(spark, sf_dir):
    cases, _ = _cases(spark, sf_dir)
    return CS.audit_table(cases)


def _dumps_sql(cols) -> str:
    """A JSON object with spaces after commas and colons."""
    def value(c):
        if c == "flags":
            return "'[' || array_to_string(list_transform(flags, lambda x: CAST(to_json(x) AS VARCHAR)), ', ') || ']'"
        return f"coalesce(CAST(to_json({c}) AS VARCHAR), 'null')"
    quoted = [f"'\"{c}\": ' || {value(chr(34) + c + chr(34))}" if c == "timestamp" else f"'\"{c}\": ' || {value(c)}" for c in cols]
    return "'{' || " + " || ', ' || ".join(quoted) + " || '}'"


_PAYMENT_JSON = _dumps_sql(["txn_id", "amount", "currency", "merchant", "mcc", "channel", "country", "customer_id", "device_id",
                            "ip", "timestamp", "flags"])
_SYSTEM_SQL = "'You are a bank fraud investigation assistant. Be precise, cautious, and explain reasoning succinctly.'"


@register("case_prompts", _case_cte() + f"""
SELECT txn_id AS case_id, 'triage' AS step, {_SYSTEM_SQL} AS system,
       'Summarize suspicious aspects of payment ' || {_PAYMENT_JSON} AS prompt, 0.2::DOUBLE AS temperature FROM d
UNION ALL
SELECT txn_id, 'model', {_SYSTEM_SQL}, 'Estimate fraud probability (0-1) for {{"amount": ' || to_json(amount) || ', "channel": '
       || to_json(channel) || ', "new_device": ' || CASE WHEN coalesce(seen_before, FALSE) THEN 'false' ELSE 'true' END || '}}',
       0.0::DOUBLE FROM d
UNION ALL
SELECT txn_id, 'investigator', {_SYSTEM_SQL}, 'Summarize investigation for ' || {_PAYMENT_JSON} || ', rules ['
       || array_to_string(list_transform(rule_hits, lambda x: CAST(to_json(x) AS VARCHAR)), ', ') || '], score '
       || CASE WHEN isnan(model_score) THEN 'nan' ELSE CAST(model_score AS VARCHAR) END, 0.2::DOUBLE FROM d""")
def q_case_prompts(spark, sf_dir):
    cases, _ = _cases(spark, sf_dir)
    return CS.case_prompts(cases)


# ======================================================== job C (features) ==
_LOGIN, _PAY, _EVT = "event_type_login_cnt", "event_type_payment_cnt", "event_cnt"
_DE = f"({A.DAILY_EVENTS_SQL})"


def _r(x: str, places: int = 2) -> str:
    """Spark ``round`` (half-up on the decimal text of the double) in DuckDB."""
    return f"CAST(round(CAST({x} AS DECIMAL(38, 12)), {places}) AS DOUBLE)"


def _roll_sql(fn: str, col: str, size: int, off: int, part: str, order: str) -> str:
    hi = "CURRENT ROW" if off == 0 else f"INTERVAL {off} DAYS PRECEDING"
    expr = (f"{fn}({col}) OVER (PARTITION BY {part} ORDER BY {order} "
            f"RANGE BETWEEN INTERVAL {size - 1 + off} DAYS PRECEDING AND {hi})")
    name = f"{fn}_{col}_{size}d" + (f"_off{off}" if off else "")
    return f"{expr if fn == 'count' else _r(expr)} AS {name}"


def _daily(spark, sf_dir):
    return A.daily_events(spark, sf_dir)


def _date_text(df: DataFrame) -> DataFrame:
    return df.withColumn("business_date", F.col("business_date").cast("string"))


@register("daily_events", f"""
SELECT customer_id, CAST(business_date AS VARCHAR) AS business_date, {_EVT}, {_LOGIN}, {_PAY} FROM {_DE}""")
def q_daily_events(spark, sf_dir):
    return _date_text(_daily(spark, sf_dir))


_GLOBAL_FUNCS = ["sum", "avg", "count", "min", "max", "stddev"]
_GLOBAL_COLS = [_EVT, _LOGIN, _PAY]


@register("base_agg_global", "SELECT " + ", ".join(
    (f"{fn}({c}) AS {fn}_{c}" if fn == "count" else f"{_r(f'{fn}({c})')} AS {fn}_{c}")
    for fn in _GLOBAL_FUNCS for c in _GLOBAL_COLS) + f" FROM {_DE}")
def q_base_agg_global(spark, sf_dir):
    return FE.base_aggregations(_daily(spark, sf_dir), _GLOBAL_FUNCS, _GLOBAL_COLS)


@register("base_agg_grouped", f"SELECT customer_id, {_r(f'avg({_EVT})')} AS avg_{_EVT} FROM {_DE} GROUP BY customer_id")
def q_base_agg_grouped(spark, sf_dir):
    return FE.base_aggregations(_daily(spark, sf_dir), "avg", [_EVT], ["customer_id"])


@register("base_agg_attach", f"""
SELECT customer_id, CAST(business_date AS VARCHAR) AS business_date, {_EVT},
       {_r(f'avg({_EVT}) OVER (PARTITION BY customer_id)')} AS avg_{_EVT} FROM {_DE}""")
def q_base_agg_attach(spark, sf_dir):
    df = _daily(spark, sf_dir).select("customer_id", "business_date", _EVT)
    return _date_text(FE.base_aggregations(df, "avg", [_EVT], ["customer_id"], mode="attach"))


@register("base_agg_all_columns", f"""
SELECT customer_id, count(*) AS count_rows, {_r(f'max({_EVT})')} AS max_{_EVT},
       {_r(f'max({_LOGIN})')} AS max_{_LOGIN}, {_r(f'max({_PAY})')} AS max_{_PAY}
FROM {_DE} GROUP BY customer_id""")
def q_base_agg_all_columns(spark, sf_dir):
    # No columns named: every numeric non-key column; count counts rows.
    return FE.base_aggregations(_daily(spark, sf_dir), ["count", "max"], None, ["customer_id"])


@register("base_agg_distinct", """
SELECT user_id, count(DISTINCT event_type) AS count_distinct_event_type FROM events GROUP BY user_id""")
def q_base_agg_distinct(spark, sf_dir):
    ev = A.read_table(spark, sf_dir, "events", "user_id", "event_type")
    return FE.base_aggregations(ev, "count_distinct", ["event_type"], ["user_id"])


_ROLL_FUNCS, _ROLL_COLS, _ROLL_SIZES = ["sum", "avg", "count"], [_LOGIN, _PAY], [7, 3]


@register("rolling_7_3", "SELECT customer_id, CAST(business_date AS VARCHAR) AS business_date, " + ", ".join(
    _roll_sql(fn, c, w, 0, "customer_id", "business_date")
    for w in _ROLL_SIZES for fn in _ROLL_FUNCS for c in _ROLL_COLS) + f" FROM {_DE}")
def q_rolling_7_3(spark, sf_dir):
    df = _daily(spark, sf_dir).select("customer_id", "business_date", *_ROLL_COLS)
    out = FE.rolling_window_aggregations(df, ["customer_id"], "business_date", _ROLL_FUNCS, _ROLL_COLS, _ROLL_SIZES,
                                         one_row_per_day=True)
    return _date_text(out).drop(*_ROLL_COLS)


@register("rolling_offset", "SELECT customer_id, CAST(business_date AS VARCHAR) AS business_date, "
          + _roll_sql("avg", _EVT, 7, 2, "customer_id", "business_date") + ", "
          + _roll_sql("count", _EVT, 7, 2, "customer_id", "business_date") + f" FROM {_DE}")
def q_rolling_offset(spark, sf_dir):
    df = _daily(spark, sf_dir).select("customer_id", "business_date", _EVT)
    out = FE.rolling_window_aggregations(df, ["customer_id"], "business_date", ["avg", "count"], [_EVT], [7],
                                         window_offset=2)
    return _date_text(out).drop(_EVT)


_TYPES = ["view", "signup", "error", "click", "purchase"]


# One row per event, null where it is of another type: sums of many rows, and
# days that lack a type.
@register("daily_totals", "SELECT *, " + " + ".join(f"coalesce(sum_{t}, 0)" for t in _TYPES) + """ AS total_event_cnt FROM (
SELECT user_id AS customer_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS business_date, """ + ", ".join(
    f"sum(CASE WHEN event_type = '{t}' THEN 1.0::DOUBLE END) AS sum_{t}" for t in _TYPES) + """
FROM events GROUP BY user_id, CAST(ts AS DATE))""")
def q_daily_totals(spark, sf_dir):
    ev = A.read_table(spark, sf_dir, "events", "user_id", "ts", "event_type")
    rows = ev.select(F.col("user_id").alias("customer_id"), F.to_date("ts").alias("business_date"),
                     *[F.when(F.col("event_type") == t, F.lit(1.0)).alias(t) for t in _TYPES])
    return _date_text(FE.daily_totals(rows, ["customer_id"], "business_date", _TYPES))


@register("base_agg_attach_global", f"""
SELECT customer_id, CAST(business_date AS VARCHAR) AS business_date, {_r(f'avg({_EVT}) OVER ()')} AS avg_{_EVT},
       {_r(f'max({_EVT}) OVER ()')} AS max_{_EVT} FROM {_DE}""")
def q_base_agg_attach_global(spark, sf_dir):
    df = _daily(spark, sf_dir).select("customer_id", "business_date", _EVT)
    return _date_text(FE.base_aggregations(df, ["avg", "max"], [_EVT], mode="attach")).drop(_EVT)


_CHAIN = [
    FE.Rolling(["customer_id"], "business_date", ["sum", "avg"], [_LOGIN, _PAY], [7, 2], one_row_per_day=True),
    FE.BaseAgg("avg", [_EVT], ["customer_id"], mode="attach"),
]


@register("feature_chain", "SELECT customer_id, CAST(business_date AS VARCHAR) AS business_date, "
          + f"{_EVT}, {_LOGIN}, {_PAY}, "
          + ", ".join(_roll_sql(fn, c, w, 0, "customer_id", "business_date")
                      for w in [7, 2] for fn in ["sum", "avg"] for c in [_LOGIN, _PAY])
          + f", {_r(f'avg({_EVT}) OVER (PARTITION BY customer_id)')} AS avg_{_EVT} FROM {_DE}")
def q_feature_chain(spark, sf_dir):
    return _date_text(FE.build_features(_daily(spark, sf_dir), _CHAIN))


_STEPS = [
    FE.Rolling(["user_id"], "ts", "sum", ["value"], [7]),
    FE.Rolling(["user_id"], "ts", "avg", ["value"], [3]),
    FE.Rolling(["user_id"], "ts", ["min", "max"], ["value"], [5], window_offset=1),
    FE.Rolling(["user_id"], "ts", "count", ["value"], [14]),
    FE.BaseAgg("max", ["value"], ["user_id"], mode="attach"),
    FE.Rolling(["event_type"], "ts", "count", ["value"], [2]),
]


# Six steps on raw events: two sets of keys, so two daily tables.
@register("feature_chain_steps", "SELECT event_id, " + ", ".join([
    _roll_sql("sum", "value", 7, 0, "user_id", "CAST(ts AS DATE)"), _roll_sql("avg", "value", 3, 0, "user_id", "CAST(ts AS DATE)"),
    _roll_sql("min", "value", 5, 1, "user_id", "CAST(ts AS DATE)"), _roll_sql("max", "value", 5, 1, "user_id", "CAST(ts AS DATE)"),
    _roll_sql("count", "value", 14, 0, "user_id", "CAST(ts AS DATE)"), f"{_r('max(value) OVER (PARTITION BY user_id)')} AS max_value",
    _roll_sql("count", "value", 2, 0, "event_type", "CAST(ts AS DATE)")]).replace("count_value_2d", "type_count_value_2d")
    + " FROM (SELECT event_id, user_id, event_type, ts, CAST(value AS DECIMAL(18, 2)) AS value FROM events)")
def q_feature_chain_steps(spark, sf_dir):
    ev = (A.read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts", "value")
          .withColumn("value", F.col("value").cast("decimal(18,2)")))
    out = FE.build_features(ev, _STEPS)
    return out.select("event_id", *[F.col(c).cast("double").alias(c) for c in (
        "sum_value_7d", "avg_value_3d", "min_value_5d_off1", "max_value_5d_off1", "max_value")],
        "count_value_14d", F.col("count_value_2d").alias("type_count_value_2d"))


_DAY_RANGE = "PARTITION BY user_id ORDER BY CAST(ts AS DATE) RANGE BETWEEN INTERVAL {} DAYS PRECEDING AND {}"
_DISTINCT_SQL = ", ".join(
    f"count(DISTINCT {c}) OVER ({_DAY_RANGE.format(lo, hi)}) AS count_distinct_{c}_{name}"
    for c in ("event_type", "value") for lo, hi, name in ((6, "CURRENT ROW", "7d"), (0, "CURRENT ROW", "1d")))


@register("rolling_distinct", f"SELECT event_id, user_id, {_DISTINCT_SQL}, count(DISTINCT event_type) OVER ("
          + _DAY_RANGE.format(6, "INTERVAL 2 DAYS PRECEDING") + ") AS count_distinct_event_type_5d_off2 FROM events")
def q_rolling_distinct(spark, sf_dir):
    ev = A.read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts", "value")
    out = FE.build_features(ev, [FE.Rolling(["user_id"], "ts", "count_distinct", ["event_type", "value"], [7, 1]),
                                 FE.Rolling(["user_id"], "ts", "count_distinct", ["event_type"], [5], window_offset=2)])
    return out.drop("event_type", "ts", "value")


def _within(about: str, exact: str, error: float) -> F.Column:
    """Four standard errors of the sketch hold."""
    return F.abs(F.col(about) - F.col(exact)) <= 4 * error * F.col(exact) + 1


@register("rolling_distinct_approx", """
SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
  max(n7) AS count_distinct_user_id_7d, TRUE AS estimate_holds, TRUE AS merged_estimate_holds
FROM (SELECT event_type, ts, count(DISTINCT user_id) OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)
        RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS n7 FROM events)
GROUP BY event_type, CAST(ts AS DATE)""")
def q_rolling_distinct_approx(spark, sf_dir):
    # Estimates from daily sketches: made in one go, and merged from those of two runs that share days and users.
    ev = A.read_table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "ts")
    rows = FE.rolling_window_aggregations(ev, ["event_type"], "ts", ["count_distinct", "approx_count_distinct"], ["user_id"], 7)
    exact, about = "count_distinct_user_id_7d", "approx_count_distinct_user_id_7d"
    days = rows.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max(exact).alias(exact), F.max(about).alias("__one"))
    runs = [FE.daily_sketches(ev.filter(f"event_id % 3 {op} 1"), ["event_type"], "ts", ["user_id"]) for op in ("<=", ">=")]
    merged = FE.sketched_distinct_counts(FE.merge_sketches(runs, ["event_type"]), ["event_type"], [7])
    both = days.join(merged, ["event_type", "day"])
    return both.select("event_type", F.col("day").cast("string").alias("day"), exact,
                       _within("__one", exact, FE.SKETCH_ERROR).alias("estimate_holds"),
                       _within(about, exact, FE.SKETCH_ERROR).alias("merged_estimate_holds"))


@register("base_agg_approx_distinct", """
SELECT event_type, count(DISTINCT user_id) AS count_distinct_user_id, TRUE AS estimate_holds FROM events GROUP BY event_type""")
def q_base_agg_approx_distinct(spark, sf_dir):
    ev = A.read_table(spark, sf_dir, "events", "event_type", "user_id")
    out = FE.base_aggregations(ev, ["count_distinct", "approx_count_distinct"], ["user_id"], ["event_type"])
    return out.select("event_type", "count_distinct_user_id",
                      _within("approx_count_distinct_user_id", "count_distinct_user_id", 0.05).alias("estimate_holds"))


_RAW_FUNCS = ["sum", "avg", "count", "max"]


@register("rolling_events_daily", "SELECT event_id, user_id, " + ", ".join(
    _roll_sql(fn, "value", w, 0, "user_id", "CAST(ts AS DATE)") for w in [7, 1] for fn in _RAW_FUNCS)
    + " FROM (SELECT event_id, user_id, ts, CAST(value AS DECIMAL(18, 2)) AS value FROM events)")
def q_rolling_events_daily(spark, sf_dir):
    # Amounts with two decimals are summed as decimals: exact, so equal
    # whatever order the partial sums combine in.
    ev = (A.read_table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value")
          .withColumn("value", F.col("value").cast("decimal(18,2)")))
    out = FE.rolling_window_aggregations(ev, ["user_id"], "ts", _RAW_FUNCS, ["value"], [7, 1])
    feats = [c for c in out.columns if c not in ("event_id", "user_id", "ts", "value")]
    return out.select("event_id", "user_id",
                      *[F.col(c).cast("long" if c.startswith("count_") else "double").alias(c) for c in feats])


_MOMENT_SQL = "SELECT event_id, user_id, ts, value FROM events"


@register("rolling_stddev", "SELECT event_id, user_id, " + ", ".join(
    f"CAST(round(CAST(stddev_samp(value) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) RANGE BETWEEN INTERVAL {w - 1} DAYS "
    f"PRECEDING AND CURRENT ROW) AS DECIMAL(38, 12)), 2) AS DOUBLE) AS stddev_value_{w}d" for w in (7, 1)) + f" FROM ({_MOMENT_SQL})")
def q_rolling_stddev(spark, sf_dir):
    ev = A.read_table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value")
    return FE.rolling_window_aggregations(ev, ["user_id"], "ts", "stddev", ["value"], [7, 1]).drop("ts", "value")


@register("rolling_min_max", "SELECT event_id, user_id, " + ", ".join(
    _roll_sql(fn, "value", 3, 1, "user_id", "CAST(ts AS DATE)") for fn in ("min", "max")) + f" FROM ({_MOMENT_SQL})")
def q_rolling_min_max(spark, sf_dir):
    ev = A.read_table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value")
    return FE.rolling_window_aggregations(ev, ["user_id"], "ts", ["min", "max"], ["value"], [3], window_offset=1).drop("ts", "value")


# ======================================================= job D (documents) ==
_DIMS = 64


def _chunks_sql(size: int = DOC.CHUNK_SIZE, overlap: int = DOC.CHUNK_OVERLAP) -> str:
    step = size - overlap
    return f"""
SELECT doc_id, CAST(s // {step} AS INTEGER) AS chunk_id, CAST(s AS INTEGER) AS start,
       substring(text, s + 1, {size}) AS chunk_text
FROM documents, unnest(generate_series(0, greatest(length(text) - {overlap + 1}, 0), {step})) AS u(s)
WHERE length(text) > 0"""


def _bucket_sql(text: str, dims: int = _DIMS) -> str:
    tokens = rf"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
    return f"list_transform({tokens}, lambda t: CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % {dims})"


def _count_sql(buckets: str, dims: int = _DIMS) -> str:
    return f"list_transform(range({dims}), lambda i: CAST(len(list_filter({buckets}, lambda x: x = i)) AS DOUBLE))"


def _normalized_sql(counts: str) -> str:
    norm = f"sqrt(list_sum(list_transform({counts}, lambda x: x * x)))"
    return f"CASE WHEN {norm} > 0 THEN list_transform({counts}, lambda x: x / {norm}) ELSE {counts} END"


def _vector_ctes(prefix: str, source: str, text: str, keys: str) -> str:
    """Materialised stages: token buckets, counts, normalised vector ``v``."""
    return (f"{prefix}b AS MATERIALIZED (SELECT {keys}, {_bucket_sql(text)} AS b FROM {source}), "
            f"{prefix}n AS MATERIALIZED (SELECT {keys}, b, {_count_sql('b')} AS cnt FROM {prefix}b), "
            f"{prefix}v AS MATERIALIZED (SELECT {keys}, b, cnt, {_normalized_sql('cnt')} AS v FROM {prefix}n)")


def _fixed_chunks(spark, sf_dir):
    return DOC.chunk_documents(A.read_table(spark, sf_dir, "documents", "doc_id", "text"))


def _chunk_summary(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "chunk_id", "start", F.length("chunk_text").alias("chunk_len"),
                     F.md5("chunk_text").alias("chunk_md5"))


@register("chunks_fixed", f"""
SELECT doc_id, chunk_id, start, CAST(length(chunk_text) AS INTEGER) AS chunk_len, md5(chunk_text) AS chunk_md5
FROM ({_chunks_sql()})""")
def q_chunks_fixed(spark, sf_dir):
    return _chunk_summary(_fixed_chunks(spark, sf_dir))


def _split_sql(spans: str, sep: str, size: int) -> str:
    """Spans that are too long, split behind every ``sep``."""
    cut = (f"list_filter(list_transform(range(1, len(string_split(s, {sep})) + 1), lambda i: CASE WHEN i < len(string_split(s, {sep})) "
           f"THEN string_split(s, {sep})[i] || {sep} ELSE string_split(s, {sep})[i] END), lambda x: x <> '')")
    return f"flatten(list_transform({spans}, lambda s: CASE WHEN length(s) <= {size} THEN [s] ELSE {cut} END))"


def _boundary_ctes(size: int = DOC.CHUNK_SIZE, overlap: int = DOC.CHUNK_OVERLAP) -> str:
    """The cut itself, for WITH RECURSIVE: spans between separators, their ends
    ``p``, and chunk by chunk the spans ``f`` .. ``e - 1`` that fit; ``c`` has the chunks."""
    pieces = f"list_transform(range(0, length(s), {size}), lambda o: substr(s, CAST(o + 1 AS BIGINT), {size}))"
    blank = r"[^\x09-\x0D\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    end = f"coalesce(list_filter(range(f + 1, len(p) + 1), lambda i: p[i] - p0 > {size})[1], len(p) + 1)"
    room = f"least({overlap}, {size} - (p[e] - p[e - 1]))"
    first = f"list_filter(range(f, e + 1), lambda j: p[e - 1] - CASE WHEN j = 1 THEN 0 ELSE p[j - 1] END <= {room})[1]"
    return f"""
s1 AS MATERIALIZED (SELECT doc_id, text, {_split_sql('[text]', 'chr(10) || chr(10)', size)} AS a FROM documents WHERE length(text) > 0),
s2 AS MATERIALIZED (SELECT doc_id, text, {_split_sql('a', 'chr(10)', size)} AS a FROM s1),
s3 AS MATERIALIZED (SELECT doc_id, text, {_split_sql('a', "' '", size)} AS a FROM s2),
s4 AS MATERIALIZED (SELECT doc_id, text, flatten(list_transform(a, lambda s: {pieces})) AS a FROM s3),
ends AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS p
         FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(list_transform(a, lambda x: length(x))) AS n FROM s4)),
lists AS MATERIALIZED (SELECT doc_id, list(CAST(p AS BIGINT) ORDER BY i) AS p FROM ends GROUP BY doc_id),
cuts AS (
  SELECT doc_id, 0 AS n, f, p0, {end} AS e FROM (SELECT doc_id, p, 1::BIGINT AS f, 0::BIGINT AS p0 FROM lists)
  UNION ALL
  SELECT doc_id, n, f, p0, {end} AS e FROM (
    SELECT doc_id, p, n, f, CASE WHEN f = 1 THEN 0 ELSE p[f - 1] END AS p0 FROM (
      SELECT doc_id, p, cuts.n + 1 AS n, {first} AS f FROM cuts JOIN lists USING (doc_id) WHERE e <= len(p)))),
c AS MATERIALIZED (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS chunk_id, CAST(p0 AS INTEGER) AS start, chunk_text
  FROM (SELECT doc_id, n, p0, substr(text, p0 + 1, p[e - 1] - p0) AS chunk_text FROM cuts JOIN lists USING (doc_id) JOIN s4 USING (doc_id))
  WHERE regexp_matches(chunk_text, '{blank}'))"""


@register("chunks_boundary", f"""
WITH RECURSIVE {_boundary_ctes()}
SELECT doc_id, chunk_id, start, CAST(length(chunk_text) AS INTEGER) AS chunk_len, md5(chunk_text) AS chunk_md5 FROM c""")
def q_chunks_boundary(spark, sf_dir):
    return _chunk_summary(DOC.chunk_documents_boundary(A.read_table(spark, sf_dir, "documents", "doc_id", "text")))


@register("chunk_vectors", f"""
WITH c AS MATERIALIZED ({_chunks_sql()}),
{_vector_ctes('c', 'c', 'chunk_text', 'doc_id, chunk_id')}
SELECT doc_id, chunk_id, CAST(len(b) AS BIGINT) AS n_terms,
       array_to_string(list_transform(v, lambda x: printf('%.6f', x)), ',') AS vector_text
FROM cv""")
def q_chunk_vectors(spark, sf_dir):
    ch = _fixed_chunks(spark, sf_dir)
    b = DOC.term_buckets(F.col("chunk_text"), _DIMS)
    vec = DOC.hashed_term_vector(F.col("chunk_text"), _DIMS)
    return ch.select("doc_id", "chunk_id", F.size(b).cast("long").alias("n_terms"),
                     F.array_join(F.transform(vec, lambda x: F.call_function("format_number", x, F.lit("0.000000"))),
                                  ",").alias("vector_text"))


_WIDE = 300


@register("chunk_vectors_wide", f"""
WITH c AS MATERIALIZED ({_chunks_sql()}),
{_vector_ctes('c', 'c', 'chunk_text', 'doc_id, chunk_id').replace(f'% {_DIMS}', f'% {_WIDE}').replace(f'range({_DIMS})', f'range({_WIDE})')}
SELECT doc_id, chunk_id, CAST(len(list_filter(v, lambda x: x > 0)) AS BIGINT) AS n_buckets,
       md5(array_to_string(list_transform(v, lambda x: printf('%.6f', x)), ',')) AS vector_md5
FROM cv""")
def q_chunk_vectors_wide(spark, sf_dir):
    rows = DOC.vectorize_chunks(_fixed_chunks(spark, sf_dir), _WIDE)
    text = F.transform("vector", lambda x: F.call_function("format_number", x, F.lit("0.000000")))
    return rows.select("doc_id", "chunk_id", F.size(F.filter("vector", lambda x: x > 0)).cast("long").alias("n_buckets"),
                       F.md5(F.array_join(text, ",")).alias("vector_md5"))


_COARSE = "list_transform(e, lambda x: round(x * 2))"


# Coarse vectors score whole numbers: many ties, zero vectors among them.
@register("knn_ties", f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
z AS (SELECT vec_id, {_COARSE} AS e FROM v),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
         list_sum(list_transform(list_zip(a.e, b.e), lambda x: x[1] * x[2])) AS s
  FROM z a JOIN z b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbor_id) AS rank FROM p)
SELECT query_id, neighbor_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def q_knn_ties(spark, sf_dir):
    emb = A.read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    coarse = emb.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round(x * 2)))
    res = VEC.similarity_search(coarse.withColumnRenamed("vec_id", "query_id"), coarse, k=DOC.TOP_K,
                                query_vec="embedding", item_cols="vec_id", item_vec="embedding", metric="dot", exclude_self=True)
    return res.select("query_id", F.col("vec_id").alias("neighbor_id"), "rank")


@register("knn_nonfinite", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
         list_sum(list_transform(list_zip(a.e, b.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE b.vec_id % 3 = 0 AND a.vec_id % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id) AS rank FROM p)
SELECT query_id, neighbor_id, CAST(rank AS INTEGER) AS rank, round(d, 4) AS distance FROM r WHERE rank <= 3""")
def q_knn_nonfinite(spark, sf_dir):
    # Two of three vectors hold NaN or infinity: they neither find nor hide anything.
    emb = A.read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    bad = F.when(F.col("vec_id") % 3 == 1, F.lit(float("nan"))).when(F.col("vec_id") % 3 == 2, F.lit(float("inf"))).cast("float")
    spoilt = emb.withColumn("embedding", F.transform("embedding", lambda x, i: F.coalesce(F.when(i == 5, bad), x)))
    res = VEC.similarity_search(spoilt.withColumnRenamed("vec_id", "query_id"), spoilt, k=DOC.TOP_K, query_vec="embedding",
                                item_cols="vec_id", item_vec="embedding", metric="l2", exclude_self=True)
    return res.select("query_id", F.col("vec_id").alias("neighbor_id"), "rank", F.round("score", 4).alias("distance"))


_TOP3_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
         list_sum(list_transform(list_zip(a.e, b.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d
  FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id) AS rank FROM p)
SELECT query_id, neighbor_id, CAST(rank AS INTEGER) AS rank, round(d, 4) AS distance FROM r WHERE rank <= 3"""


@register("knn_top3", _TOP3_SQL)
def q_knn_top3(spark, sf_dir):
    emb = A.read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    res = VEC.similarity_search(emb.withColumnRenamed("vec_id", "query_id"), emb, k=DOC.TOP_K,
                                query_id="query_id", query_vec="embedding", item_cols="vec_id",
                                item_vec="embedding", metric="l2", exclude_self=True)
    return res.select("query_id", F.col("vec_id").alias("neighbor_id"), "rank",
                      F.round("score", 4).alias("distance"))


# The same rows from the pruned index (exact, cells left out by the triangle inequality).
@register("knn_index_top3", _TOP3_SQL)
def q_knn_index_top3(spark, sf_dir):
    emb = A.read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    index = IDX.build_index(emb, "vec_id", "embedding")
    res = IDX.index_search(index, emb.withColumnRenamed("vec_id", "query_id"), k=DOC.TOP_K, query_vec="embedding", exclude_self=True)
    return res.select("query_id", F.col("vec_id").alias("neighbor_id"), "rank", F.round("score", 4).alias("distance"))


def _search_sql(chunks: str) -> str:
    return f"""
WITH {chunks},
{_vector_ctes('c', 'c', 'chunk_text', 'doc_id, chunk_id, chunk_text')},
{_vector_ctes('q', 'benchmark', 'text', 'item_id')},
p AS (SELECT qv.item_id, cv.doc_id, cv.chunk_id, cv.chunk_text, list_inner_product(qv.v, cv.v) AS s FROM qv, cv),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id, chunk_id) AS rank FROM p)
SELECT item_id AS query_id,
       md5(string_agg(chunk_text, chr(10) || chr(10) ORDER BY rank)) AS context_md5,
       string_agg(CAST(doc_id AS VARCHAR) || ':' || CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS top_chunks,
       round(max(s), 6) AS best_score
FROM r WHERE rank <= 3 GROUP BY item_id"""


def _search_context(spark, sf_dir, chunks: str) -> DataFrame:
    docs = A.read_table(spark, sf_dir, "documents", "doc_id", "text")
    bench = A.read_table(spark, sf_dir, "benchmark", "item_id", "text")
    res = search_documents(docs, bench.withColumnRenamed("item_id", "query_id"), k=DOC.TOP_K, dims=_DIMS, chunks=chunks)
    return res.select("query_id", F.md5("context").alias("context_md5"), "top_chunks",
                      F.round("best_score", 6).alias("best_score"))


@register("search_context", _search_sql(f"c AS MATERIALIZED ({_chunks_sql()})"))
def q_search_context(spark, sf_dir):
    return _search_context(spark, sf_dir, "fixed")


@register("search_context_boundary", _search_sql(f"RECURSIVE {_boundary_ctes()}"))
def q_search_context_boundary(spark, sf_dir):
    return _search_context(spark, sf_dir, "boundary")


# ------------------------------------------------ weighted terms (D2 / D3) --
def _tfidf_ctes() -> str:
    words = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
    return f"""
c AS MATERIALIZED ({_chunks_sql()}),
tf AS MATERIALIZED (SELECT doc_id, chunk_id, term, count(*) AS n FROM (
  SELECT doc_id, chunk_id, unnest({words.format('chunk_text')}) AS term FROM c) GROUP BY ALL),
df AS MATERIALIZED (SELECT term, ln((1 + (SELECT count(*) FROM c)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tf GROUP BY term),
w AS (SELECT doc_id, chunk_id, term, n * idf AS x FROM tf JOIN df USING (term)),
v AS MATERIALIZED (SELECT doc_id, chunk_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, chunk_id)) AS x FROM w),
qt AS (SELECT item_id, term, count(*) AS n FROM (
  SELECT item_id, unnest({words.format('text')}) AS term FROM benchmark) GROUP BY ALL),
qw AS (SELECT item_id, term, n * idf AS x FROM qt JOIN df USING (term)),
qv AS MATERIALIZED (SELECT item_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS x FROM qw)"""


@register("chunk_tfidf", f"""
WITH {_tfidf_ctes()}
SELECT doc_id, chunk_id, count(*) AS n_terms,
       md5(string_agg(term || ':' || printf('%.6f', x), ',' ORDER BY term)) AS vector_md5
FROM v GROUP BY doc_id, chunk_id""")
def q_chunk_tfidf(spark, sf_dir):
    vec = TERMS.tfidf(_fixed_chunks(spark, sf_dir), ["doc_id", "chunk_id"], "chunk_text").vectors
    text = F.transform("vector", lambda x: F.concat(x["term"], F.lit(":"), F.call_function("format_number", x["weight"], F.lit("0.000000"))))
    return vec.select("doc_id", "chunk_id", F.size("vector").cast("long").alias("n_terms"), F.md5(F.array_join(text, ",")).alias("vector_md5"))


# Top chunks by weighted terms, through posting lists; the SQL scores everything.
@register("search_postings", f"""
WITH {_tfidf_ctes()},
p AS (SELECT item_id, doc_id, chunk_id, round(sum(qv.x * v.x), 9) AS s FROM qv JOIN v USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id, chunk_id) AS rank FROM p)
SELECT item_id AS query_id, doc_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM r WHERE rank <= 3""")
def q_search_postings(spark, sf_dir):
    keys = ["doc_id", "chunk_id"]
    index = TERMS.build_postings(_fixed_chunks(spark, sf_dir), keys, "chunk_text")
    bench = A.read_table(spark, sf_dir, "benchmark", "item_id", "text")
    found = TERMS.search_postings(index, bench.withColumnRenamed("item_id", "query_id"), k=DOC.TOP_K)
    return found.select("query_id", *keys, "rank", F.round("score", 6).alias("score"))


# ================================================== tool + derived inputs ==
@register("product", "SELECT l_orderkey, l_linenumber, l_partkey * l_suppkey AS product FROM lineitem")
def q_product(spark, sf_dir):
    li = A.read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.select("l_orderkey", "l_linenumber", TOOLS.multiply("l_partkey", "l_suppkey").alias("product"))


@register("event_velocity", """
SELECT event_id, user_id,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING)
    AS count_prev_3600s,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING)
    AS count_prev_86400s
FROM events""")
def q_event_velocity(spark, sf_dir):
    ev = A.read_table(spark, sf_dir, "events", "event_id", "user_id", "ts")
    return DER.trailing_counts(ev, "user_id", "ts", [3600, 86400]).drop("ts")


@register("event_velocity_null_times", """
SELECT event_id, user_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE
  count(*) FILTER (WHERE event_id % 9 <> 0) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
    RANGE BETWEEN 5400000000 PRECEDING AND 1 PRECEDING) END AS count_prev_5400s
FROM events""")
def q_event_velocity_null_times(spark, sf_dir):
    ev = A.read_table(spark, sf_dir, "events", "event_id", "user_id", "ts")
    ev = ev.withColumn("ts", F.when(F.col("event_id") % 9 != 0, F.col("ts")))
    return DER.trailing_counts(ev, "user_id", "ts", [5400]).drop("ts")


@register("first_seen", """
SELECT event_id, user_id, event_type,
  CAST(date_diff('day', min(CAST(ts AS DATE)) OVER (PARTITION BY user_id, event_type), CAST(ts AS DATE)) AS INTEGER)
    AS first_seen_days
FROM events""")
def q_first_seen(spark, sf_dir):
    ev = A.read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    return DER.first_seen_days(ev, ["user_id", "event_type"], "ts").drop("ts")


# ======================================================= sinks (S4 / S5) ==
_ENRICH_JSON = ("{'is_external': is_external, 'is_new_beneficiary': is_new_beneficiary, "
                "'device_known': device_known, 'geo_risk': geo_risk, 'memo_risky': memo_risky, "
                "'velocity': {'out_1h': out_1h, 'out_24h': out_24h}, 'prior_fraud': prior_fraud, "
                "'is_young_customer': is_young_customer, 'origin_tenure_days': origin_tenure_days, "
                "'beneficiary_tenure_days': beneficiary_tenure_days, 'destination_country': dest_country}")


@register("transfer_report_json", _transfer_cte(True) + f"""
SELECT case_id, txn_id, CAST(to_json({{
    'case_id': case_id, 'txn_id': txn_id, 'created_at': '{CREATED_AT}',
    'enrichment': {_ENRICH_JSON},
    'rules': {{'flags': map_from_entries(list_transform(flag_names, lambda x: {{'k': x, 'v': TRUE}})),
               'reasons': reasons, 'rule_score': rule_score}},
    'ml_score': ml_score, 'investigator_notes': investigator_notes,
    'decision': {{'verdict': verdict, 'reasons': decision_reasons, 'score': decision_score,
                  'sla_priority': sla_priority}},
    'summary': summary}}) AS VARCHAR) AS report_json
FROM d""")
def q_transfer_report_json(spark, sf_dir):
    return TR.report_json(_scored(spark, sf_dir, True))


@register("case_listing", _case_cte() + """
SELECT txn_id AS case_id, decision,
       CASE WHEN isnan(model_score) THEN 'nan' ELSE CAST(model_score AS VARCHAR) END AS model_score,
       array_to_string(rule_hits, ',') AS rule_hits,
       investigation_notes FROM d""")
def q_case_listing(spark, sf_dir):
    cases, _ = _cases(spark, sf_dir)
    return SINKS.case_listing(cases)
