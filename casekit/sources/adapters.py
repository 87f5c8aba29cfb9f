"""Adapter views: the driver's TPC-H-like tables in the shapes the jobs take.

Every view is a projection (plus, where a field needs it, an equi-join) of
the given tables, so its size grows with them.  Each Spark view has a DuckDB
twin in ``*_SQL`` that the oracle queries build on; both must stay in step.
The modulo expressions only *derive field values* (covering null, empty and
case variants); no view drops rows to make a check cheaper.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casekit.functions.parallel import spread
from casekit.schemas import TRANSFER_COLUMNS, TRANSFER_TEXT
from casekit.sources.tables import read_table  # noqa: F401  (re-exported)


def _iso(ts: str) -> Column:
    return F.date_format(F.col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _s(c: Column) -> Column:
    return c.cast("string")


# ------------------------------------------------------------ transfers --
def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed transfer records: ``orders`` joined to ``customer``."""
    o = spread(read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                          "o_totalprice", "o_orderdate"))
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    m16, m5, m7, m6, m10 = k % 16, k % 5, k % 7, k % 6, k % 10
    return j.select(
        F.concat(F.lit("TX-"), _s(k)).alias("txn_id"),
        _iso("o_orderdate").alias("timestamp"),
        (F.col("o_totalprice") / 25.0).alias("amount"),
        F.lit("USD").alias("currency"),
        F.concat(F.lit("ACC-"), _s(ck)).alias("origin_account_id"),
        F.concat(F.lit("ACC-"), _s((k * 7) % 1500)).alias("destination_account_id"),
        F.when(F.col("o_orderstatus") == "F", "EXTERNAL")
        .when(F.col("o_orderstatus") == "O", "external")
        .otherwise("INTERNAL").alias("transfer_type"),
        F.concat(F.lit("BANK-"), _s(k % 50)).alias("destination_bank_code"),
        F.when(m16 == 0, "RU").when(m16 == 1, "ng").when(m16 == 2, "VN").when(m16 == 3, "PK")
        .when(m16 == 4, F.lit(None).cast("string")).when(m16 == 5, "").otherwise("US")
        .alias("destination_country"),
        (m16 < 4).alias("is_international"),
        F.when(k % 3 == 0, "APP").when(k % 3 == 1, "WEB").otherwise("BRANCH").alias("channel"),
        F.when(m6 == 0, F.lit(None).cast("string")).when(m6 == 1, "")
        .otherwise(F.concat(F.lit("dev-"), _s(ck))).alias("device_id"),
        F.concat(F.lit("10."), _s(k % 256), F.lit("."), _s(ck % 256), F.lit(".1")).alias("ip_address"),
        F.lit("US").alias("origin_country"),
        F.when(ck % 8 == 0, F.lit(None)).otherwise(ck % 60 + 12).cast("int").alias("customer_age"),
        F.when(ck % 9 == 0, F.lit(None)).otherwise((ck * 13) % 400).cast("int")
        .alias("origin_account_tenure_days"),
        F.when(m5 == 0, F.lit(True)).when(m5 == 1, F.lit(None)).otherwise(F.lit(False))
        .alias("new_beneficiary"),
        F.when(m7 == 0, F.lit(0)).when(m7 == 1, F.lit(None)).otherwise(k % 400).cast("int")
        .alias("payee_first_seen_days"),
        (k % 1000).cast("int").alias("beneficiary_account_tenure_days"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(k % 8).cast("int").alias("outbound_velocity_1h_count"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(k % 20).cast("int").alias("outbound_velocity_24h_count"),
        F.when(ck % 10 == 0, F.lit(None)).when(F.col("c_acctbal") < 0, ck % 5).otherwise(F.lit(0))
        .cast("int").alias("previous_fraud_reports"),
        F.when(m10 == 0, "CRYPTO top-up").when(m10 == 1, "student loans").when(m10 == 2, "gift")
        .when(m10 == 3, "gift cards").when(m10 == 4, F.lit(None).cast("string")).when(m10 == 5, "")
        .otherwise("rent split").alias("memo"),
    )


TRANSFERS_SQL = """
SELECT
  'TX-' || CAST(o_orderkey AS VARCHAR) AS txn_id,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp",
  o_totalprice / 25.0::DOUBLE AS amount,
  'USD' AS currency,
  'ACC-' || CAST(o_custkey AS VARCHAR) AS origin_account_id,
  'ACC-' || CAST((o_orderkey * 7) % 1500 AS VARCHAR) AS destination_account_id,
  CASE o_orderstatus WHEN 'F' THEN 'EXTERNAL' WHEN 'O' THEN 'external' ELSE 'INTERNAL' END AS transfer_type,
  'BANK-' || CAST(o_orderkey % 50 AS VARCHAR) AS destination_bank_code,
  CASE o_orderkey % 16 WHEN 0 THEN 'RU' WHEN 1 THEN 'ng' WHEN 2 THEN 'VN' WHEN 3 THEN 'PK'
       WHEN 4 THEN NULL WHEN 5 THEN '' ELSE 'US' END AS destination_country,
  o_orderkey % 16 < 4 AS is_international,
  CASE o_orderkey % 3 WHEN 0 THEN 'APP' WHEN 1 THEN 'WEB' ELSE 'BRANCH' END AS channel,
  CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'dev-' || CAST(o_custkey AS VARCHAR) END AS device_id,
  '10.' || CAST(o_orderkey % 256 AS VARCHAR) || '.' || CAST(o_custkey % 256 AS VARCHAR) || '.1' AS ip_address,
  'US' AS origin_country,
  CAST(CASE WHEN o_custkey % 8 = 0 THEN NULL ELSE o_custkey % 60 + 12 END AS INTEGER) AS customer_age,
  CAST(CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE (o_custkey * 13) % 400 END AS INTEGER) AS origin_account_tenure_days,
  CASE o_orderkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS new_beneficiary,
  CAST(CASE o_orderkey % 7 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE o_orderkey % 400 END AS INTEGER) AS payee_first_seen_days,
  CAST(o_orderkey % 1000 AS INTEGER) AS beneficiary_account_tenure_days,
  CAST(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 8 END AS INTEGER) AS outbound_velocity_1h_count,
  CAST(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 20 END AS INTEGER) AS outbound_velocity_24h_count,
  CAST(CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN c_acctbal < 0 THEN o_custkey % 5 ELSE 0 END AS INTEGER) AS previous_fraud_reports,
  CASE o_orderkey % 10 WHEN 0 THEN 'CRYPTO top-up' WHEN 1 THEN 'student loans' WHEN 2 THEN 'gift'
       WHEN 3 THEN 'gift cards' WHEN 4 THEN NULL WHEN 5 THEN '' ELSE 'rent split' END AS memo,
  o_orderkey AS record_no
FROM orders JOIN customer ON o_custkey = c_custkey
"""


# Investigator completions per transfer (one per case; some cases none).
NOTE_TEXTS = {
    1: "x\nRecommendation: decline",
    2: "RECOMMENDATION: APPROVE\nlater\n recommendation: REVIEW  ",
    3: "RECOMMENDATION: APPROVE|REVIEW",
    4: "Signals look consistent with account history.",
    5: "RECOMMENDATION:",
    6: "x\n\u00a0RECOMMENDATION: DECLINE\u2003",
    7: "RECOMMENDATION: APPROVE\x1cRECOMMENDATION: DECLINE",
    8: "",
    9: "note\u2028\u3000recommendation:\u00a0approve \x1f",
}
NOTE_KINDS = 11  # by case number: 0 has no row, 10 a row without text
SECOND_NOTE = "second opinion\nRECOMMENDATION: REVIEW"  # every 17th case has two rows; the greater text counts


def transfer_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``completions(case_id, step, text)`` for the investigator step."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey")
    k = F.col("o_orderkey") % NOTE_KINDS
    text = F.lit(None).cast("string")
    for r, t in NOTE_TEXTS.items():
        text = F.when(k == r, F.lit(t)).otherwise(text)
    texts = F.when(F.col("o_orderkey") % 17 == 0, F.array(text, F.lit(SECOND_NOTE))).otherwise(F.array(text))
    return (o.filter(k != 0)
            .select(F.concat(F.lit("TX-"), _s(F.col("o_orderkey"))).alias("case_id"),
                    F.lit("investigator").alias("step"), F.explode(texts).alias("text")))


def _sql_str(t: str) -> str:
    parts = re.split(r"([^\x20-\x7e])", t)
    return " || ".join(f"chr({ord(p)})" if re.fullmatch(r"[^\x20-\x7e]", p) else "'" + p.replace("'", "''") + "'" for p in parts)


TRANSFER_NOTES_SQL = (
    f"SELECT 'TX-' || CAST(o_orderkey AS VARCHAR) AS case_id, 'investigator' AS step, CASE o_orderkey % {NOTE_KINDS} "
    + " ".join(f"WHEN {r} THEN {_sql_str(t)}" for r, t in NOTE_TEXTS.items())
    + f" END AS text FROM orders WHERE o_orderkey % {NOTE_KINDS} <> 0 UNION ALL "
    f"SELECT 'TX-' || CAST(o_orderkey AS VARCHAR), 'investigator', {_sql_str(SECOND_NOTE)} FROM orders "
    f"WHERE o_orderkey % {NOTE_KINDS} <> 0 AND o_orderkey % 17 = 0"
)


def transfers_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers as JSON text lines ``(record_no, value)``, with damage:
    ``record_no % 101 = 0`` amount 'n/a'; ``% 103`` no txn_id; ``% 107``
    truncated (malformed) text; ``% 109`` customer_age 'old' (an
    optional field that is present must be valid too)."""
    t = transfers(spark, sf_dir).withColumn("record_no", F.expr("cast(substring(txn_id, 4) as bigint)"))
    k = F.col("record_no")
    fields = {c: _s(F.col(c)) for c in TRANSFER_COLUMNS}
    fields["amount"] = F.when(k % 101 == 0, F.lit("n/a")).otherwise(fields["amount"])
    fields["txn_id"] = F.when(k % 103 == 0, F.lit(None).cast("string")).otherwise(fields["txn_id"])
    fields["customer_age"] = F.when(k % 109 == 0, F.lit("old")).otherwise(fields["customer_age"])
    text = F.when(k % 107 == 0, F.expr("substring(__j, 1, length(__j) - 7)")).otherwise(F.col("__j"))
    return (t.select(k, F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()])).alias("__j"))
            .select(k, text.alias("value")))


def parse_transfer_text(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON text column -> all-string transfer columns + corrupt-record slot."""
    parsed = F.from_json(F.col(value), TRANSFER_TEXT,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rest = [c for c in df.columns if c != value]
    # inline(array(struct)) parses each text once: a Generate node stops
    # Catalyst from inlining from_json into every field access.
    return df.select(*rest, F.inline(F.array(parsed)))


# ------------------------------------------------------------- payments --
PAYMENT_SCORE_TEXTS = {
    1: "0.8 high", 2: "0.75", 3: "0.45", 4: "0.1", 5: "85%", 6: "85",
    7: "nan", 8: "1_0", 9: "1.0d", 10: "", 11: "  0.3  likely benign",
}


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice",
                          "o_orderdate", "o_orderpriority"))
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    k, ck, pr = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
    return j.select(
        F.concat(F.lit("PAY-"), _s(k)).alias("txn_id"),
        (F.col("o_totalprice") / 25.0).alias("amount"),
        F.lit("INR").alias("currency"),
        F.concat(F.lit("MERCHANT-"), _s(k % 200)).alias("merchant"),
        (k % 1000 + 5000).alias("mcc"),
        F.when(pr.isin("1-URGENT", "2-HIGH"), "ecom").when(pr == "5-LOW", "ECOM")
        .otherwise("pos").alias("channel"),
        F.when(k % 9 == 0, F.lit(None).cast("string")).when(k % 4 == 0, _s(k % 25))
        .otherwise(_s(F.col("c_nationkey"))).alias("country"),
        F.when(k % 50 == 0, ck + 100000000).otherwise(ck).alias("customer_id"),
        (k % 110).alias("device_id"),
        F.concat(F.lit("203.0.113."), _s(k % 256)).alias("ip"),
        _iso("o_orderdate").alias("timestamp"),
        F.when(k % 3 == 0, F.array(F.lit("velocity_alert"))).otherwise(F.array().cast("array<string>"))
        .alias("flags"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    ck = F.col("c_custkey")
    return c.select(
        ck.alias("customer_id"),
        F.when(ck % 3 == 0, "FULL").when(ck % 3 == 1, "MIN").otherwise("NONE").alias("kyc_level"),
        F.col("c_mktsegment").alias("risk_segment"),
        ((ck % 100) / 10.0).alias("tenure_years"),
        F.concat(F.lit("user"), _s(ck), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("+1-555-"), F.lpad(_s(ck % 10000), 4, "0")).alias("phone"),
        _s(F.col("c_nationkey")).alias("home_country"),
        (F.col("c_acctbal") > 9000).alias("vip"),
        (ck % 3650).alias("account_age_days"),
        F.abs(F.col("c_acctbal") * 10).cast("long").alias("avg_monthly_spend"),
        (ck % 4).alias("chargeback_count_12m"),
        # Some keys stand there twice; the row that sorts first counts.
        F.explode(F.when(ck % 20 == 0, F.array(F.lit(0), F.lit(1))).when(ck % 10 == 0, F.array(F.lit(0), F.lit(2)))
                  .otherwise(F.array(F.lit(0)))).alias("__twin"),
    ).withColumns({
        "kyc_level": F.when(F.col("__twin") == 1, "A-TWIN").when(F.col("__twin") == 2, "Z-TWIN").otherwise(F.col("kyc_level")),
        "home_country": F.when(F.col("__twin") > 0, "XX").otherwise(F.col("home_country")),
    }).drop("__twin")


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal")
    sk = F.col("s_suppkey")
    return s.select(
        sk.alias("device_id"),
        F.when(F.col("s_acctbal") > 5000, "low").otherwise("high").alias("reputation"),
        F.when(sk % 7 == 0, F.lit(None)).otherwise(F.col("s_acctbal") > 2000).alias("seen_before"),
        (sk % 11 == 0).alias("rooted"),
        (sk % 500).alias("distance_km_from_home"),
        F.concat(F.lit("8."), _s(sk % 10), F.lit(".1")).alias("app_version"),
        F.explode(F.when(sk % 8 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__twin"),
    ).withColumns({
        "reputation": F.when(F.col("__twin") == 1, "bad").otherwise(F.col("reputation")),
        "seen_before": F.when(F.col("__twin") == 1, F.lit(True)).otherwise(F.col("seen_before")),
    }).drop("__twin")


def case_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model completions per payment case: steps triage, model, investigator."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey")
    k = F.col("o_orderkey")
    k12 = k % 12
    case = F.concat(F.lit("PAY-"), _s(k))
    score = F.lit(None).cast("string")
    for r, t in PAYMENT_SCORE_TEXTS.items():
        score = F.when(k12 == r, F.lit(t)).otherwise(score)
    steps = F.array(
        F.struct(F.lit("triage").alias("step"),
                 F.concat(F.lit("Payment "), case, F.lit(" shows unusual amount for merchant.")).alias("text")),
        F.struct(F.lit("model").alias("step"), score.alias("text")),
        F.struct(F.lit("investigator").alias("step"),
                 F.concat(F.lit("Investigation for "), case, F.lit(": review customer history.")).alias("text")),
    )
    rows = o.filter(k12 != 0).select("o_orderkey", case.alias("case_id"), F.inline(steps))
    # Every 19th case has a second investigator row; the greater text counts.
    twice = (F.col("o_orderkey") % 19 == 0) & (F.col("step") == "investigator")
    texts = F.when(twice, F.array(F.col("text"), F.lit("Zero findings on review."))).otherwise(F.array(F.col("text")))
    return rows.select("case_id", "step", F.explode(texts).alias("text"))


PAYMENTS_SQL = """
SELECT
  'PAY-' || CAST(o_orderkey AS VARCHAR) AS txn_id,
  o_totalprice / 25.0::DOUBLE AS amount,
  'INR' AS currency,
  'MERCHANT-' || CAST(o_orderkey % 200 AS VARCHAR) AS merchant,
  o_orderkey % 1000 + 5000 AS mcc,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'ecom'
       WHEN o_orderpriority = '5-LOW' THEN 'ECOM' ELSE 'pos' END AS channel,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 25 AS VARCHAR)
       ELSE CAST(c_nationkey AS VARCHAR) END AS country,
  CASE WHEN o_orderkey % 50 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS customer_id,
  o_orderkey % 110 AS device_id,
  '203.0.113.' || CAST(o_orderkey % 256 AS VARCHAR) AS ip,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp",
  CASE WHEN o_orderkey % 3 = 0 THEN ['velocity_alert'] ELSE []::VARCHAR[] END AS flags
FROM orders JOIN customer ON o_custkey = c_custkey
"""

CUSTOMERS_SQL = """
SELECT
  c_custkey AS customer_id,
  CASE c_custkey % 3 WHEN 0 THEN 'FULL' WHEN 1 THEN 'MIN' ELSE 'NONE' END AS kyc_level,
  c_mktsegment AS risk_segment,
  (c_custkey % 100) / 10.0::DOUBLE AS tenure_years,
  'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
  '+1-555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone,
  CAST(c_nationkey AS VARCHAR) AS home_country,
  c_acctbal > 9000 AS vip,
  c_custkey % 3650 AS account_age_days,
  CAST(trunc(abs(c_acctbal * 10)) AS BIGINT) AS avg_monthly_spend,
  c_custkey % 4 AS chargeback_count_12m
FROM customer
"""
CUSTOMERS_SQL = f"""
SELECT * FROM ({CUSTOMERS_SQL}) UNION ALL
SELECT * REPLACE (CASE WHEN customer_id % 20 = 0 THEN 'A-TWIN' ELSE 'Z-TWIN' END AS kyc_level, 'XX' AS home_country)
FROM ({CUSTOMERS_SQL}) WHERE customer_id % 10 = 0
"""

DEVICES_SQL = """
SELECT
  s_suppkey AS device_id,
  CASE WHEN s_acctbal > 5000 THEN 'low' ELSE 'high' END AS reputation,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal > 2000 END AS seen_before,
  s_suppkey % 11 = 0 AS rooted,
  s_suppkey % 500 AS distance_km_from_home,
  '8.' || CAST(s_suppkey % 10 AS VARCHAR) || '.1' AS app_version
FROM supplier
"""
DEVICES_SQL = f"""
SELECT * FROM ({DEVICES_SQL}) UNION ALL
SELECT * REPLACE ('bad' AS reputation, TRUE AS seen_before) FROM ({DEVICES_SQL}) WHERE device_id % 8 = 0
"""

CASE_COMPLETIONS_SQL = (
    "SELECT 'PAY-' || CAST(o_orderkey AS VARCHAR) AS case_id, "
    "'Payment PAY-' || CAST(o_orderkey AS VARCHAR) || ' shows unusual amount for merchant.' AS triage_summary, "
    "CASE o_orderkey % 12 "
    + " ".join(f"WHEN {r} THEN {_sql_str(t)}" for r, t in PAYMENT_SCORE_TEXTS.items())
    + " END AS score_text, "
    "CASE WHEN o_orderkey % 19 = 0 THEN 'Zero findings on review.' ELSE "
    "'Investigation for PAY-' || CAST(o_orderkey AS VARCHAR) || ': review customer history.' END AS investigation_notes "
    "FROM orders WHERE o_orderkey % 12 <> 0"
)

# --------------------------------------------------------------- events --
def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily per-customer event counters (the feature job's input shape).

    One hash aggregate with map-side partial counts; a customer holding a
    third of all events still shrinks to one row per day before the shuffle.
    """
    e = read_table(spark, sf_dir, "events", "user_id", "ts", "event_type")
    return (e.groupBy(F.col("user_id").alias("customer_id"),
                      F.to_date("ts").alias("business_date"))
            .agg(F.count(F.lit(1)).cast("double").alias("event_cnt"),
                 F.count_if(F.col("event_type") == "click").cast("double").alias("event_type_login_cnt"),
                 F.count_if(F.col("event_type") == "purchase").cast("double").alias("event_type_payment_cnt")))


DAILY_EVENTS_SQL = """
SELECT user_id AS customer_id, CAST(ts AS DATE) AS business_date,
       CAST(count(*) AS DOUBLE) AS event_cnt,
       CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS event_type_login_cnt,
       CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS event_type_payment_cnt
FROM events GROUP BY ALL
"""
