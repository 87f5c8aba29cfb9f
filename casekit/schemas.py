"""Declared schemas for every record the library reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()

# Transfer record: (name, type, required).  Required fields reject the row
# when null or not castable; optional ones become null.
TRANSFER_FIELDS: list[tuple[str, T.DataType, bool]] = [
    ("txn_id", S, True),
    ("timestamp", S, True),
    ("amount", D, True),
    ("currency", S, True),
    ("origin_account_id", S, True),
    ("destination_account_id", S, True),
    ("transfer_type", S, True),
    ("destination_bank_code", S, False),
    ("destination_country", S, False),
    ("is_international", B, False),
    ("channel", S, True),
    ("device_id", S, False),
    ("ip_address", S, False),
    ("origin_country", S, False),
    ("customer_age", I, False),
    ("origin_account_tenure_days", I, False),
    ("new_beneficiary", B, False),
    ("payee_first_seen_days", I, False),
    ("beneficiary_account_tenure_days", I, False),
    ("outbound_velocity_1h_count", I, False),
    ("outbound_velocity_24h_count", I, False),
    ("previous_fraud_reports", I, False),
    ("memo", S, False),
]

TRANSFER_COLUMNS = [name for name, _, _ in TRANSFER_FIELDS]

TRANSFER = T.StructType([T.StructField(n, t, True) for n, t, _ in TRANSFER_FIELDS])

# Raw text form: every field as string, plus the parser's corrupt-record slot,
# so malformed JSON and bad field values can be told apart.
CORRUPT_COLUMN = "_corrupt_record"
TRANSFER_TEXT = T.StructType(
    [T.StructField(n, S, True) for n, _, _ in TRANSFER_FIELDS]
    + [T.StructField(CORRUPT_COLUMN, S, True)]
)

PAYMENT = T.StructType([
    T.StructField("txn_id", S), T.StructField("amount", D), T.StructField("currency", S),
    T.StructField("merchant", S), T.StructField("mcc", L), T.StructField("channel", S),
    T.StructField("country", S), T.StructField("customer_id", L), T.StructField("device_id", L),
    T.StructField("ip", S), T.StructField("timestamp", S),
    T.StructField("flags", T.ArrayType(S)),
])

CUSTOMER = T.StructType([
    T.StructField("customer_id", L), T.StructField("kyc_level", S), T.StructField("risk_segment", S),
    T.StructField("tenure_years", D), T.StructField("email", S), T.StructField("phone", S),
    T.StructField("home_country", S), T.StructField("vip", B), T.StructField("account_age_days", L),
    T.StructField("avg_monthly_spend", L), T.StructField("chargeback_count_12m", L),
])

DEVICE = T.StructType([
    T.StructField("device_id", L), T.StructField("reputation", S), T.StructField("seen_before", B),
    T.StructField("rooted", B), T.StructField("distance_km_from_home", L),
    T.StructField("app_version", S),
])
