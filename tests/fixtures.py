"""Golden inputs from the reference's own examples (FIXTURES.md)."""

BASE = {
    "timestamp": "2025-08-19T14:30:00Z", "currency": "USD", "destination_bank_code": None,
    "ip_address": None, "origin_country": "US", "beneficiary_account_tenure_days": 10,
}

TRANSFERS = [
    dict(BASE, txn_id="TX-3001", amount=12500.0, origin_account_id="ACC-001", destination_account_id="EXT-ABC-1234",
         transfer_type="EXTERNAL", destination_country="RU", is_international=True, channel="APP",
         device_id="dev-123", customer_age=19, origin_account_tenure_days=20, new_beneficiary=True,
         payee_first_seen_days=0, outbound_velocity_1h_count=7, outbound_velocity_24h_count=18,
         previous_fraud_reports=1, memo="investment opportunity refund"),
    dict(BASE, txn_id="TX-3002", amount=350.0, origin_account_id="ACC-002", destination_account_id="ACC-003",
         transfer_type="INTERNAL", destination_country="US", is_international=False, channel="WEB",
         device_id="dev-known-1", customer_age=42, origin_account_tenure_days=900, new_beneficiary=False,
         payee_first_seen_days=365, outbound_velocity_1h_count=1, outbound_velocity_24h_count=2,
         previous_fraud_reports=0, memo="rent split"),
    dict(BASE, txn_id="TX-3003", amount=5200.0, origin_account_id="ACC-004", destination_account_id="ACC-005",
         transfer_type="INTERNAL", destination_country="US", is_international=False, channel="APP",
         device_id="dev-new-xyz", customer_age=33, origin_account_tenure_days=45, new_beneficiary=True,
         payee_first_seen_days=0, outbound_velocity_1h_count=2, outbound_velocity_24h_count=3,
         previous_fraud_reports=0, memo="gift"),
    dict(BASE, txn_id="TX-3004", amount=900.0, origin_account_id="ACC-006", destination_account_id="EXT-DEF-5678",
         transfer_type="EXTERNAL", destination_country="IN", is_international=False, channel="WEB",
         device_id="dev-known-2", customer_age=29, origin_account_tenure_days=800, new_beneficiary=False,
         payee_first_seen_days=200, outbound_velocity_1h_count=1, outbound_velocity_24h_count=2,
         previous_fraud_reports=0, memo="invoice 1045"),
    dict(BASE, txn_id="TX-3005", amount=2500.0, origin_account_id="ACC-007", destination_account_id="EXT-GHI-1111",
         transfer_type="EXTERNAL", destination_country="PK", is_international=True, channel="APP",
         device_id=None, customer_age=21, origin_account_tenure_days=5, new_beneficiary=True,
         payee_first_seen_days=0, outbound_velocity_1h_count=6, outbound_velocity_24h_count=16,
         previous_fraud_reports=0, memo="loan repayment"),
]

# txn_id -> (flags, rule_score, ml_score, decision score, verdict, sla)
EXPECTED = {
    "TX-3001": ("R1_high_amount_external,R2_new_beneficiary,R3_geo_high,R4_new_device,R5_velocity_out_1h,"
                "R6_velocity_out_24h,R7_prior_fraud,R8_new_account_large_transfer,R9_suspicious_memo",
                1.0, 1.0, 1.0, "DECLINE", "P1"),
    "TX-3002": ("", 0.0, 0.025, 0.015, "APPROVE", "P3"),
    "TX-3003": ("R1_high_amount_internal,R2_new_beneficiary,R4_new_device", 0.333, 0.564, 0.472, "REVIEW", "P2"),
    "TX-3004": ("", 0.0, 0.031, 0.019, "APPROVE", "P3"),
    "TX-3005": ("R2_new_beneficiary,R3_geo_high,R4_new_device,R5_velocity_out_1h,R6_velocity_out_24h,"
                "R8_new_account_large_transfer,R9_suspicious_memo", 0.778, 0.774, 0.776, "DECLINE", "P1"),
}


def transfer_df(spark, records):
    from casekit.schemas import TRANSFER, TRANSFER_COLUMNS
    rows = [tuple(r.get(c) for c in TRANSFER_COLUMNS) for r in records]
    return spark.createDataFrame(rows, TRANSFER)
