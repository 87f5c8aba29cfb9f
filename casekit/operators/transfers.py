"""Transfer risk scoring as DataFrame transforms.

Each step is a ``DataFrame -> DataFrame`` function for ``df.transform``.
Steps only add columns; the chain collapses into one Catalyst projection
(whole-stage codegen, no shuffle).  The only shuffle in the flow is the
optional completions join in :func:`attach_notes`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casekit.functions.parse import PY_FLOAT_TOKEN, last_prefixed_line
from casekit.functions.text import contains_any, empty_to, fixed, py_round
from casekit.operators.rules import Rule, apply_rules, compact
from casekit.schemas import CORRUPT_COLUMN, TRANSFER_COLUMNS, TRANSFER_FIELDS

# ---------------------------------------------------------------------------
# These must stay equal to the reference for equal results.
# ---------------------------------------------------------------------------
HIGH_RISK_COUNTRIES = ["RU", "NG", "VN", "PK"]
RISKY_MEMO_KEYWORDS = ["crypto", "investment", "loan", "refund", "gift cards"]
EXTERNAL_TYPE = "EXTERNAL"
RULE_COUNT_FOR_FULL_SCORE = 9.0
RULE_TEXTS = [
    ("R1_high_amount_external", "High amount external transfer >= 10000"),
    ("R1_high_amount_internal", "High amount internal transfer >= 5000"),
    ("R2_new_beneficiary", "First‑time or very new beneficiary"),
    ("R3_geo_high", "High geolocation risk destination"),
    ("R4_new_device", "New or unknown device for this account"),
    ("R5_velocity_out_1h", "Outbound velocity 1h >= 5"),
    ("R6_velocity_out_24h", "Outbound velocity 24h >= 15"),
    ("R7_prior_fraud", "Customer has prior fraud reports"),
    ("R8_new_account_large_transfer", "New account (<30d) making large transfer >= 2000"),
    ("R9_suspicious_memo", "Suspicious memo keywords detected"),
]
VERDICTS = ["APPROVE", "REVIEW", "DECLINE"]
SLA_BY_VERDICT = {"DECLINE": "P1", "REVIEW": "P2", "APPROVE": "P3"}
RECOMMENDATION_PREFIX = "RECOMMENDATION:"
INVESTIGATOR_SYSTEM_PROMPT = (
    "You are a senior fraud investigator for a bank.\n"
    "Given transfer context, analyze risk drivers succinctly.\n"
    "Output 3 short bullet points and end with a single line:\n"
    "RECOMMENDATION: APPROVE|REVIEW|DECLINE\n"
    "Keep it objective and reference concrete factors."
)
LARGE_EXTERNAL, LARGE_INTERNAL = 10000, 5000
MANY_OUT_1H, MANY_OUT_24H = 5, 15
NEW_ACCOUNT_DAYS, NEW_ACCOUNT_AMOUNT = 30, 2000
ML_FULL_AMOUNT_EXTERNAL, ML_FULL_AMOUNT_INTERNAL = 15000.0, 8000.0
ML_FULL_OUT_1H, ML_FULL_PRIOR_FRAUD = 10.0, 3.0
ML_WEIGHTS = {"amount": 0.35, "geo": 0.15, "beneficiary": 0.15, "device": 0.10, "velocity": 0.10,
              "prior_fraud": 0.05, "new_account": 0.05, "memo": 0.05, "rules": 0.20}
COMPOSITE_ML, COMPOSITE_RULES = 0.6, 0.4
DECLINE_FROM, REVIEW_FROM = 0.75, 0.45
FALLBACK_DRIVERS = {
    "DECLINE": "Key drivers: high rules and/or ML score",
    "REVIEW": "Key drivers: moderate risk indicators",
    "APPROVE": "Low combined signals",
}
# ---------------------------------------------------------------------------

DEFAULT_NOTES_HEADER = "Investigator model unavailable; using heuristic investigator."

ENRICHMENT_COLUMNS = [
    "is_external", "is_new_beneficiary", "device_known", "geo_risk", "memo_risky",
    "out_1h", "out_24h", "prior_fraud", "is_young_customer", "origin_tenure_days",
    "beneficiary_tenure_days", "dest_country",
]

_BOOL_TRUE = ["true", "t", "yes", "y", "on", "1"]
_BOOL_FALSE = ["false", "f", "no", "n", "off", "0"]
_INT_TEXT = r"^\s*[+-]?\d+(\.0*)?\s*$"


# --------------------------------------------------------------------- P1 --
def _typed_field(df: DataFrame, name: str, dtype: T.DataType) -> tuple[Column, Column]:
    """(typed value, raw-present flag) for one field of ``df``."""
    if name not in df.columns:
        return F.lit(None).cast(dtype), F.lit(False)
    raw = F.col(name)
    if not isinstance(df.schema[name].dataType, T.StringType):
        return F.expr(f"try_cast(`{name}` as {dtype.simpleString()})"), raw.isNotNull()
    text = F.trim(raw)
    if isinstance(dtype, T.DoubleType):
        typed = F.when(text.rlike(PY_FLOAT_TOKEN), F.regexp_replace(text, "_", "").cast("double"))
    elif isinstance(dtype, T.IntegerType):
        typed = F.when(text.rlike(_INT_TEXT),
                       F.expr(f"try_cast(try_cast(trim(`{name}`) as double) as int)"))
    elif isinstance(dtype, T.BooleanType):
        low = F.lower(text)
        typed = F.when(low.isin(_BOOL_TRUE), F.lit(True)).when(low.isin(_BOOL_FALSE), F.lit(False))
    else:
        typed = raw
    return typed, raw.isNotNull()


def validate_transfers(df: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Split raw transfer rows into (valid typed rows, rejected rows).

    Required fields must be present, and every field that is present castable;
    NaN amounts are rejected.  Unknown extra columns are
    dropped except those named in ``keep``.  Rejected rows carry the raw
    values and ``reject_reasons`` (array<string>).  Both outputs come from one
    lazily shared projection; nothing is collected.
    """
    keep = [c for c in (keep or []) if c in df.columns]
    typed, checks, hard = {}, [], []
    for name, dtype, required in TRANSFER_FIELDS:
        value, present = _typed_field(df, name, dtype)
        typed[name] = value
        if required:
            checks.append(F.when(~present, F.lit(f"{name}: missing"))
                          .when(value.isNull(), F.lit(f"{name}: not a valid {dtype.simpleString()}")))
            hard.append(value.isNull())
        else:
            wrong = present & value.isNull()
            checks.append(F.when(wrong, F.lit(f"{name}: not a valid {dtype.simpleString()}")))
            hard.append(wrong)
    nan_amount = F.isnan(typed["amount"])
    checks.append(F.when(nan_amount, F.lit("amount: NaN")))
    hard.append(nan_amount)
    corrupt = F.col(CORRUPT_COLUMN).isNotNull() if CORRUPT_COLUMN in df.columns else F.lit(False)
    reasons = F.when(corrupt, F.array(F.lit("malformed record"))).otherwise(compact(checks))
    is_hard = corrupt
    for h in hard:
        is_hard = is_hard | F.coalesce(h, F.lit(False))
    staged = df.select(
        *keep,
        *[F.col(n).alias(f"__raw_{n}") if n in df.columns else F.lit(None).cast("string").alias(f"__raw_{n}")
          for n in TRANSFER_COLUMNS],
        *[v.alias(n) for n, v in typed.items()],
        reasons.alias("__reasons"),
        is_hard.alias("__hard"),
    )
    valid = staged.filter(~F.col("__hard")).select(*keep, *TRANSFER_COLUMNS)
    rejected = staged.filter(F.col("__hard")).select(
        *keep,
        *[F.col(f"__raw_{n}").cast("string").alias(n) for n in TRANSFER_COLUMNS],
        F.col("__reasons").alias("reject_reasons"),
    )
    return valid, rejected


# --------------------------------------------------------------------- P2 --
def enrich_transfers(df: DataFrame) -> DataFrame:
    """Add the enrichment columns (flat; see :data:`ENRICHMENT_COLUMNS`)."""
    tenure = F.col("origin_account_tenure_days")
    age = F.col("customer_age")
    dest = F.upper(F.coalesce(F.col("destination_country"), F.lit("")))
    return df.withColumns({
        "is_external": F.upper(F.coalesce(F.col("transfer_type"), F.lit(""))) == EXTERNAL_TYPE,
        "is_new_beneficiary": F.coalesce(F.col("new_beneficiary"), F.lit(False))
        | F.coalesce(F.col("payee_first_seen_days") <= 0, F.lit(False)),
        "device_known": (F.coalesce(F.col("device_id"), F.lit("")) != "")
        & F.coalesce(tenure > 60, F.lit(False)),
        "geo_risk": F.when(dest.isin(HIGH_RISK_COUNTRIES), F.lit("HIGH")).otherwise(F.lit("LOW")),
        "memo_risky": contains_any(F.lower(F.coalesce(F.col("memo"), F.lit(""))), RISKY_MEMO_KEYWORDS),
        "out_1h": F.coalesce(F.col("outbound_velocity_1h_count"), F.lit(0)),
        "out_24h": F.coalesce(F.col("outbound_velocity_24h_count"), F.lit(0)),
        "prior_fraud": F.coalesce(F.col("previous_fraud_reports"), F.lit(0)),
        "is_young_customer": F.coalesce((age != 0) & (age < 21), F.lit(False)),
        "origin_tenure_days": F.coalesce(tenure, F.lit(0)),
        "beneficiary_tenure_days": F.coalesce(F.col("beneficiary_account_tenure_days"), F.lit(0)),
        "dest_country": dest,
    })


def enrichment_struct() -> Column:
    """The enrichment as one nested struct (report / context layout)."""
    return F.struct(
        F.col("is_external"), F.col("is_new_beneficiary"), F.col("device_known"),
        F.col("geo_risk"), F.col("memo_risky"),
        F.struct(F.col("out_1h"), F.col("out_24h")).alias("velocity"),
        F.col("prior_fraud"), F.col("is_young_customer"), F.col("origin_tenure_days"),
        F.col("beneficiary_tenure_days"), F.col("dest_country").alias("destination_country"),
    )


# ----------------------------------------------------------------- R1-R3 --
def transfer_rules() -> list[Rule]:
    """The ordered transfer rule set over enriched columns."""
    amount = F.col("amount")
    ext = F.col("is_external")
    preds = [
        ext & (amount >= LARGE_EXTERNAL),
        ~ext & (amount >= LARGE_INTERNAL),
        F.col("is_new_beneficiary"),
        F.col("geo_risk") == "HIGH",
        ~F.col("device_known"),
        F.col("out_1h") >= MANY_OUT_1H,
        F.col("out_24h") >= MANY_OUT_24H,
        F.col("prior_fraud") > 0,
        (F.col("origin_tenure_days") < NEW_ACCOUNT_DAYS) & (amount >= NEW_ACCOUNT_AMOUNT),
        F.col("memo_risky"),
    ]
    return [Rule(name, reason, p) for (name, reason), p in zip(RULE_TEXTS, preds)]


def score_rules(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Flags, reasons, hit count and ``rule_score = round(min(1, n/9), 3)``."""
    out = apply_rules(df, rules or transfer_rules())
    return out.withColumn(
        "rule_score", py_round(F.least(F.lit(1.0), F.col("n_flags") / RULE_COUNT_FOR_FULL_SCORE), 3))


# --------------------------------------------------------------------- R4 --
def ml_risk(df: DataFrame) -> DataFrame:
    """Weighted heuristic score clamped to [0, 1], rounded to 3 places."""
    full = F.when(F.col("is_external"), F.lit(ML_FULL_AMOUNT_EXTERNAL)).otherwise(F.lit(ML_FULL_AMOUNT_INTERNAL))
    w = ML_WEIGHTS

    def share(c: Column, weight: float) -> Column:
        return F.least(c, F.lit(1.0)) * weight

    def hit(c: Column, weight: float) -> Column:
        return F.when(c, F.lit(weight)).otherwise(F.lit(0.0))

    terms = [
        share(F.col("amount") / full, w["amount"]),
        hit(F.col("geo_risk") == "HIGH", w["geo"]),
        hit(F.col("is_new_beneficiary"), w["beneficiary"]),
        hit(~F.col("device_known"), w["device"]),
        share(F.col("out_1h") / ML_FULL_OUT_1H, w["velocity"]),
        share(F.col("prior_fraud") / ML_FULL_PRIOR_FRAUD, w["prior_fraud"]),
        hit(F.col("origin_tenure_days") < NEW_ACCOUNT_DAYS, w["new_account"]),
        hit(F.col("memo_risky"), w["memo"]),
        F.col("rule_score") * w["rules"],
    ]
    total = terms[0]
    for t in terms[1:]:
        total = total + t  # left to right, as the sum is written
    return df.withColumn("ml_score", py_round(F.greatest(F.lit(0.0), F.least(total, F.lit(1.0))), 3))


# --------------------------------------------------------------- R5 / S6 --
def fallback_notes(header: str = DEFAULT_NOTES_HEADER) -> Column:
    """Deterministic investigator notes from the ML and rule scores."""
    ml, rule = F.col("ml_score"), F.col("rule_score")
    level = (F.when((ml >= DECLINE_FROM) | (rule >= DECLINE_FROM), F.lit("DECLINE"))
             .when((ml >= REVIEW_FROM) | (rule >= REVIEW_FROM), F.lit("REVIEW"))
             .otherwise(F.lit("APPROVE")))
    drivers = F.when(level == "DECLINE", F.lit(FALLBACK_DRIVERS["DECLINE"])) \
        .when(level == "REVIEW", F.lit(FALLBACK_DRIVERS["REVIEW"])) \
        .otherwise(F.lit(FALLBACK_DRIVERS["APPROVE"]))
    return F.concat_ws("\n", F.lit(header), F.concat(F.lit("ML risk score="), fixed(ml, 3)),
                       F.concat(F.lit(RECOMMENDATION_PREFIX + " "), level), drivers)


def attach_notes(df: DataFrame, completions: DataFrame | None = None,
                 step: str = "investigator", key: str = "txn_id",
                 header: str = DEFAULT_NOTES_HEADER, completion_col: str | None = None) -> DataFrame:
    """``investigator_notes``: the model completion for (case, step) when
    present, else the fallback notes; ``notes_source`` says which.
    ``completion_col`` names a column that holds the completion already.

    ``completions(case_id, step, text)`` is reduced to one row per case for
    this step (partial aggregation, so a key repeated many times is combined
    map-side) and left-joined on the case key; AQE chooses broadcast or
    sort-merge from the runtime size.
    """
    def notes(text: Column) -> dict[str, Column]:
        return {"investigator_notes": F.coalesce(text, fallback_notes(header)),
                "notes_source": F.when(text.isNotNull(), F.lit("model")).otherwise(F.lit("heuristic"))}

    if completion_col is not None:
        return df.withColumns(notes(F.col(completion_col))).drop(completion_col)
    if completions is None:
        return df.withColumns({"investigator_notes": fallback_notes(header),
                               "notes_source": F.lit("heuristic")})
    one = (completions.filter(F.col("step") == step)
           .groupBy(F.col("case_id").alias("__case"))
           .agg(F.max("text").alias("__text")))
    joined = df.join(one, df[key] == one["__case"], "left")
    return joined.withColumns(notes(F.col("__text"))).drop("__case", "__text")


# --------------------------------------------------------------------- R6 --
def decide(df: DataFrame) -> DataFrame:
    """Verdict from the investigator's last recommendation line, else from
    the composite score; reasons, SLA and rounded composite."""
    rec = last_prefixed_line("investigator_notes", RECOMMENDATION_PREFIX)
    staged = df.withColumns({
        "recommendation": rec,
        "composite": F.least(F.lit(1.0), F.col("ml_score") * COMPOSITE_ML + F.col("rule_score") * COMPOSITE_RULES),
    })
    rec, comp = F.col("recommendation"), F.col("composite")
    verdict = (F.when(rec.isin(VERDICTS), rec)
               .when(comp >= DECLINE_FROM, F.lit("DECLINE"))
               .when(comp >= REVIEW_FROM, F.lit("REVIEW"))
               .otherwise(F.lit("APPROVE")))
    out = staged.withColumn("verdict", verdict)
    v = F.col("verdict")
    return out.withColumns({
        "decision_reasons": F.concat(
            F.col("reasons"),
            F.array(F.concat(F.lit("ML score="), fixed("ml_score", 2)),
                    F.concat(F.lit("Rule score="), fixed("rule_score", 2))),
            F.when(rec != "", F.array(F.concat(F.lit("Investigator suggested "), rec)))
            .otherwise(F.array().cast("array<string>")),
        ),
        "sla_priority": F.when(v == "DECLINE", F.lit(SLA_BY_VERDICT["DECLINE"]))
        .when(v == "REVIEW", F.lit(SLA_BY_VERDICT["REVIEW"]))
        .otherwise(F.lit(SLA_BY_VERDICT["APPROVE"])),
        "decision_score": py_round(comp, 3),
    })


# ----------------------------------------------------------------- R7/P7 --
def narrative() -> Column:
    return F.concat(
        F.lit("Transfer "), F.col("txn_id"), F.lit(" "), fixed("amount", 2), F.lit(" "),
        F.col("currency"), F.lit(" "), F.col("transfer_type"),
        F.lit(" from "), F.col("origin_account_id"), F.lit(" to "), F.col("destination_account_id"),
        F.lit(". Dest "), empty_to("destination_country", "N/A"),
        F.lit(". ML="), fixed("ml_score", 2), F.lit(", Rules="), fixed("rule_score", 2),
        F.lit(", Verdict="), F.col("verdict"), F.lit("."),
    )


def make_reports(df: DataFrame, run_id: str = "", created_at: str | None = None) -> DataFrame:
    """Add ``case_id``, ``created_at``, ``summary`` and the nested ``report``.

    ``case_id`` = sha256(txn_id|run_id) so reruns are reproducible;
    ``created_at`` is one instant per query (``current_timestamp`` is
    evaluated once per plan) unless given.
    """
    created = (F.lit(created_at) if created_at is not None else
               F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
    out = df.withColumns({
        "case_id": F.sha2(F.concat_ws("|", F.col("txn_id"), F.lit(run_id)), 256),
        "created_at": created,
        "summary": narrative(),
    })
    report = F.struct(
        F.col("case_id"), F.col("txn_id"), F.col("created_at"),
        enrichment_struct().alias("enrichment"),
        F.struct(F.col("flags"), F.col("reasons"), F.col("rule_score")).alias("rules"),
        F.col("ml_score"), F.col("investigator_notes"),
        F.struct(F.col("verdict"), F.col("decision_reasons").alias("reasons"),
                 F.col("decision_score").alias("score"), F.col("sla_priority")).alias("decision"),
        F.col("summary"),
    )
    return out.withColumn("report", report)


def report_json(df: DataFrame) -> DataFrame:
    """``(case_id, txn_id, report_json)`` -- the case report sink format."""
    return df.select("case_id", "txn_id",
                     F.to_json(F.col("report"), {"ignoreNullFields": "false"}).alias("report_json"))


# ----------------------------------------------------------------- P4/P5 --
def investigation_context() -> Column:
    """Compact JSON of transfer, enrichment, flags, reasons and scores
    (nulls kept)."""
    ctx = F.struct(
        F.struct(*[F.col(c) for c in TRANSFER_COLUMNS]).alias("transfer"),
        enrichment_struct().alias("enrichment"),
        F.col("flags").alias("rule_flags"),
        F.col("reasons").alias("rule_reasons"),
        F.col("rule_score"),
        F.col("ml_score"),
    )
    return F.to_json(ctx, {"ignoreNullFields": "false"})


def investigator_prompts(df: DataFrame, step: str = "investigator") -> DataFrame:
    """Prompts table ``(case_id, step, system, prompt)`` for the model.

    Needs enriched, rule-scored and ML-scored rows; ``case_id`` is the
    transfer id, the key completions come back with.
    """
    return df.select(
        F.col("txn_id").alias("case_id"),
        F.lit(step).alias("step"),
        F.lit(INVESTIGATOR_SYSTEM_PROMPT).alias("system"),
        F.concat(F.lit("Context JSON:\n"), investigation_context()).alias("prompt"),
    )
