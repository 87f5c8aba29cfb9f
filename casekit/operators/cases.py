"""Payment case batch as joins and projections.

The per-case loop of lookups becomes one plan: payments left-join the
deduplicated customer and device dimensions, and a single pivoted
completions table.  Every per-case step after that is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casekit.functions.parse import first_token, leading_float
from casekit.operators.rules import Rule, apply_rules

# ---------------------------------------------------------------------------
# These must stay equal to the reference for equal results.
# ---------------------------------------------------------------------------
RULE_NAMES = ["RULE:HIGH_AMOUNT_ECOM", "RULE:NEW_DEVICE", "RULE:GEO_MISMATCH"]
HIGH_AMOUNT = 15000
ECOM_CHANNEL = "ecom"
DEFAULT_MODEL_SCORE = 0.5
DENY_ABOVE = 0.75
ESCALATE_FROM = 0.45
AUDIT_EVENTS = ["triage_complete", "enrichment_complete", "rules_complete",
                "model_scored", "investigation_complete", "decision_ready"]
TRIAGE_PROMPT = "Summarize suspicious aspects of payment "
MODEL_PROMPT = "Estimate fraud probability (0-1) for "
INVESTIGATOR_PROMPT = "Summarize investigation for "
SYSTEM_TEXT = "You are a bank fraud investigation assistant. Be precise, cautious, and explain reasoning succinctly."
STEP_TEMPERATURE = {"triage": 0.2, "model": 0.0, "investigator": 0.2}
# ---------------------------------------------------------------------------

PAYMENT_COLUMNS = ["txn_id", "amount", "currency", "merchant", "mcc", "channel", "country",
                   "customer_id", "device_id", "ip", "timestamp", "flags"]


# ------------------------------------------------------------- J1 / W4 --
def first_per_key(df: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """One row per ``key``: the row with the smallest ``order`` tuple
    (default: all other columns in schema order).

    A ``min`` over a struct is an ordinary aggregate, so it is combined
    map-side before the shuffle: a key repeated in a third of all rows costs
    one partial row per task, not one huge sorted group.
    """
    others = [c for c in df.columns if c != key]
    order = order or others
    rest = [c for c in others if c not in order]
    best = F.min(F.struct(*[F.col(c) for c in order + rest])).alias("__best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"__best.{c}").alias(c) for c in order + rest])


def lookup(left: DataFrame, right: DataFrame, key: str, found: str) -> DataFrame:
    """Left equi-join to a dimension deduplicated on ``key``; ``found`` tells
    whether the key resolved (dimension columns may be null themselves).

    No broadcast hint: AQE broadcasts the side only when its runtime size is
    under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and otherwise
    keeps a sort-merge join (splitting skewed partitions).
    """
    dim = first_per_key(right, key).withColumn(found, F.lit(True))
    return left.join(dim, key, "left").withColumn(found, F.coalesce(F.col(found), F.lit(False)))


def enrich_cases(payments: DataFrame, customers: DataFrame, devices: DataFrame) -> DataFrame:
    """Payments with their customer and device (J1, J2)."""
    return (payments.transform(lookup, customers, "customer_id", "customer_found")
                    .transform(lookup, devices, "device_id", "device_found"))


def case_errors(df: DataFrame) -> DataFrame:
    """Cases whose customer or device does not resolve (J3)."""
    missing = F.concat_ws(",", F.when(~F.col("customer_found"), F.lit("customer")),
                          F.when(~F.col("device_found"), F.lit("device")))
    return (df.filter(~F.col("customer_found") | ~F.col("device_found"))
              .select("txn_id", "customer_id", "device_id", missing.alias("missing")))


def resolved(df: DataFrame) -> DataFrame:
    return df.filter(F.col("customer_found") & F.col("device_found"))


# ------------------------------------------------------------------ R8 --
def case_rules() -> list[Rule]:
    return [
        Rule(RULE_NAMES[0], RULE_NAMES[0],
             (F.col("amount") > HIGH_AMOUNT) & (F.col("channel") == ECOM_CHANNEL)),
        Rule(RULE_NAMES[1], RULE_NAMES[1], ~F.coalesce(F.col("seen_before"), F.lit(False))),
        # Python '!=' on possibly-missing values: None != 'X' is True, None != None False.
        Rule(RULE_NAMES[2], RULE_NAMES[2], ~F.col("country").eqNullSafe(F.col("home_country"))),
    ]


def score_case_rules(df: DataFrame) -> DataFrame:
    out = apply_rules(df, case_rules(), flags="rule_flags", reasons="__r", count="n_rule_hits",
                      hit_names="rule_hits")
    return out.drop("__r", "rule_flags")


# -------------------------------------------------------- S6 / R9 / F10 --
def attach_case_completions(df: DataFrame, completions: DataFrame | None,
                            steps=("triage", "model", "investigator")) -> DataFrame:
    """Pivot ``completions(case_id, step, text)`` to one row per case and
    left-join it: ``triage_summary``, ``score_text``, ``investigation_notes``.

    The pivot is an aggregate on the case key (partial, map-side); the join
    then reuses its hash partitioning on that key.
    """
    names = {"triage": "triage_summary", "model": "score_text", "investigator": "investigation_notes"}
    if completions is None:
        return df.withColumns({names[s]: F.lit(None).cast("string") for s in steps})
    wide = (completions.filter(F.col("step").isin(list(steps)))
            .groupBy(F.col("case_id").alias("txn_id"))
            .agg(*[F.max(F.when(F.col("step") == s, F.col("text"))).alias(names[s]) for s in steps]))
    return df.join(wide, "txn_id", "left")


def parse_model_score(df: DataFrame) -> DataFrame:
    """``model_score`` = first token of the completion as a float, else 0.5."""
    s = F.col("model_score")
    return (df.withColumns({"score_token": first_token("score_text"),
                            "model_score": leading_float("score_text", DEFAULT_MODEL_SCORE)})
              .withColumn("score_in_range", ~F.isnan(s) & (s >= 0.0) & (s <= 1.0)))


# ----------------------------------------------------------------- R10 --
def decide_cases(df: DataFrame) -> DataFrame:
    s = F.col("model_score")
    # Spark orders NaN above every number; Python compares it false.
    decision = (F.when(F.isnan(s), F.lit("approve"))
                .when(s > DENY_ABOVE, F.lit("deny"))
                .when(s >= ESCALATE_FROM, F.lit("escalate"))
                .otherwise(F.lit("approve")))
    return df.withColumn("decision", decision)


# ------------------------------------------------------------------ U1 --
def json_number(c: Column) -> Column:
    """Doubles for JSON payloads: NaN/inf have no JSON form -> null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast("double")).otherwise(c)


def py_float_text(c: Column) -> Column:
    """``str(x)`` of a Python float for the values a score takes."""
    return F.when(F.isnan(c), F.lit("nan")).otherwise(c.cast("string"))


def with_audit(df: DataFrame, customer_cols: list[str], device_cols: list[str],
               ts: Column | str | None = None) -> DataFrame:
    """``audit_log``: the six ordered entries per case as
    array<struct<seq, ts, event, payload(JSON)>> (no shuffle, no union)."""
    clock = (F.lit(ts) if isinstance(ts, str) else ts) if ts is not None else \
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    opts = {"ignoreNullFields": "false"}
    score = json_number(F.col("model_score"))
    payloads = [
        F.to_json(F.struct(F.col("triage_summary").alias("summary")), opts),
        F.to_json(F.struct(F.struct(*[F.col(c) for c in customer_cols]).alias("customer"),
                           F.struct(*[F.col(c) for c in device_cols]).alias("device")), opts),
        F.to_json(F.struct(F.col("rule_hits")), opts),
        F.to_json(F.struct(score.alias("score")), opts),
        F.to_json(F.struct(F.col("investigation_notes").alias("notes")), opts),
        F.to_json(F.struct(F.col("decision"), score.alias("score")), opts),
    ]
    entries = [F.struct(F.lit(i + 1).alias("seq"), clock.alias("ts"), F.lit(ev).alias("event"),
                        p.alias("payload")) for i, (ev, p) in enumerate(zip(AUDIT_EVENTS, payloads))]
    return df.withColumn("audit_log", F.array(*entries))


def audit_table(df: DataFrame) -> DataFrame:
    """Long form ``(txn_id, seq, ts, event, payload)``."""
    return df.select("txn_id", F.inline("audit_log"))


# ------------------------------------------------------------------ P6 --
def _dumps(value: Column, kind: T.DataType) -> Column:
    """JSON text of a value with a space after every comma and colon."""
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _dumps(x, kind.elementType)), ", "), F.lit("]"))
    text = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(text, 2, F.length(text) - 2)


def _dumps_object(df: DataFrame, cols: list[str]) -> Column:
    parts = [F.concat(F.lit(f'"{c}": '), F.coalesce(_dumps(F.col(c), df.schema[c].dataType), F.lit("null"))) for c in cols]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def case_prompts(df: DataFrame) -> DataFrame:
    """Prompts for the three model steps, long form
    ``(case_id, step, system, prompt, temperature)``.

    Records and lists stand in the prompts as JSON with a space after commas
    and colons, in all three steps.
    """
    df = df.withColumn("new_device", ~F.coalesce(F.col("seen_before"), F.lit(False)))
    df = df.withColumn("__payment", _dumps_object(df, PAYMENT_COLUMNS))  # once, for two prompts
    payment = F.col("__payment")
    texts = {
        "triage": F.concat(F.lit(TRIAGE_PROMPT), payment),
        "model": F.concat(F.lit(MODEL_PROMPT), _dumps_object(df, ["amount", "channel", "new_device"])),
        "investigator": F.concat(F.lit(INVESTIGATOR_PROMPT), payment, F.lit(", rules "),
                                 _dumps(F.col("rule_hits"), df.schema["rule_hits"].dataType),
                                 F.lit(", score "), py_float_text(F.col("model_score"))),
    }
    prompts = [F.struct(F.lit(step).alias("step"), F.lit(SYSTEM_TEXT).alias("system"), text.alias("prompt"),
                        F.lit(STEP_TEMPERATURE[step]).alias("temperature")) for step, text in texts.items()]
    return df.select(F.col("txn_id").alias("case_id"), F.inline(F.array(*prompts)))
