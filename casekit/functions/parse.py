"""Parsing model text into numbers and recommendations, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casekit.functions.text import LINE_ENDS, WHITE, strip

# Python's float() grammar for one token: digits with single '_' separators,
# optional fraction and exponent, or inf/infinity/nan, each with a sign.
# Spark's cast accepts more (e.g. '1.0d') and less (e.g. '1_0'), so the
# token is matched first and only then cast.
PY_FLOAT_TOKEN = (
    r"^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
    r"|^[+-]?(?i:inf|infinity|nan)$"
)


def first_token(col: Column | str) -> Column:
    """``text.strip().split()[0]`` or '' when there is no token."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract(F.coalesce(c, F.lit("")), rf"^[{WHITE}]*([^{WHITE}]+)", 1)


def leading_float(col: Column | str, default: float) -> Column:
    """``float(text.strip().split()[0])`` with ``default`` when that raises."""
    tok = first_token(col)
    parsed = F.regexp_replace(tok, "_", "").cast("double")
    return F.when(tok.rlike(PY_FLOAT_TOKEN), parsed).otherwise(F.lit(float(default)))


def last_prefixed_line(col: Column | str, prefix: str) -> Column:
    """The value after ``prefix`` on the last line that starts with it.

    Lines are compared stripped and upper-cased; every occurrence of the
    prefix is removed from the hit and the rest stripped.  No hit -> ''.
    One regex does the scan: the greedy ``.*`` makes the match the *last*
    such line, and regex extraction stays in whole-stage codegen (a
    split/filter over lines would need lambdas, which do not).
    """
    c = F.col(col) if isinstance(col, str) else col
    quoted = "".join("\\" + ch if not ch.isalnum() else ch for ch in prefix)
    pattern = rf"(?s)^.*(?:^|[{LINE_ENDS}])[{WHITE}]*(?i:{quoted})([^{LINE_ENDS}]*)"
    rest = F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1)
    return strip(F.replace(F.upper(rest), F.lit(prefix.upper()), F.lit("")))
