"""Column helpers for number text, rounding and line handling.

All helpers build native Spark expressions (no Python UDFs), so they stay in
whole-stage codegen.  The number helpers reproduce Python's ``f"{x:.Nf}"`` and
``round(x, N)``: both round half-to-even on the exact binary value, which is
what ``java.text.DecimalFormat`` (behind ``format_number`` with a pattern)
does too.  ``round``/``bround`` in Spark round the *decimal text* of the
double and differ on values such as 0.0015.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.isspace() holds for, and the line ends of str.splitlines().
WHITE = (r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
LINE_ENDS = r"\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}"
_WS_EDGES = rf"^[{WHITE}]+|[{WHITE}]+$"


def _pattern(places: int) -> str:
    return "0." + "0" * places if places > 0 else "0"


def fixed(col: Column | str, places: int) -> Column:
    """``f"{x:.{places}f}"`` as text (no digit grouping)."""
    c = F.col(col) if isinstance(col, str) else col
    # F.format_number only takes an int; the pattern form needs an expression.
    return F.call_function("format_number", c, F.lit(_pattern(places)))


def py_round(col: Column | str, places: int) -> Column:
    """Python ``round(x, places)`` for doubles (half-even on the binary value)."""
    return fixed(col, places).cast("double")


def strip(col: Column | str) -> Column:
    """Python ``str.strip()`` (Spark ``trim`` removes only spaces)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, _WS_EDGES, "")


def empty_to(col: Column | str, default: str) -> Column:
    """Python ``s or default`` for text: null and '' both give ``default``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def contains_any(col: Column | str, words: list[str]) -> Column:
    """True when any of ``words`` is a substring of ``col`` (null -> false)."""
    c = F.col(col) if isinstance(col, str) else col
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return F.coalesce(hit, F.lit(False))
