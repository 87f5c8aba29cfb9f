"""The integer product tool as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def multiply(a: Column | str, b: Column | str, strict: bool = False) -> Column:
    """``a * b`` on integers; overflow gives null, or raises with ``strict``
    (ANSI arithmetic)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return a * b if strict else F.try_multiply(a, b)
