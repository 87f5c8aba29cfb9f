"""Ordered rule sets evaluated as one projection.

A rule is a named boolean ``Column``.  ``apply_rules`` turns a list of rules
into three columns -- a map holding only the rules that fired, the reason
texts in rule order and the number of hits -- without a UDF, so the whole
set compiles into the same codegen stage as the surrounding projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    reason: str
    predicate: Column


def fired(rule: Rule) -> Column:
    # Python truthiness: a null predicate does not fire.
    return F.coalesce(rule.predicate, F.lit(False))


def compact(values: list[Column], dtype: str = "string") -> Column:
    """The non-null ``values`` in order, as an array.

    ``array_except`` against ``[null]`` keeps order and compiles into
    whole-stage codegen; ``array_compact`` is a lambda ``filter`` that drops
    the whole projection out of codegen.  It also removes duplicates, so
    callers pass distinct values.
    """
    return F.array_except(F.array(*values), F.array(F.lit(None).cast(dtype)))


def apply_rules(df: DataFrame, rules: list[Rule], flags: str = "flags",
                reasons: str = "reasons", count: str = "n_flags",
                hit_names: str | None = None) -> DataFrame:
    """Evaluate ``rules`` in order on every row.

    ``flags``: map<string,boolean> with only fired rules; ``reasons``:
    reason texts of fired rules in rule order; ``count``: number fired.
    ``hit_names`` (optional): fired rule *names* in rule order.
    """
    names = [r.name for r in rules]
    if len(set(names)) != len(names):
        raise ValueError("rule names must be distinct")
    hits = [(r, F.col(f"__hit_{i}")) for i, r in enumerate(rules)]
    staged = df.withColumns({f"__hit_{i}": fired(r) for i, r in enumerate(rules)})
    fired_names = compact([F.when(h, F.lit(r.name)) for r, h in hits])
    texts = [F.when(h, F.lit(r.reason)) for r, h in hits]
    distinct_reasons = len({r.reason for r in rules}) == len(rules)
    cols = {
        flags: F.map_from_arrays(fired_names, F.array_repeat(F.lit(True), F.size(fired_names))),
        reasons: compact(texts) if distinct_reasons else F.array_compact(F.array(*texts)),
        count: sum((h.cast("int") for _, h in hits), F.lit(0)),
    }
    if hit_names:
        cols[hit_names] = fired_names
    return staged.withColumns(cols).drop(*[f"__hit_{i}" for i in range(len(rules))])
