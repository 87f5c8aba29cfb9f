"""Mixing sources to target weights by fitting a word budget exactly.

Sizes are words.  Sources in code-point order (null last) weigh ``weights``
cyclically and share 100 % of all sizes; no target exceeds ``max_epochs``
times its source's size, the excess going to the other sources by weight.
A source is taken whole as often as its target allows; the rest of its budget
is fitted by counts of documents per exact length: a proportional share of
each length, then whole documents until little is left, then a
bounded-knapsack search for the best remaining subset sum.  Within a length
the documents with the smallest seeded hashes are selected.

Scale: only (source, length, hash bucket) counts are shuffled besides the
documents' join with the plan.  The documents of one length are ranked inside
the one bucket where the count runs out, so a length shared by a third of all
rows is never sorted as a whole.

Defined results: a null or empty text has size 0 and is never taken.  A null
source is a source.  Rows repeated in full are told apart by no column, so any
of them may be the ones taken.  An empty table gives an empty result.  Extra
columns are carried along; ``size``, ``source_size``, ``target``, ``taken`` and
``copies`` replace columns of these names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casekit.functions.workers import ship_with_tasks
from casekit.llm.common import WORD, store, text_of

ship_with_tasks(__name__)

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BUCKET_BITS = 10
ADDED = ["size", "source_size", "target", "taken", "copies"]
# The knapsack search begins when so many words are left, or so many times the longest document.
_DP_WORDS, _DP_LONGEST = 100_000, 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> plus ``target``, one row per source.

    Sources in order of cap / weight: those below the common level are capped,
    the level is what is left over the weights that are left.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((nth - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    by_ratio = Window.orderBy("_m_ratio", F.col("source").asc_nulls_last())
    before = F.sum("_m_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1))
    after = F.sum("_m_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(before, F.lit(0.0))) / after
    open_ = F.when(F.col("_m_level") <= F.col("_m_ratio"), F.struct("_m_ratio", "_m_level"))
    return (sizes.withColumn("_m_w", weight)
            .withColumn("_m_cap", cap)
            .withColumn("_m_ratio", F.col("_m_cap") / F.col("_m_w"))
            .withColumn("_m_level", level)
            .withColumn("_m_level", F.min(open_).over(everything)["_m_level"])
            .select("source", "source_size",
                    F.least("_m_cap", F.col("_m_level") * F.col("_m_w")).alias("target")))


def fit_lengths(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take: their words come as near to
    ``budget`` from below as a subset can once the shares are dealt."""
    total = sum(n * c for n, c in counts.items())
    if budget <= 0 or total <= 0:
        return {}
    if budget >= total:
        return dict(counts)
    take = {n: c * budget // total for n, c in counts.items()}
    left = budget - sum(n * k for n, k in take.items())
    spare = {n: c - take[n] for n, c in counts.items() if c > take[n]}
    span = max(_DP_WORDS, _DP_LONGEST * max(counts))
    for n in sorted(spare, reverse=True):
        k = min(spare[n], max(0, left - span) // n + (left > span))
        k = min(k, left // n)
        take[n] += k
        spare[n] -= k
        left -= n * k
        if left <= span:
            break
    # Bounded knapsack: bit s of ``reach`` says that s words can be made.
    reach, mask, steps = 1, (1 << (left + 1)) - 1, []
    for n in sorted((n for n in spare if spare[n] and n <= left), reverse=True):
        c, part = min(spare[n], left // n), 1
        while c > 0 and not reach >> left & 1:
            k = min(part, c)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            c, part = c - k, part * 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for n, k, was in reversed(steps):
        if not was >> at & 1:
            take[n] += k
            at -= n * k
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts by length of one source -> (epochs, extra) by length."""
    total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    epochs = int(target // total)
    extra = fit_lengths(dict(zip(rows["size"].tolist(), rows["n"].tolist(), strict=True)), round(target - epochs * total))
    return pd.DataFrame({"source": rows["source"], "size": rows["size"], "epochs": epochs,
                         "extra": [extra.get(n, 0) for n in rows["size"].tolist()]})


def mix(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 17,
        weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Append ``size``, ``source_size``, ``target``, ``taken`` (words) and
    ``copies`` (how often the mix holds the document)."""
    base = df.drop(*ADDED)
    sized = (base.withColumn("size", F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long"))
             .withColumn("_m_h", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)))
             .withColumn("_m_b", F.shiftrightunsigned("_m_h", 64 - BUCKET_BITS)))
    hist = store(sized.groupBy("source", "size", "_m_b").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    lengths = hist.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = store(source_targets(sizes, weights, max_epochs), "mix-targets")
    fit_in = (lengths.filter("size > 0").join(targets.withColumnRenamed("source", "_m_source"),
                                              F.col("source").eqNullSafe(F.col("_m_source")))
              .select("source", "size", "n", "source_size", "target"))
    fits = fit_in.groupBy("source").applyInPandas(_fit_source, "source string, size long, epochs long, extra long")
    # The bucket in which a length's extra documents run out, and how many of it are taken.
    upto = Window.partitionBy("source", "size").orderBy("_m_b").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("_m_cum", F.sum("n").over(upto)).withColumnRenamed("size", "_m_size2").withColumnRenamed(
        "source", "_m_source2")
    edge = (fits.join(cum, F.col("source").eqNullSafe(F.col("_m_source2")) & (F.col("size") == F.col("_m_size2")), "left")
            .filter((F.col("_m_cum") >= F.col("extra")) & (F.col("_m_cum") - F.col("n") < F.col("extra")) | (
                (F.col("extra") == 0) & (F.col("_m_cum") == F.col("n"))))
            .select(F.col("source").alias("_m_s"), F.col("size").alias("_m_n"), F.col("epochs").alias("_m_epochs"),
                    F.when(F.col("extra") > 0, F.col("_m_b")).otherwise(F.lit(-1)).alias("_m_edge"),
                    (F.col("extra") - F.col("_m_cum") + F.col("n")).alias("_m_rest")))
    plan = store(edge, "mix-plan")
    t = targets.select(F.col("source").alias("_m_t"), "source_size", "target")
    planned = (sized.join(t, F.col("source").eqNullSafe(F.col("_m_t")), "left")
               .join(plan, F.col("source").eqNullSafe(F.col("_m_s")) & (F.col("size") == F.col("_m_n")), "left"))
    at_edge = F.coalesce(F.col("_m_b") == F.col("_m_edge"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("source", "size", "_m_b").orderBy("_m_h", id_col))
    inside = planned.filter(at_edge).withColumn("_m_x", (rank <= F.col("_m_rest")).cast("long"))
    outside = planned.filter(~at_edge).withColumn(
        "_m_x", F.coalesce(F.col("_m_b") < F.col("_m_edge"), F.lit(False)).cast("long"))
    out = outside.unionByName(inside).withColumn("copies", F.coalesce(F.col("_m_epochs") + F.col("_m_x"), F.lit(0)))
    return out.select(*base.columns, "size", "source_size", F.col("target"),
                      (F.col("copies") * F.col("size")).alias("taken"), "copies")
