"""Transfers and model completions that arrive as two streams.

A completion may arrive before or after the transfer's record reaches the job,
in any order.  It counts if it was answered within ``wait`` of the transfer;
when the watermark (latest time seen on both streams, less ``delay``) has passed
that span without one, the transfer gets the fallback notes.  Both sides are
kept in Spark's join state and leave it with the watermark.

Defined results: of several completions of one transfer and step the greatest
text counts, as in the batch form; a transfer repeated in full counts once;
records and completions that arrive after the watermark has passed their time
are left out.  On batch tables the same function gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.plans.transfer_flow import score_transfers


def join_completions(transfers: DataFrame, completions: DataFrame, arrived: str = "arrived", answered: str = "answered",
                     wait: str = "1 hour", delay: str = "10 minutes", step: str = "investigator") -> DataFrame:
    """``transfers`` (transfer columns, ``arrived``) with ``completion``: the
    text of ``completions`` (case_id, step, text, ``answered``), null without one."""
    columns = transfers.columns
    left = transfers.withWatermark(arrived, delay)
    right = completions.filter(F.col("step") == step).select(
        F.col("case_id").alias("__case"), F.col("text").alias("__text"), F.col(answered).alias("__answered")).withWatermark("__answered", delay)
    in_time = F.col("__answered").between(F.col(arrived), F.col(arrived) + F.expr(f"INTERVAL {wait}"))
    joined = left.join(right, (F.col("txn_id") == F.col("__case")) & in_time, "leftOuter")
    return joined.groupBy(*columns).agg(F.max("__text").alias("completion"))


def score_with_completions(transfers: DataFrame, completions: DataFrame, run_id: str = "", created_at: str | None = None,
                           **join) -> DataFrame:
    """Two streams (or tables) in, one scored case per transfer out."""
    return score_transfers(join_completions(transfers, completions, **join), run_id=run_id, created_at=created_at,
                           completion_col="completion")
