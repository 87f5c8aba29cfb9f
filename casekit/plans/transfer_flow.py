"""Job A as one lazy plan: enrichment -> rules -> ML -> notes -> decision -> report.

The six steps are ``df.transform`` calls that only add columns, so Catalyst
collapses them into a single projection over the scan; with completions the
plan gains one join on the case key.  The same function scores a batch, a
single record (a one-row DataFrame) or a micro-batch of a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from casekit.operators import transfers as T


def score_transfers(df: DataFrame, completions: DataFrame | None = None,
                    run_id: str = "", created_at: str | None = None,
                    notes_header: str = T.DEFAULT_NOTES_HEADER, completion_col: str | None = None) -> DataFrame:
    """Typed transfer rows in, one scored case per row out."""
    return (df.transform(T.enrich_transfers)
              .transform(T.score_rules)
              .transform(T.ml_risk)
              .transform(T.attach_notes, completions, header=notes_header, completion_col=completion_col)
              .transform(T.decide)
              .transform(T.make_reports, run_id=run_id, created_at=created_at))


def run_case(spark, record: dict, completions: DataFrame | None = None,
             run_id: str = "", created_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One transfer record (a dict, as posted by a client) -> (its report row,
    rejected rows); invalid input comes back rejected instead of raising."""
    from casekit.schemas import TRANSFER_COLUMNS, TRANSFER_TEXT
    raw = {c: (None if record.get(c) is None else str(record.get(c)).lower()
               if isinstance(record.get(c), bool) else str(record.get(c))) for c in TRANSFER_COLUMNS}
    row = [tuple(raw[c] for c in TRANSFER_COLUMNS) + (None,)]
    df = spark.createDataFrame(row, TRANSFER_TEXT)
    valid, rejected = T.validate_transfers(df)
    return score_transfers(valid, completions, run_id, created_at), rejected
