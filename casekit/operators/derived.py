"""Inputs the transfer record takes as given, derived from event history.

* ``trailing_counts``: per key, how many earlier events fall in the last
  ``w`` seconds (the outbound-velocity counters).  Events are counted per key
  and minute first (combined map-side); whole minutes of a window are summed
  over those counts, and only the two minutes at its ends are looked at event
  by event.  Sums and end minutes come from one window pass over the minutes:
  one shuffle, one sort.  No list is longer than one key's minute, and a task
  that windows a hot key sees one row per minute of its history.
* ``first_seen_days``: days since a key pair was first seen -- an aggregate
  (combined map-side) joined back on the pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from casekit.functions.workers import ship_with_tasks

ship_with_tasks(__name__)

_US = 1_000_000


def _point_counts(windows: list[int], names: list[str], bucket: int, schema: pa.Schema):
    """Per key and bucket: the counts at each of its times, in whole arrays for
    a batch of buckets (a time is its bucket's row and its place in the bucket)."""
    span = bucket * _US

    def places(lists: pa.Array, start: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        return np.sort(row * span + lists.flatten().to_numpy() - start[row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            start = batch.column("__b").to_numpy() * span
            times = places(batch.column("times"), start)
            at = np.unique(times)
            row = at // span
            columns = [batch.column("__k").take(pa.array(row)), pa.array(at - row * span + start[row])]
            own = np.searchsorted(times, at) - np.searchsorted(times, row * span)
            for i, w in enumerate(windows):
                edge = places(batch.column(f"edge{i}"), start - w * _US)
                later = np.searchsorted(edge, (row + 1) * span) - np.searchsorted(edge, at)
                columns.append(pa.array(own + batch.column(f"full{i}").to_numpy()[row] + later))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    return run


def trailing_counts(df: DataFrame, key: str, ts: str, windows_seconds: list[int], prefix: str = "count_prev_") -> DataFrame:
    """Add ``{prefix}{w}s``: events of the same ``key`` at times in
    ``[t - w, t)`` (microsecond resolution, the row itself excluded).  A row
    without a time counts 0 and is no event to others; a null key is a key."""
    windows = [int(w) for w in windows_seconds]
    names = [f"{prefix}{w}s" for w in windows]
    bucket = math.gcd(60, *windows)  # so that a window begins as far into its bucket as it ends into its own
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("__us", us)
    events = rows.filter(F.col("__us").isNotNull()).select(
        F.col(key).alias("__k"), "__us", F.expr(f"(__us - pmod(__us, {bucket * _US}L)) div {bucket * _US}L").alias("__b"))
    minutes = events.groupBy("__k", "__b").agg(F.count(F.lit(1)).alias("n"), F.collect_list("__us").alias("times"))
    history = Window.partitionBy("__k").orderBy("__b")
    cell = minutes
    for i, w in enumerate(windows):
        back = w // bucket
        full = F.coalesce(F.sum("n").over(history.rangeBetween(1 - back, -1)), F.lit(0)) if w > bucket else F.lit(0).cast("long")
        edge = F.first("times").over(history.rangeBetween(-back, -back))
        cell = cell.withColumn(f"full{i}", full).withColumn(f"edge{i}", edge)
    cell = cell.drop("n")
    schema = T.StructType([T.StructField("__k", df.schema[key].dataType), T.StructField("__us", T.LongType())]
                          + [T.StructField(n, T.LongType()) for n in names])
    found = cell.mapInArrow(_point_counts(windows, names, bucket, to_arrow_schema(schema)), schema).withColumnsRenamed(
        {"__k": "__k2", "__us": "__us2"})
    out = rows.join(found, F.col(key).eqNullSafe(F.col("__k2")) & (F.col("__us") == F.col("__us2")), "left")
    return out.select(*df.columns, *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names])


def first_seen_days(df: DataFrame, keys: list[str], ts: str, out: str = "first_seen_days") -> DataFrame:
    """Days between the row's date and the first date its ``keys`` occur."""
    first = (df.groupBy(*keys).agg(F.min(F.to_date(F.col(ts))).alias("__first"))
             .select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__first"))
    cond = [df[k].eqNullSafe(first[f"__k_{k}"]) for k in keys]
    return (df.join(first, cond, "left")
              .withColumn(out, F.datediff(F.to_date(F.col(ts)), F.col("__first")))
              .drop("__first", *[f"__k_{k}" for k in keys]))
