"""Inputs derived from event history, for events that arrive as a stream.

Both operators give every event what the batch form (:mod:`casekit.operators.
derived`) gives it, whatever the order of arrival within the watermark's delay:

* Late-data rule: the watermark is the latest event time seen, less ``delay``.
  An event that arrives when the watermark has reached its time is late: it is
  left out, of the result and of what others count.
* An event comes out when the watermark reaches its time, for then nothing
  earlier can arrive any more.  Events of the last ``delay`` therefore wait for
  later ones.
* Events without a time count 0 (first seen: null), come out at once and are
  nothing to others.

State is keyed, kept in Spark's state store under the query's checkpoint, and
expires: trailing counts keep the times of one key's longest window and delay
(each distinct time once, with its count); first-seen days keep one day a key
pair, and drop it ``expire_days`` after the pair was last seen, if that is given.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from casekit.functions.workers import ship_with_tasks

ship_with_tasks(__name__)

_US = 1_000_000
_DAY = 86400 * _US
_TIME = "micros__"  # state processors rename columns that begin with an underscore


def _as_bytes(rows: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    rows.to_pickle(out)  # rows of this very query, in its own state store
    return out.getvalue()


def _as_rows(data: bytes | None) -> list[pd.DataFrame]:
    return [pd.read_pickle(io.BytesIO(data))] if data else []


# ------------------------------------------------------ trailing counts --
def _counted(times: np.ndarray, counts: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """How many events lie in [t - window, t) for each t."""
    before = np.append(0, np.cumsum(counts))
    return before[np.searchsorted(times, at, "left")] - before[np.searchsorted(times, at - window, "left")]


def _trailing(windows: list[int], names: list[str], columns: list[str]):
    longest = max(windows) * _US

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reached = state.getCurrentWatermarkMs() * 1000
        held, times, counts = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        if state.exists:
            held, t, c = state.get
            times, counts = np.frombuffer(t, np.int64), np.frombuffer(c, np.int64)
        parts = _as_rows(held)
        for rows in batches:
            timeless = rows[rows[_TIME].isna()]
            if len(timeless):
                yield timeless.assign(**{n: 0 for n in names})[columns + names]
            rows = rows[rows[_TIME].notna()]
            parts.append(rows[rows[_TIME] > reached])  # late rows go
        rows = pd.concat(parts, ignore_index=True) if parts else None
        if rows is not None and len(rows):
            us = rows[_TIME].to_numpy(np.int64)
            final = us <= reached
            new, n = np.unique(us[final], return_counts=True)
            both, place = np.unique(np.concatenate((times, new)), return_inverse=True)
            counts = np.bincount(place, np.concatenate((counts, n)), len(both)).astype(np.int64)
            times = both
            if final.any():
                out = rows[final].copy()
                for w, name in zip(windows, names, strict=True):
                    out[name] = _counted(times, counts, us[final], w * _US)
                yield out[columns + names]
            rows = rows[~final]
        keep = times >= reached - longest
        times, counts = times[keep], counts[keep]
        waiting = rows is not None and len(rows) > 0
        if not waiting and not len(times):
            if state.exists:
                state.remove()
            return
        state.update((_as_bytes(rows) if waiting else b"", times.tobytes(), counts.tobytes()))
        wake = int(rows[_TIME].min()) if waiting else int(times[-1]) + longest
        state.setTimeoutTimestamp(max(-(-wake // 1000), reached // 1000 + 1))
    return work


def trailing_counts_stream(events: DataFrame, key: str, ts: str, windows_seconds: list[int], delay: str,
                           prefix: str = "count_prev_") -> DataFrame:
    """Streaming form of :func:`casekit.operators.derived.trailing_counts`."""
    windows = [int(w) for w in windows_seconds]
    names, columns = [f"{prefix}{w}s" for w in windows], list(events.columns)
    schema = T.StructType([*events.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])
    rows = events.withWatermark(ts, delay).withColumn(_TIME, F.unix_micros(F.col(ts).cast("timestamp")))
    return rows.groupBy(key).applyInPandasWithState(
        _trailing(windows, names, columns), schema, "held binary, times binary, counts binary", "append",
        GroupStateTimeout.EventTimeTimeout)


# ----------------------------------------------------------- first seen --
class _FirstSeen(StatefulProcessor):
    """The first day of a key pair, and its rows that wait for the watermark."""

    def __init__(self, columns: list[str], out: str, expire_days: int | None):
        self.columns, self.out, self.expire_days = columns, out, expire_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "day int, last long")
        self.held = handle.getValueState("held", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        parts = _as_rows(self.held.get()[0]) if self.held.exists() else []
        for pdf in rows:
            if pdf.empty:  # comes without columns
                continue
            timeless = pdf[pdf[_TIME].isna()]
            if len(timeless):
                yield timeless.assign(**{self.out: pd.array([None] * len(timeless), "Int32")})[[*self.columns, self.out]]
            pdf = pdf[pdf[_TIME].notna()]
            parts.append(pdf[pdf[_TIME] > reached])  # late rows go
        waiting = pd.concat(parts, ignore_index=True) if parts else None
        if waiting is not None and len(waiting):
            self.held.update((_as_bytes(waiting),))
            self.handle.registerTimer(max(-(-int(waiting[_TIME].min()) // 1000), reached // 1000 + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = _as_rows(self.held.get()[0])[0] if self.held.exists() else None
        first, last = self.first.get() if self.first.exists() else (None, None)
        if waiting is not None:
            us = waiting[_TIME].to_numpy(np.int64)
            final = us <= reached
            if final.any():
                out = waiting[final].sort_values(_TIME, kind="stable")
                us = out[_TIME].to_numpy(np.int64)
                days = us // _DAY
                firsts = self._firsts(us, days, first, last)
                first, last = int(firsts[-1]), int(us[-1])
                self.first.update((first, last))
                yield out.assign(**{self.out: (days - firsts).astype(np.int32)})[[*self.columns, self.out]]
                waiting = waiting[~final]
                if len(waiting):
                    self.held.update((_as_bytes(waiting),))
                else:
                    self.held.clear()
                    waiting = None
        if waiting is not None:
            self.handle.registerTimer(max(-(-int(waiting[_TIME].min()) // 1000), reached // 1000 + 1))
        elif self.expire_days is not None and last is not None:
            end = last + self.expire_days * _DAY
            if end <= reached:
                self.first.clear()
            else:
                self.handle.registerTimer(-(-end // 1000))

    def _firsts(self, us: np.ndarray, days: np.ndarray, first: int | None, last: int | None) -> np.ndarray:
        """The first day that counts for each of the rows, in order of time: the
        known one, or that of the row after the last gap of ``expire_days``."""
        gap = np.diff(us, prepend=us[0] if last is None else last)
        begins = gap > self.expire_days * _DAY if self.expire_days is not None else np.zeros(len(us), bool)
        begins[0] |= first is None
        at = np.maximum.accumulate(np.where(begins, np.arange(len(us)), -1))
        return np.where(at < 0, first if first is not None else 0, days[at])

    def close(self) -> None:
        pass


def first_seen_days_stream(events: DataFrame, keys: list[str], ts: str, delay: str, out: str = "first_seen_days",
                           expire_days: int | None = None) -> DataFrame:
    """Streaming form of :func:`casekit.operators.derived.first_seen_days`.

    Needs the RocksDB state store (``STATE_STORE``).  With ``expire_days`` a pair
    not seen for longer counts as new when it comes again, by event times alone;
    its state is deleted when the watermark has passed that span.
    """
    schema = T.StructType([*events.schema.fields, T.StructField(out, T.IntegerType())])
    rows = events.withWatermark(ts, delay).withColumn(_TIME, F.unix_micros(F.col(ts).cast("timestamp")))
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_FirstSeen(list(events.columns), out, expire_days), outputStructType=schema,
        outputMode="append", timeMode="EventTime")


# The state store that first_seen_days_stream needs, as a session setting.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
