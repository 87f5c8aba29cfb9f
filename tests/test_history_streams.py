"""Streams with state give what the batch operators give."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from casekit.operators import derived as DER
from casekit.sources import sinks
from casekit.sources.adapters import parse_transfer_text
from casekit.streaming import history_stream as HS
from casekit.streaming import notes_stream as NS
from fixtures import TRANSFERS

EVENTS = "event_id long, user_id string, kind string, ts timestamp"


def write_files(folder, batches):
    """One JSON file per batch, read in this order."""
    os.makedirs(folder, exist_ok=True)
    for n, rows in enumerate(batches):
        path = os.path.join(folder, f"{len(os.listdir(folder)):03}.json")
        with open(path, "w") as f:
            f.writelines(json.dumps(r, default=lambda t: t.isoformat(sep=" ")) + "\n" for r in rows)
        os.utime(path, (1_700_000_000 + 60 * n + 3600 * len(os.listdir(folder)),) * 2)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").json(folder)


def run(df, out, checkpoint):
    q = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination(300)
    assert q.exception() is None


def events(n=300, seed=2):
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        ts = start + dt.timedelta(seconds=rnd.randint(0, 86400 * 2), microseconds=rnd.choice([0, 0, 1, 999_999]))
        rows.append({"event_id": i, "user_id": rnd.choice(["a", "b", None]), "kind": rnd.choice("xy"), "ts": ts if i % 40 else None})
    rows += [dict(r, event_id=1000 + r["event_id"]) for r in rows[:20]]  # equal times
    return sorted(rows, key=lambda r: r["ts"] or start)


HEARTBEAT = {"event_id": -1, "user_id": "heartbeat", "kind": "z", "ts": dt.datetime(2030, 1, 1)}
DELAY = 7200


def arrivals(rows, seed):
    """Out of order by less than the delay, in four files; then a later event."""
    rnd = random.Random(seed)
    late = sorted(rows, key=lambda r: ((r["ts"] or max(x["ts"] for x in rows if x["ts"])) + dt.timedelta(seconds=rnd.uniform(0, DELAY - 60))))
    size = -(-len(late) // 4)
    return [late[i:i + size] for i in range(0, len(late), size)] + [[HEARTBEAT], [dict(HEARTBEAT, event_id=-2)]]


def batch_frame(spark, rows):
    return spark.createDataFrame([(r["event_id"], r["user_id"], r["kind"], r["ts"]) for r in rows], EVENTS)


def as_set(df):
    rows = sorted(map(str, df.filter("event_id >= 0").collect()))
    assert rows
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trailing_counts_stream_equals_batch(spark, scratch, seed):
    rows = events(seed=seed)
    write_files(scratch + "/in", arrivals(rows, seed))
    out = HS.trailing_counts_stream(stream(spark, scratch + "/in", EVENTS), "user_id", "ts", [3600, 86400], f"{DELAY} seconds")
    run(out, scratch + "/out", scratch + "/ck")
    want = DER.trailing_counts(batch_frame(spark, rows), "user_id", "ts", [3600, 86400])
    assert as_set(spark.read.schema(want.schema).parquet(scratch + "/out")) == as_set(want)


def test_trailing_counts_stream_leaves_late_events_out_and_restarts(spark, scratch):
    rows = [r for r in events(seed=3) if r["ts"]]
    half = len(rows) // 2
    late = [dict(rows[0], event_id=5000, ts=rows[0]["ts"] + dt.timedelta(seconds=1))]
    df = lambda: HS.trailing_counts_stream(stream(spark, scratch + "/in", EVENTS), "user_id", "ts", [3600], f"{DELAY} seconds")
    write_files(scratch + "/in", [rows[:half]])
    run(df(), scratch + "/out", scratch + "/ck")
    write_files(scratch + "/in", [rows[half:], late, [HEARTBEAT], [dict(HEARTBEAT, event_id=-2)]])
    run(df(), scratch + "/out", scratch + "/ck")  # goes on from its state
    want = DER.trailing_counts(batch_frame(spark, rows), "user_id", "ts", [3600])
    assert as_set(spark.read.schema(want.schema).parquet(scratch + "/out")) == as_set(want)


def test_first_seen_stream_restarts_from_its_checkpoint(spark, scratch):
    rows = events(seed=4)
    files = arrivals(rows, 5)
    before = spark.conf.get(HS.STATE_STORE[0])
    spark.conf.set(*HS.STATE_STORE)
    try:
        df = lambda: HS.first_seen_days_stream(stream(spark, scratch + "/in", EVENTS), ["user_id", "kind"], "ts", f"{DELAY} seconds")
        write_files(scratch + "/in", files[:2])
        run(df(), scratch + "/out", scratch + "/ck")
        write_files(scratch + "/in", files[2:])
        run(df(), scratch + "/out", scratch + "/ck")
    finally:
        spark.conf.set(HS.STATE_STORE[0], before)
    want = DER.first_seen_days(batch_frame(spark, rows), ["user_id", "kind"], "ts")
    assert as_set(spark.read.schema(want.schema).parquet(scratch + "/out")) == as_set(want)


def test_first_seen_state_expires(spark, scratch):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [{"event_id": i, "user_id": "a", "kind": "x", "ts": day(d)} for i, d in enumerate([0, 3, 20])]
    other = [{"event_id": 50 + i, "user_id": "b", "kind": "x", "ts": day(d)} for i, d in enumerate([2, 8, 15, 21])]
    before = spark.conf.get(HS.STATE_STORE[0])
    spark.conf.set(*HS.STATE_STORE)
    try:
        files = [[r] for r in sorted(rows + other, key=lambda r: r["ts"])] + [[HEARTBEAT], [dict(HEARTBEAT, event_id=-2)]]
        write_files(scratch + "/in", files)
        run(HS.first_seen_days_stream(stream(spark, scratch + "/in", EVENTS), ["user_id"], "ts", "1 hour", expire_days=10),
            scratch + "/out", scratch + "/ck")
    finally:
        spark.conf.set(HS.STATE_STORE[0], before)
    got = {r.event_id: r.first_seen_days for r in spark.read.parquet(scratch + "/out").collect()}
    assert {k: v for k, v in got.items() if k >= 0} == {0: 0, 1: 3, 2: 0, 50: 0, 51: 6, 52: 13, 53: 19}


# ----------------------------------------------------- completions --
def _transfers(spark, scratch):
    """Transfers with arrival times, and completions: in time, twice, too late, none."""
    at = lambda m: dt.datetime(2024, 5, 1, 12) + dt.timedelta(minutes=m)
    t = [dict(x, arrived=at(i)) for i, x in enumerate(TRANSFERS)]
    c = [("TX-3001", "investigator", "fine\nRECOMMENDATION: APPROVE", at(30)), ("TX-3002", "investigator", "a\nRECOMMENDATION: DECLINE", at(5)),
         ("TX-3002", "investigator", "b\nRECOMMENDATION: REVIEW", at(9)), ("TX-3003", "investigator", "late\nRECOMMENDATION: DECLINE", at(90)),
         ("TX-3004", "other", "no\nRECOMMENDATION: DECLINE", at(6))]
    c = [dict(zip(("case_id", "step", "text", "answered"), x, strict=True)) for x in c]
    end = dt.datetime(2024, 6, 1)
    return t, c, dict(TRANSFERS[0], txn_id="end", arrived=end), {"case_id": "end", "step": "investigator", "text": "end", "answered": end}


C_SCHEMA = "case_id string, step string, text string, answered timestamp"


@pytest.mark.parametrize("order", ["completions first", "transfers first", "mixed"])
def test_completions_that_arrive_as_a_stream(spark, scratch, order):
    t, c, t_end, c_end = _transfers(spark, scratch)
    from casekit.schemas import TRANSFER
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TRANSFER.fields) + ", arrived timestamp"
    hold = [dict(t_end, txn_id="x", arrived=t[0]["arrived"])]
    t_files = {"completions first": [hold, t], "transfers first": [t, hold], "mixed": [t[2:], t[:2]]}[order]
    c_files = {"completions first": [c, []], "transfers first": [[], c], "mixed": [c[::2], c[1::2]]}[order]
    write_files(scratch + "/t", [*t_files, [t_end], [dict(t_end, txn_id="end2")]])
    write_files(scratch + "/c", [*c_files, [c_end], [dict(c_end, case_id="end2")]])
    got = NS.score_with_completions(stream(spark, scratch + "/t", schema), stream(spark, scratch + "/c", C_SCHEMA), delay="2 hours", run_id="r")
    columns = ["txn_id", "investigator_notes", "notes_source", "verdict", "decision_score"]
    run(got.select(*columns), scratch + "/out", scratch + "/ck")
    rows = {r.txn_id: r for r in spark.read.parquet(scratch + "/out").collect() if r.txn_id.startswith("TX")}
    table = lambda name, s: spark.read.schema(s).json(f"{scratch}/{name}")
    batch = NS.score_with_completions(table("t", schema), table("c", C_SCHEMA), run_id="r").select(*columns)
    assert rows == {r.txn_id: r for r in batch.collect() if r.txn_id.startswith("TX")}
    assert {k: r.notes_source for k, r in rows.items()} == {"TX-3001": "model", "TX-3002": "model", "TX-3003": "heuristic",
                                                           "TX-3004": "heuristic", "TX-3005": "heuristic"}
    assert rows["TX-3002"].verdict == "REVIEW"


def test_replayed_batches_leave_one_copy(spark, scratch):
    from casekit.plans.transfer_flow import score_transfers
    from casekit.operators.transfers import validate_transfers
    os.makedirs(scratch + "/in")

    def reports():
        raw = spark.readStream.format("text").option("maxFilesPerTrigger", "1").load(scratch + "/in")
        return score_transfers(validate_transfers(parse_transfer_text(raw))[0], run_id="r").select("case_id", "txn_id", "verdict", "summary")

    for n in range(3):
        with open(f"{scratch}/in/{n}.json", "w") as f:
            f.writelines(json.dumps(dict(t, txn_id=f"{t['txn_id']}-{n}")) + "\n" for t in TRANSFERS)
    sinks.start_report_sink(reports(), scratch + "/out", scratch + "/ck", available_now=True).awaitTermination(300)
    first = sorted(map(str, sinks.read_reports(spark, scratch + "/out").drop("batch").collect()))
    assert len(first) == 3 * len(TRANSFERS)
    # As after a crash between the write and its commit: the last batch runs again.
    last = max((n for n in os.listdir(scratch + "/ck/commits") if n.isdigit()), key=int)
    os.remove(f"{scratch}/ck/commits/{last}")
    if os.path.exists(f"{scratch}/ck/commits/.{last}.crc"):
        os.remove(f"{scratch}/ck/commits/.{last}.crc")
    seen = os.path.getmtime(f"{scratch}/out/batch={last}/_SUCCESS")
    sinks.start_report_sink(reports(), scratch + "/out", scratch + "/ck", available_now=True).awaitTermination(300)
    assert os.path.getmtime(f"{scratch}/out/batch={last}/_SUCCESS") > seen
    assert sorted(map(str, sinks.read_reports(spark, scratch + "/out").drop("batch").collect())) == first
