import datetime as dt
import random

import pytest

from casekit.operators import derived as DER
from casekit.operators.tools import multiply


@pytest.mark.parametrize("windows", [[3600, 7200], [60], [30, 90], [7, 86400]])
def test_trailing_counts_brute_force(spark, windows):
    rnd = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.choice([1, 2, None]), t0 + dt.timedelta(seconds=rnd.choice(
        [rnd.randint(0, 200000), rnd.randint(0, 300), 3600, 7200, 86400]), microseconds=rnd.choice([0, 0, 1, 999999])))
        for i in range(400)] + [(1000, 1, None), (1001, 1, None), (1002, None, None)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz")
    out = {r.id: r for r in DER.trailing_counts(df, "k", "ts", windows).collect()}
    assert len(out) == len(rows)
    for i, k, t in rows:
        for w in windows:
            want = sum(1 for _, kk, tt in rows if t and tt and kk == k and t - dt.timedelta(seconds=w) <= tt < t)
            assert out[i][f"count_prev_{w}s"] == want


def test_trailing_counts_hot_key(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "hot", t0 + dt.timedelta(minutes=i)) for i in range(2000)]
    rows += [(10000 + i, f"k{i}", t0 + dt.timedelta(minutes=i % 50)) for i in range(4000)]
    out = DER.trailing_counts(spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz"), "k", "ts", [3600])
    got = {r.id: r.count_prev_3600s for r in out.collect()}
    assert len(got) == 6000 and got[0] == 0 and got[30] == 30 and got[1999] == 60 and got[10007] == 0


def test_first_seen_and_product(spark):
    df = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1, 5)), (2, "a", dt.datetime(2024, 1, 4)),
                                (3, "b", dt.datetime(2024, 1, 3))], "id long, k string, ts timestamp")
    got = {r.id: r.first_seen_days for r in DER.first_seen_days(df, ["k"], "ts").collect()}
    assert got == {1: 0, 2: 3, 3: 0}
    p = spark.createDataFrame([(23, 17), (2 ** 62, 4)], "a long, b long").select(multiply("a", "b").alias("p"))
    assert [r.p for r in p.collect()] == [391, None]


def test_trailing_counts_shuffle_minutes_once_for_all_windows(spark):
    """More windows do not mean more joins: sums and end minutes come from one pass."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame([(i, i % 3, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=37 * i)) for i in range(200)], "id long, k long, ts timestamp")
        plan = lambda windows: DER.trailing_counts(df, "k", "ts", windows)._jdf.queryExecution().executedPlan().toString()
        shuffles = [plan(w).count("Exchange hashpartitioning") for w in ([60], [60, 600, 3600, 86400])]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert shuffles[0] == shuffles[1] <= 4
