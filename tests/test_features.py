import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from casekit.operators import features as FE


def _events(spark, n=400, seed=3):
    rnd = random.Random(seed)
    base = dt.date(2024, 1, 1)
    rows = [(rnd.choice(["a", "b", "c"]), base + dt.timedelta(days=rnd.randint(0, 40)), float(rnd.randint(0, 9)))
            for _ in range(n)]
    return rows, spark.createDataFrame(rows, "k string, d date, v double")


def _round2(x):
    # PySpark round(): half-up on the decimal text of the double.
    return float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def _brute(rows, k, d, size, off, fn):
    vals = [v for (kk, dd, v) in rows if kk == k and d - dt.timedelta(days=size - 1 + off) <= dd <= d - dt.timedelta(days=off)]
    if fn == "count":
        return len(vals)
    if not vals:
        return None
    return _round2(sum(vals) / len(vals)) if fn == "avg" else _round2(sum(vals))


@pytest.mark.parametrize("size,off", [(7, 0), (3, 0), (7, 2), (1, 0)])
def test_rolling_matches_brute_force(spark, size, off):
    rows, df = _events(spark)
    out = FE.rolling_window_aggregations(df, ["k"], "d", ["sum", "avg", "count"], ["v"], [size], off).collect()
    assert len(out) == len(rows)
    sfx = f"{size}d" + (f"_off{off}" if off else "")
    for r in out:
        for fn in ("sum", "avg", "count"):
            assert r[f"{fn}_v_{sfx}"] == _brute(rows, r.k, r.d, size, off, fn), (fn, r)


def test_rolling_stddev_min_max_and_types(spark):
    import statistics
    rows, df = _events(spark)
    df = df.withColumn("big", df.v + 1e9)
    out = FE.rolling_window_aggregations(df, ["k"], "d", ["stddev", "min", "max"], ["v", "big"], [3], round_dec_points=None)
    assert len(out.columns) == 4 + 6
    for r in out.collect():
        vals = [v for k, d, v in rows if k == r.k and d is not None and r.d is not None and 0 <= (r.d - d).days < 3]
        assert (r.min_v_3d, r.max_v_3d) == (min(vals), max(vals))
        if len(vals) < 2:
            assert r.stddev_v_3d is None and r.stddev_big_3d is None
        else:
            want = statistics.stdev(vals)
            assert abs(r.stddev_v_3d - want) < 1e-9 and abs(r.stddev_big_3d - want) < 1e-4
    amounts = df.selectExpr("k", "d", "cast(v as decimal(18,2)) v")
    alone = FE.rolling_window_aggregations(amounts, ["k"], "d", ["sum", "avg"], ["v"], [3])
    both = FE.rolling_window_aggregations(amounts, ["k"], "d", ["sum", "avg", "stddev"], ["v"], [3])
    for c in ("sum_v_3d", "avg_v_3d"):
        assert alone.schema[c].dataType == both.schema[c].dataType


@pytest.mark.parametrize("size,off", [(7, 0), (1, 0), (4, 3)])
def test_rolling_distinct_matches_brute_force(spark, size, off):
    rnd = random.Random(size)
    base = dt.date(2024, 1, 1)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([base + dt.timedelta(days=rnd.randint(0, 60)), None] + [base] * (i % 2)),
             rnd.choice([None, "x", "y", "z", "w", str(rnd.randint(0, 30))])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, d date, v string")
    out = FE.rolling_window_aggregations(df, ["k"], "d", "count_distinct", ["v"], [size, 30], off).collect()
    assert len(out) == len(rows)
    for r in out:
        for w in (size, 30):
            lo, hi = w - 1 + off, off
            if r.d is None:
                want = {v for k, d, v in rows if k == r.k and d is None and v is not None}
            else:
                want = {v for k, d, v in rows if k == r.k and d is not None and v is not None and hi <= (r.d - d).days <= lo}
            assert r[f"count_distinct_v_{w}d" + (f"_off{off}" if off else "")] == len(want), r


def test_sketches_estimate_and_merge_over_runs(spark):
    rnd = random.Random(5)
    base = dt.date(2024, 1, 1)
    rows = [(rnd.choice(["a", "b"]), base + dt.timedelta(days=rnd.randint(0, 9)), rnd.randint(0, 20000)) for _ in range(60000)]
    df = spark.createDataFrame(rows, "k string, d date, v long")
    both = FE.rolling_window_aggregations(df, ["k"], "d", ["count_distinct", "approx_count_distinct"], ["v"], [7, 1])
    seen = both.drop("v").distinct().collect()
    for r in seen:
        for w in (7, 1):
            exact, about = r[f"count_distinct_v_{w}d"], r[f"approx_count_distinct_v_{w}d"]
            assert abs(about - exact) <= 4 * FE.SKETCH_ERROR * exact + 1
    # tables of two runs that share days and values
    first, second = df.filter("v % 3 > 0"), df.filter("v % 3 < 2")
    merged = FE.merge_sketches([FE.daily_sketches(x, ["k"], "d", ["v"]) for x in (first, second)], ["k"])
    got = {(r.k, r.day): r for r in FE.sketched_distinct_counts(merged, ["k"], [7, 1]).collect()}
    assert len(got) == len({(r.k, r.d) for r in seen})
    for r in seen:
        about = got[r.k, r.d].approx_count_distinct_v_7d
        assert abs(about - r.count_distinct_v_7d) <= 4 * FE.SKETCH_ERROR * r.count_distinct_v_7d + 1


def _leaves(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation [") + plan.count("LogicalRDD") + plan.count("LocalRelation")


def test_chain_of_steps_reads_its_source_twice(spark, scratch):
    rows, df = _events(spark)
    df.write.parquet(scratch + "/t")
    df = spark.read.parquet(scratch + "/t")
    specs = [FE.Rolling(["k"], "d", fn, ["v"], [size]) for size in (7, 3) for fn in ("sum", "avg", "max")]
    specs += [FE.BaseAgg(["avg", "stddev"], ["v"], ["k"], mode="attach")]
    out = FE.build_features(df, specs)
    assert _leaves(out) == 2
    one_by_one = df
    for spec in specs:
        one_by_one = spec.apply(one_by_one)
    assert out.columns == one_by_one.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, one_by_one.collect()))
    # rows of one day each: no join, one read; checked
    daily = df.groupBy("k", "d").agg(F.sum("v").alias("v"))
    specs = [FE.Rolling(["k"], "d", ["sum", "count", "stddev", "min", "count_distinct"], ["v"], [7, 2], one_row_per_day=flag) for flag in (True, False)]
    declared, plain = (FE.build_features(daily, [s]) for s in specs)
    assert sorted(map(str, declared.collect())) == sorted(map(str, plain.collect()))
    assert _leaves(FE.build_features(daily, [FE.Rolling(["k"], "d", "sum", ["v"], [7], one_row_per_day=True)])) == 1
    with pytest.raises(Exception, match="one_row_per_day"):
        FE.rolling_window_aggregations(df, ["k"], "d", "sum", ["v"], [7], one_row_per_day=True).collect()


def test_steps_of_several_keys_and_of_features(spark):
    rows, df = _events(spark)
    df = df.withColumn("g", F.lit("all"))
    specs = [FE.Rolling(["k"], "d", "sum", ["v"], [7]), FE.Rolling(["g"], "d", "sum", ["v"], [2]), FE.BaseAgg("max", ["v"], ["g"], mode="attach"),
             FE.BaseAgg("min", ["v"], mode="attach"), FE.Rolling(["k"], "d", "max", ["sum_v_7d"], [3]),
             FE.BaseAgg("avg", ["max_sum_v_7d_3d"], ["k"])]
    out = FE.build_features(df, specs[:5])
    one_by_one = df
    for spec in specs[:2]:
        one_by_one = spec.apply(one_by_one.drop("sum_v_2d"))
    assert out.columns == ["k", "d", "v", "g", "sum_v_7d", "sum_v_2d", "max_v", "min_v", "max_sum_v_7d_3d"]
    assert out.count() == len(rows) and out.filter("max_v <> 9 or min_v <> 0").count() == 0
    assert FE.build_features(df, specs).columns == ["k", "avg_max_sum_v_7d_3d"]
    with pytest.raises(ValueError, match="there already"):
        FE.build_features(out, specs[:1])


def test_group_attach_global(spark):
    rows, df = _events(spark)
    g = {r.k: r.avg_v for r in FE.base_aggregations(df, "avg", ["v"], ["k"]).collect()}
    for k in g:
        vals = [v for kk, _, v in rows if kk == k]
        assert g[k] == _round2(sum(vals) / len(vals))
    att = FE.base_aggregations(df, "avg", ["v"], ["k"], mode="attach").collect()
    assert len(att) == len(rows) and all(r.avg_v == g[r.k] for r in att)
    glob = FE.base_aggregations(df, ["count", "max"], None, None).first()
    assert glob.count_rows == len(rows) and glob.max_v == max(v for *_, v in rows)
    one = FE.base_aggregations(df, "sum", ["v"], mode="attach").select("sum_v").distinct().collect()
    assert [r.sum_v for r in one] == [_round2(sum(v for *_, v in rows))]


def test_spec_chain_and_errors(spark):
    _, df = _events(spark)
    out = FE.build_features(df, [FE.Rolling(["k"], "d", "sum", ["v"], [7, 2]),
                                 FE.BaseAgg("avg", ["sum_v_7d"], ["k"], mode="attach")])
    assert {"sum_v_7d", "sum_v_2d", "avg_sum_v_7d"} <= set(out.columns)
    with pytest.raises(ValueError):
        FE.base_aggregations(df, "median", ["v"])
    with pytest.raises(ValueError):
        FE.rolling_window_aggregations(df, ["k"], "d", "sum", ["nope"], [7])


def test_daily_totals(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0, None), ("a", dt.date(2024, 1, 1), 2.0, 3.0)],
                               "k string, d date, x double, y double")
    r = FE.daily_totals(df, ["k"], "d", ["x", "y"]).first()
    assert (r.sum_x, r.sum_y, r.total_event_cnt) == (3.0, 3.0, 6.0)
