"""Results stay whole and exact when one key holds a third of all rows."""
import datetime as dt

from pyspark.sql import functions as F

from casekit.operators import cases as C
from casekit.operators import features as FE


def test_hot_dimension_key(spark):
    # One customer id repeated in a third of the dimension rows: one row survives, chosen by order.
    rows = [(7, f"v{i:04d}") for i in range(300)] + [(i, "x") for i in range(600)]
    dim = spark.createDataFrame(rows, "customer_id long, val string")
    out = C.first_per_key(dim, "customer_id")
    assert out.count() == 600 and out.filter("customer_id = 7").first().val == "v0000"


def test_hot_key_rolling_pre_aggregated(spark):
    base = dt.date(2024, 1, 1)
    hot = [("hot", base + dt.timedelta(days=i % 10), 1.0) for i in range(3000)]
    cold = [(f"k{i}", base + dt.timedelta(days=i % 10), 2.0) for i in range(6000)]
    df = spark.createDataFrame(hot + cold, "k string, d date, v double")
    out = FE.rolling_window_aggregations(df, ["k"], "d", ["sum", "count"], ["v"], [3])
    assert out.count() == 9000  # every input row kept
    r = out.filter((F.col("k") == "hot") & (F.col("d") == base + dt.timedelta(days=5))).first()
    assert (r.sum_v_3d, r.count_v_3d) == (900.0, 900)  # days 3, 4, 5: 300 rows each
