"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.llm.common import store


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (id, component): every linked id with the smallest id
    it can reach.  Links may repeat and point either way.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its smallest one, then its smaller neighbours.  Minima are
    combined before the shuffle and joined back, so a node with very many
    neighbours is split like any skewed join key.  Each round is written to
    the shared folder; only a count and a checksum reach the driver.
    """
    edges = store(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                  "links")
    mark = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        least = store(least.select("n", F.least("n", "m").alias("m")), "links-min")
        large = store(both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .filter("a <> b").distinct(), "links-large")
        least = store(large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "links-min")
        small = large.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = store(small.filter("a <> b").union(least).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
