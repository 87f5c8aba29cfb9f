"""Keep CPU-heavy row work spread over the cluster's cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

INPUT_PARTITIONS = "spark.casekit.inputPartitions"


def spread(df: DataFrame) -> DataFrame:
    """Round-robin ``df`` over as many partitions as the session setting
    ``spark.casekit.inputPartitions`` says; unset (the default) leaves it as it
    is.  Meant for inputs of few file splits, such as one-row-group test
    files; nothing is run to find out.  Round-robin repartitioning sorts
    locally first, so a retried task gets the same rows.
    """
    n = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(n)) if n else df
