"""Writers for case outputs (distributed writes; nothing is collected)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casekit.operators.cases import py_float_text
from casekit.operators.transfers import report_json


def write_case_reports(scored: DataFrame, path: str, fmt: str = "json", mode: str = "append") -> None:
    """Full transfer case reports: JSON lines (``report_json`` text per case)
    or parquet with the nested report struct."""
    if fmt == "json":
        report_json(scored).select("report_json").write.mode(mode).text(path)
    elif fmt == "parquet":
        scored.select("case_id", "txn_id", "report").write.mode(mode).parquet(path)
    else:
        raise ValueError("fmt must be json or parquet")


def case_listing(cases: DataFrame) -> DataFrame:
    """Per payment case: id, decision, score (as Python prints it), rule hits and notes."""
    return cases.select(F.col("txn_id").alias("case_id"), "decision",
                        py_float_text(F.col("model_score")).alias("model_score"),
                        F.array_join("rule_hits", ",").alias("rule_hits"), "investigation_notes")


def write_case_listing(cases: DataFrame, path: str, mode: str = "append") -> None:
    case_listing(cases).write.mode(mode).parquet(path)


# ------------------------------------------------------ S4 as a stream --
def start_report_sink(reports: DataFrame, path: str, checkpoint: str, available_now: bool = False,
                      name: str = "case_reports") -> StreamingQuery:
    """Append a stream of case reports to ``path`` exactly once.

    A micro-batch is written to a folder of its own number and replaces
    whatever an earlier attempt left there.  A batch that Spark repeats after a
    failure (written, but not yet committed) thus leaves one copy.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = reports.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime="5 seconds")).start()


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """All reports of :func:`start_report_sink` (``batch``: the micro-batch)."""
    return spark.read.parquet(path)
