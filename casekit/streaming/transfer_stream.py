"""On-demand transfer scoring as a Structured Streaming job.

JSON lines arriving in a folder are parsed, validated and scored with the
same functions as the batch job; reports and rejects are appended to two
sinks.  Scoring is stateless (each record is judged alone), so the query
needs no watermark; a static completions table may be left-joined per
micro-batch.  Progress lives under the session's ``spark.checkpoint.dir``
(a shared folder on a cluster), so a restarted or failed query resumes
without duplicating output.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casekit.operators import transfers as TR
from casekit.plans.transfer_flow import score_transfers
from casekit.session import checkpoint_dir
from casekit.sources.adapters import parse_transfer_text

REPORT_COLUMNS = ["case_id", "txn_id", "created_at", "verdict", "decision_score", "sla_priority",
                  "ml_score", "rule_score", "summary"]


def score_text_records(raw: DataFrame, completions: DataFrame | None = None, run_id: str = "",
                       created_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``raw(value)`` JSON lines (batch or stream) -> (reports, rejects)."""
    parsed = parse_transfer_text(raw.select("value"))
    valid, rejected = TR.validate_transfers(parsed)
    scored = score_transfers(valid, completions, run_id=run_id, created_at=created_at)
    reports = scored.select(*REPORT_COLUMNS,
                            F.to_json("report", {"ignoreNullFields": "false"}).alias("report_json"))
    rejects = rejected.select("txn_id", F.array_join("reject_reasons", "; ").alias("reject_reasons"))
    return reports, rejects


def read_text_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(source_dir)


def start_transfer_scoring(spark: SparkSession, source_dir: str, output_dir: str,
                           completions: DataFrame | None = None, run_id: str = "",
                           available_now: bool = False, name: str = "transfer_scoring",
                           checkpoint_location: str | None = None,
                           ) -> tuple[StreamingQuery, StreamingQuery]:
    """Start the two append queries (reports, rejects) writing parquet.

    Progress is kept per (source, sink) pair -- by default under the
    session's checkpoint folder, keyed by both paths -- so restarting the
    same job resumes it and a different job never picks up its offsets.
    """
    reports, rejects = score_text_records(read_text_stream(spark, source_dir), completions, run_id)
    job = hashlib.sha1(f"{source_dir}|{output_dir}".encode()).hexdigest()[:16]
    ckpt = checkpoint_location or os.path.join(checkpoint_dir(spark), name, job)
    queries = []
    for label, df in (("reports", reports), ("rejects", rejects)):
        w = (df.writeStream.format("parquet").outputMode("append")
             .option("path", os.path.join(output_dir, label))
             .option("checkpointLocation", os.path.join(ckpt, label))
             .queryName(f"{name}_{label}"))
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
        queries.append(w.start())
    return queries[0], queries[1]
