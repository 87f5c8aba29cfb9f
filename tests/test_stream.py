import json
import os

from pyspark.sql import functions as F

from casekit.streaming.transfer_stream import score_text_records, start_transfer_scoring
from fixtures import TRANSFERS


def test_stream_equals_batch(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    lines = [json.dumps(t) for t in TRANSFERS] + ['{"txn_id": "bad"', json.dumps(dict(TRANSFERS[0], txn_id=None))]
    for i in range(0, len(lines), 3):
        with open(os.path.join(src, f"part-{i}.json"), "w") as f:
            f.write("\n".join(lines[i:i + 3]) + "\n")
    out = os.path.join(scratch, "out")
    q1, q2 = start_transfer_scoring(spark, src, out, run_id="r", available_now=True)
    q1.awaitTermination(120)
    q2.awaitTermination(120)
    streamed = spark.read.parquet(os.path.join(out, "reports")).drop("created_at", "report_json")
    rejects = spark.read.parquet(os.path.join(out, "rejects"))
    batch, batch_rej = score_text_records(spark.read.text(src), run_id="r")
    batch = batch.drop("created_at", "report_json")
    assert sorted(streamed.collect()) == sorted(batch.select(*streamed.columns).collect())
    assert streamed.count() == 5 and rejects.count() == 2 == batch_rej.count()
    assert streamed.filter(F.col("txn_id") == "TX-3003").first().verdict == "REVIEW"


def test_stream_with_static_completions(spark, scratch):
    src = os.path.join(scratch, "in2")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write("\n".join(json.dumps(t) for t in TRANSFERS[:2]) + "\n")
    comp = spark.createDataFrame([("TX-3002", "investigator", "looks odd\nRECOMMENDATION: DECLINE")],
                                 "case_id string, step string, text string")
    out = os.path.join(scratch, "out2")
    q1, q2 = start_transfer_scoring(spark, src, out, completions=comp, run_id="r", available_now=True)
    q1.awaitTermination(120)
    q2.awaitTermination(120)
    got = {r.txn_id: r.verdict for r in spark.read.parquet(os.path.join(out, "reports")).collect()}
    assert got == {"TX-3001": "DECLINE", "TX-3002": "DECLINE"}
