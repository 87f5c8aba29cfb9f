"""Worker code must run where the package is not installed."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})   # the driver's path only; workers start from an empty folder
import __spark_entry__ as E
from casekit.session import get_session
spark = get_session("local[4]", shuffle_partitions=4)
def probe(batches):
    import importlib.util
    for b in batches:
        b["found"] = importlib.util.find_spec("casekit") is not None
        yield b
assert not spark.range(1).selectExpr("id", "false found").mapInPandas(probe, "id long, found boolean").first().found
for name, query in E.queries().items():
    if name.startswith({prefix!r}) or not {prefix!r} and not (name.startswith("op") or name == "pipeline"):
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
print("all ran")
"""


def run_without_package(prefix, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, prefix=prefix)], cwd=folder, env=env,
                          capture_output=True, text=True, timeout=900)
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_queries_run_without_the_package_on_workers(scratch):
    run_without_package("", scratch)
