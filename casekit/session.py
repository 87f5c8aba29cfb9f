"""Spark session helpers.

Cluster settings (executor count, memory, ``spark.checkpoint.dir``) come from
the deployment; these helpers only fill in what a job needs when a setting is
missing, so the same code runs on ``local[N]`` in tests and on a cluster.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  AQE re-plans joins (broadcast vs sort-merge)
# from runtime sizes, coalesces small shuffle partitions and splits skewed
# ones; the session time zone is pinned so date/time text is reproducible.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Wide projections (the rule and scoring chains) make generated methods of more
# than 8,000 bytes of bytecode, which HotSpot by default leaves interpreted.
# Local sessions compile them; on a cluster the deployment adds the flag to
# spark.driver.extraJavaOptions and spark.executor.extraJavaOptions.
COMPILE_LARGE_METHODS = "-XX:-DontCompileHugeMethods"


def get_session(master: str | None = None, app_name: str = "casekit",
                shuffle_partitions: int | None = None,
                extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Return the active session or build one with :data:`DEFAULT_CONF`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf["spark.driver.extraJavaOptions"] = COMPILE_LARGE_METHODS
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder for checkpoints and stream state.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/object store)
    folder and is used as is.  Where it is unset, ``fallback`` is registered;
    without one a local master gets a fresh scratch folder, and any other
    master an error, because its driver's disk is not shared.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if not fallback and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = fallback or tempfile.mkdtemp(prefix="casekit-ckpt-")
    if "://" not in path:
        os.makedirs(path, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path
