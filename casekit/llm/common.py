"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casekit.functions.workers import ship_with_tasks
from casekit.session import checkpoint_dir

# One definition of a word for every operator: a run of characters other than
# space, tab, line feed, vertical tab, form feed and carriage return.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"

ship_with_tasks(__name__)


def text_of(col: Column | str = "text") -> Column:
    """The text, a null text counting as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as an array (no word: empty array)."""
    return F.array_remove(F.split(text, GAP), "")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: whatever is lost later is read again from shared
    storage instead of being computed again.  The folder is the one the
    cluster names in ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete tables of :func:`store` that nothing reads any more."""
    for df in stored:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker process.

    Code shipped with tasks is unpickled once per task, so its own globals
    do not survive between tasks; this one does.
    """
    module = sys.modules.setdefault("_casekit_worker_cache", types.ModuleType("_casekit_worker_cache"))
    return module.__dict__.setdefault("items", {})


def sealed(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Append ``cols`` so that each is computed once per row.

    A plain projection may be merged into the ones above it, and a filter
    pushed below it, which repeats an expensive expression -- inside a lambda
    even once per element.  Columns made by a generator stay where they are.
    """
    row = F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in cols], F.inline_outer(F.array(row)))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps.

    The context cleaner deletes them when the driver's JVM collects their
    handles, which a long job with a quiet driver would wait long for.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
