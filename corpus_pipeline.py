"""The corpus pipeline: raw documents to token ids.

Five stages, each one operator of :mod:`casekit.llm`, in the order of
``STAGES``.  A stage takes ``(spark, docs, sf_dir)`` and returns the documents
it keeps, with the columns it was given (the last one returns token ids);
:func:`run` writes every stage's result to the shared checkpoint folder and
reads it back, so a lost executor never costs more than the current stage.

Defined results: null and blank texts fail the quality rules and go.  Null ids
are kept and name no group of copies.  Rows repeated under one id are one
document, of which the near-duplicate stage leaves one row.  After mixing a
document stands there as many times as the mix takes it.  An empty table goes
through every stage and stays empty; extra columns are carried along up to the
last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casekit.llm import byte_bpe, minhash, mixing, pii, quality
from casekit.llm.common import read, store

# No SQL: the near-duplicate sketches and the knapsack have none.
ORACLE_SQL = None


def _with_text(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The given columns, with another text and its length."""
    new = {"text": F.col(text)} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in columns else {})
    return docs.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns])


def _set_apart(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """Rename columns that an operator's results would replace, and how to
    name them back."""
    back = {f"_own_{c}": c for c in names if c in docs.columns}
    return docs.withColumnsRenamed({c: own for own, c in back.items()}), back


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop failing lines, then documents that fail or lose too much."""
    own, back = _set_apart(docs, *quality.ADDED)
    judged = quality.quality_rules(own).filter("kept")
    return _with_text(judged, "clean_text", own.columns).withColumnsRenamed(back)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8)."""
    found = store(minhash.near_duplicates(docs), "pipeline-groups")
    # One row per id, null included: whether it stays, and how many rows carry it.
    rows = F.when(F.col("_id").isNull(), F.lit(1)).otherwise(F.count(F.lit(1)))
    verdict = found.groupBy(F.col("id").alias("_id")).agg(F.max("kept").alias("_kept"), rows.alias("_rows"))
    # Texts are shuffled to their verdicts, at every size.
    stay = docs.join(verdict.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id"))).filter("_kept")
    # Ids that several rows carry, normally none: one row of each stays.
    once = stay.filter("_rows = 1").select(*docs.columns)
    return once.unionByName(stay.filter("_rows > 1").select(*docs.columns).dropDuplicates(["doc_id"]))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts."""
    own, back = _set_apart(docs, "pii")
    return _with_text(pii.redact(pii.find_pii(own)), "text", own.columns).withColumnsRenamed(back)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    own, back = _set_apart(docs, *mixing.ADDED)
    mixed = mixing.mix(own).filter("copies > 0")
    copies = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return copies.select(*own.columns).withColumnsRenamed(back)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of the text decoded from them."""
    bpe = byte_bpe.ByteBpe(spark)
    ids = docs.select("doc_id", "lang", "source", bpe.encode("text").alias("ids"))
    both = ids.select("*", bpe.decode("ids").alias("bytes"))
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       F.sha2(byte_bpe.ids_text(F.col("ids")), 256).alias("ids_sha256"),
                       F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
