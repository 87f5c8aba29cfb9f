"""Registered queries of this subpackage and their DuckDB oracles.

Every query runs its operator over its whole table and derives the digest
columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casekit.llm import (
    alignment, byte_bpe, chat_format, embed_dedup, html_extract, lm_score, minhash, mixing, packing, pii, quality, suffix_dedup,
    whitening,
)
from casekit.llm.common import read


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = pages.select("page_id", "url", html_extract.main_text("html", html_extract.fit(pages)).alias("m"))
    return found.select("page_id", "url", "m.text", F.length("m.text").cast("long").alias("n_chars"), "m.n_blocks")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)],
                                  "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(extra)))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe = byte_bpe.ByteBpe(spark)
    ids = read(spark, sf_dir, "documents").select("doc_id", bpe.encode("text").alias("ids"))
    both = ids.select("doc_id", "ids", bpe.decode("ids").alias("bytes"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(byte_bpe.ids_text(F.col("ids")), 256).alias("ids_sha256"),
                       F.sha2("bytes", 256).alias("decoded_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(read(spark, sf_dir, "documents")))


def op6_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read(spark, sf_dir, "documents"), width=4)
    return found.withColumnRenamed("id", "doc_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents")).select(*quality.DIGEST)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"))
    return packing.placements(packed).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (
    op1_html_extract,
    op2_lm_score,
    op3_chat_format,
    op4_byte_bpe,
    op5_pii,
    op6_embed_dedup,
    op7_minhash,
    op8_mixing,
    op9_suffix_dedup,
    op10_quality_rules,
    op11_whitening,
    op12_token_alignment,
    op13_best_fit_packing,
)}

ORACLE = {
    "op5_pii": pii.oracle_sql(),
    "op10_quality_rules": quality.oracle_sql(),
}
