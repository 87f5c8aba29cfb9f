"""Job D as one plan: documents -> chunks -> vectors -> top-k -> context.

The corpus is chunked and vectorised in one pass and scored by the exact
k-NN operator.  Chunk texts for the winners are recovered by re-cutting
only the documents that hold a winner (a left-semi join against the small
top-k id set), not by carrying every chunk text through the Python scorer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.operators import documents as DOC
from casekit.operators import vectors as VEC


def search_documents(documents: DataFrame, queries: DataFrame, k: int = DOC.TOP_K, dims: int = 64,
                     size: int = DOC.CHUNK_SIZE, overlap: int = DOC.CHUNK_OVERLAP,
                     query_id: str = "query_id", query_text: str = "text", chunks: str = "fixed") -> DataFrame:
    """``documents(doc_id, text)`` x ``queries(query_id, text)`` ->
    ``(query_id, context, top_chunks, best_score)``; context = the k best
    chunks joined by a blank line, best first (dot product of hashed term
    vectors).  ``chunks`` cuts documents at ``fixed`` offsets or at a
    ``boundary`` (blank line, line, word)."""
    cut = DOC.CHUNKERS[chunks]
    docs = documents.select("doc_id", "text")
    corpus = DOC.vectorize_chunks(cut(docs, size, overlap), dims).select("doc_id", "chunk_id", "vector")
    q = queries.select(F.col(query_id).alias("query_id"),
                       DOC.hashed_term_vector(F.col(query_text), dims).alias("vector"))
    top = VEC.similarity_search(q, corpus, k=k, item_cols=["doc_id", "chunk_id"], metric="dot")
    hit_docs = docs.join(top.select("doc_id").distinct(), "doc_id", "left_semi")
    ranked = top.join(cut(hit_docs, size, overlap), ["doc_id", "chunk_id"])
    name = lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["chunk_id"].cast("string"))
    out = DOC.assemble_context(ranked.select("query_id", "rank", "doc_id", "chunk_id", "chunk_text", "score"), also=[
        F.array_join(F.transform("__best", name), ",").alias("top_chunks"),
        F.array_max(F.transform("__best", lambda x: x["score"])).alias("best_score")])
    return out.withColumnRenamed("query_id", query_id)
