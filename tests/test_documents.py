import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casekit.operators import documents as DOC
from casekit.operators import vectors as VEC


def test_fixed_chunk_contract(spark):
    lens = [0, 1, 50, 100, 999, 1000, 1001, 1900, 1901, 5000, 12345]
    texts = [(i, "".join(chr(97 + (j * 7 + i) % 26) for j in range(n))) for i, n in enumerate(lens)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = DOC.chunk_documents(df).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, n in enumerate(lens):
        rows = sorted(by_doc.get(i, []), key=lambda r: r.chunk_id)
        expect = 0 if n == 0 else 1 + max(0, math.ceil((n - 1000) / 900))
        assert len(rows) == expect, n
        if not rows:
            continue
        text = texts[i][1]
        assert [r.start for r in rows] == [900 * k for k in range(expect)]
        assert all(r.chunk_text == text[r.start:r.start + 1000] for r in rows)
        assert rows[-1].start + len(rows[-1].chunk_text) == n


def _check_boundary(text, size, overlap):
    spans = DOC.boundary_spans(text, size, overlap)
    if not text.strip():
        assert spans == []
        return
    assert all(0 < e - s <= size for s, e in spans)
    for (s0, e0), (s1, e1) in zip(spans, spans[1:]):
        assert s0 < s1 and e0 < e1 and e0 - s1 <= overlap
        if s1 > e0:  # a gap may only hold whitespace-only chunks that were dropped
            assert not text[e0:s1].strip()
    covered = "".join(text[max(s, spans[i - 1][1] if i else 0):e] for i, (s, e) in enumerate(spans))
    assert "".join(covered.split()) == "".join(text.split())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab c\n")), max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_boundary_properties(text, size, overlap):
    _check_boundary(text, size, min(overlap, size - 1))


def test_boundary_prefers_blank_lines(spark):
    para = ["alpha " * 30, "beta " * 40, "gamma " * 25]
    text = "\n\n".join(p.strip() for p in para)
    spans = DOC.boundary_spans(text, 250, 20)
    assert all(text[e - 2:e] == "\n\n" or e == len(text) for _, e in spans)
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = DOC.chunk_documents_boundary(df, 250, 20).orderBy("chunk_id").collect()
    assert [(r.start, r.start + len(r.chunk_text)) for r in rows] == [tuple(s) for s in spans]


def _brute_knn(Q, C, k, metric, exclude_self_ids=None):
    res = {}
    for qi, q in enumerate(Q):
        if metric == "l2":
            sc = ((C - q) ** 2).sum(1)
            order = sorted(range(len(C)), key=lambda j: (sc[j], j))
        else:
            sc = C @ q
            order = sorted(range(len(C)), key=lambda j: (-sc[j], j))
        if exclude_self_ids is not None:
            order = [j for j in order if j != qi]
        res[qi] = order[:k]
    return res


@pytest.mark.parametrize("metric", ["l2", "dot"])
@pytest.mark.parametrize("blocks", [1, 3])
def test_knn_matches_brute_force(spark, metric, blocks):
    rnd = np.random.default_rng(7)
    C = rnd.integers(0, 4, size=(120, 5)).astype(float)  # small ints: many exact ties
    Q = C[:30]
    corpus = spark.createDataFrame([(i, C[i].tolist()) for i in range(len(C))], "item_id long, vector array<double>")
    queries = spark.createDataFrame([(i, Q[i].tolist()) for i in range(len(Q))], "query_id long, vector array<double>")
    out = VEC.similarity_search(queries, corpus, k=4, metric=metric, exclude_self=True,
                                query_blocks=blocks).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.item_id)
    assert got == _brute_knn(Q, C, 4, metric, exclude_self_ids=True)


def test_vectors_and_context(spark):
    chunks = spark.createDataFrame([(1, 0, "the cat sat on the mat"), (1, 1, "dogs bark loudly"),
                                    (2, 0, "the cat and the hat"), (3, 0, "")],
                                   "doc_id long, chunk_id int, chunk_text string")
    vecs = DOC.vectorize_chunks(chunks, dims=4096).collect()
    for r in vecs:
        norm = math.sqrt(sum(x * x for x in r.vector))
        assert len(r.vector) == 4096 and (abs(norm - 1) < 1e-12 or (norm == 0 and r.chunk_text == ""))
    q = spark.createDataFrame([(7, "a cat on a mat")], "t_id long, text string") \
        .select(F.col("t_id").alias("query_id"), DOC.hashed_term_vector(F.col("text"), 4096).alias("vector"))
    top = VEC.similarity_search(q, DOC.vectorize_chunks(chunks, 4096).drop("chunk_text"), k=2,
                                item_cols=["doc_id", "chunk_id"], metric="dot")
    ctx = DOC.assemble_context(top.join(chunks, ["doc_id", "chunk_id"])).first()
    assert ctx.context.split("\n\n")[0] == "the cat sat on the mat"


def test_tokens_of_every_language(spark):
    df = spark.createDataFrame([("Übergrößen, naïve ÉTÉ 東京 x2",)], "t string").select(DOC.term_buckets(F.col("t"), 1 << 31).alias("b"))
    assert len(set(df.first().b)) == 5


@pytest.mark.parametrize("size,overlap", [(7, 0), (7, 3), (7, 6), (10, 1)])
def test_fixed_chunks_of_code_points(spark, size, overlap):
    text = "añ\U0001f600bc\ndé fgh東i jklmnop"
    df = spark.createDataFrame([(n, text[:n]) for n in range(len(text) + 1)], "doc_id long, text string")
    got = {}
    for r in DOC.chunk_documents(df, size, overlap).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.chunk_text))
    for n in range(1, len(text) + 1):
        starts = range(0, max(n - overlap, 1), size - overlap)
        assert got[n] == [(s, text[:n][s:s + size]) for s in starts]


def test_search_by_chunk_mode(spark):
    from casekit.plans.search_flow import search_documents
    docs = spark.createDataFrame([(1, "red apples grow here.\n\nblue whales swim far.\n\n" * 2), (2, "green grass")],
                                 "doc_id long, text string")
    q = spark.createDataFrame([(5, "whales swim")], "query_id long, text string")
    r = search_documents(docs, q, k=1, dims=4096, size=24, overlap=0, chunks="boundary").first()
    assert r.context == "blue whales swim far.\n\n" and r.top_chunks == "1:1"
    assert "whales" in search_documents(docs, q, k=1, dims=4096, size=24, overlap=0).first().context


def test_knn_string_ids_and_cosine(spark):
    rnd = np.random.default_rng(11)
    C = rnd.normal(size=(60, 4))
    Q = rnd.normal(size=(7, 4))
    corpus = spark.createDataFrame([(f"c{i:03d}", C[i].tolist()) for i in range(len(C))],
                                   "item_id string, vector array<double>")
    queries = spark.createDataFrame([(f"q{i}", Q[i].tolist()) for i in range(len(Q))],
                                    "query_id string, vector array<double>")
    out = VEC.similarity_search(queries, corpus, k=3, metric="cosine", query_blocks=2, corpus_shards=3).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.item_id)
    Cn = C / np.linalg.norm(C, axis=1)[:, None]
    for i, q in enumerate(Q):
        sims = Cn @ (q / np.linalg.norm(q))
        want = [f"c{j:03d}" for j in sorted(range(len(C)), key=lambda j: (-sims[j], j))[:3]]
        assert got[f"q{i}"] == want


def test_knn_exactly_k_on_ties_and_non_finite(spark):
    nan, inf = float("nan"), float("inf")
    corpus = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(500)] + [(900, [nan, 1.0]), (901, [inf, 0.0]), (902, None)],
                                   "item_id long, vector array<double>")
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 2.0]), (3, [nan, 0.0]), (4, None)],
                                    "query_id long, vector array<double>")
    for metric in ("l2", "cosine", "dot"):
        rows = VEC.similarity_search(queries, corpus, k=3, metric=metric, corpus_shards=4).collect()
        got = {}
        for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append(r.item_id)
        assert got == {1: [0, 1, 2], 2: [0, 1, 2]}, metric
    few = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [nan]), (4, [nan])], "item_id long, vector array<double>")
    q = spark.createDataFrame([(1, [0.0])], "query_id long, vector array<double>")
    assert [r.item_id for r in VEC.similarity_search(q, few, k=3).orderBy("rank").collect()] == [1, 2]
