"""The pruned vector index and the posting lists find what a full search finds."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from casekit.operators import documents as DOC
from casekit.operators import terms as TERMS
from casekit.operators import vector_index as IDX
from casekit.operators import vectors as VEC


def _clusters(seed, n=900, dims=8, centres=30):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims)) * 8
    x = c[rng.integers(0, centres, n)] + rng.normal(size=(n, dims)) * 0.3
    x[: n // 3] = c[0] + rng.normal(size=(n // 3, dims)) * 0.2   # a hot region
    x[:40] = c[0]                                                # repeated vectors: ties
    return x


def _frame(spark, x, extra=()):
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "item_id long, vector array<double>")


def _rows(df):
    return sorted((r.query_id, r["rank"], r.item_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_index_search_is_exact_and_skips_cells(spark, monkeypatch, metric, exclude_self):
    monkeypatch.setattr(IDX, "ROWS_PER_SHARD", 64)       # cells in shards
    monkeypatch.setattr(IDX, "QUERIES_PER_BLOCK", 50)    # and queries in blocks
    x = _clusters(3)
    df = _frame(spark, x)
    index = IDX.build_index(df, metric=metric)
    q = df.withColumnRenamed("item_id", "query_id")
    got = IDX.index_search(index, q, k=4, exclude_self=exclude_self)
    want = VEC.similarity_search(q, df, k=4, metric=metric, exclude_self=exclude_self)
    if metric == "l2":
        assert _rows(got) == _rows(want)
    else:  # distances of unit vectors and cosines round differently: equal scores, ranks apart from their ties
        score = lambda df: sorted((r.query_id, r["rank"], round(r.score, 7)) for r in df.collect())
        assert score(got) == score(want)
    share = IDX.cells_scored(index, q, k=4, exclude_self=exclude_self).agg(F.sum("n_scored") / F.sum("n_cells")).first()[0]
    assert share < 0.25


def test_index_without_structure_is_still_exact(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, size=(300, 6)).astype(float)
    df, q = _frame(spark, x), _frame(spark, rng.integers(-1, 4, size=(80, 6)).astype(float)).withColumnRenamed("item_id", "query_id")
    assert _rows(IDX.index_search(IDX.build_index(df, n_cells=25), q, k=7)) == _rows(VEC.similarity_search(q, df, k=7))


def test_index_defined_results(spark):
    bad = [(500, None), (501, []), (502, [float("nan")] * 3), (503, [1.0, None, 2.0]), (504, [float("inf"), 0.0, 0.0])]
    x = np.arange(12, dtype=float).reshape(4, 3)
    df = _frame(spark, x, bad)
    index = IDX.build_index(df)
    q = df.withColumnRenamed("item_id", "query_id")
    got = IDX.index_search(index, q, k=9).collect()
    assert {r.query_id for r in got} == {0, 1, 2, 3} == {r.item_id for r in got} and len(got) == 16  # fewer than k
    empty = IDX.build_index(df.limit(0))
    assert IDX.index_search(empty, q, k=2).collect() == []
    assert IDX.index_search(index, q.limit(0), k=2).collect() == []
    with pytest.raises(ValueError, match="length"):
        IDX.build_index(_frame(spark, x, [(9, [1.0])]))
    with pytest.raises(ValueError, match="metric"):
        IDX.build_index(df, metric="dot")


def test_cells_grow_in_number_with_the_queries(spark, monkeypatch):
    monkeypatch.setattr(VEC, "QUERIES_PER_BLOCK", 20)
    rng = np.random.default_rng(9)
    df = _frame(spark, rng.normal(size=(200, 4)))
    q = df.withColumnRenamed("item_id", "query_id")
    out = VEC.similarity_search(q, df, k=3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [__b" in plan and ", 10" in plan.split("RepartitionByExpression")[1].split("\n")[0]
    assert _rows(out) == _rows(VEC.similarity_search(q, df, k=3, query_blocks=1, corpus_shards=1))


def test_all_zero_queries_tie_everywhere(spark):
    x = np.array([[1.0, 2.0], [0.0, 0.0], [3.0, -1.0], [0.0, 0.0], [5.0, 5.0]])
    df = _frame(spark, x)
    q = df.filter("item_id in (1, 3)").withColumnRenamed("item_id", "query_id")
    got = VEC.similarity_search(q, df, k=3, metric="dot", exclude_self=True)
    assert [(r[0], r[2]) for r in _rows(got)] == [(1, 0), (1, 2), (1, 3), (3, 0), (3, 1), (3, 2)]


def _l2(x, q, k, exclude_self=True):
    out = []
    for i in q:
        d = ((x - x[i]) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i or not exclude_self][:k]
        out += [(i, n, int(j), round(d[j], 9)) for n, j in enumerate(order, 1)]
    return sorted(out)


@pytest.mark.parametrize("move,scale", [(0, 1), (1e6, 1e-3), (0, 1e-15)])
def test_distances_are_computed_for_near_pairs_only(spark, monkeypatch, move, scale):
    monkeypatch.setattr(VEC, "_scores", lambda *args: 1 / 0)  # scores all pairs one by one
    monkeypatch.setattr(VEC, "_BATCH_ROWS", 100)
    monkeypatch.setattr(VEC, "_FIRST_ROWS", 30)
    rng = np.random.default_rng(21)
    x = rng.normal(size=(500, 12))
    x[100:140], x[300:350] = x[3], x[100]                       # copies
    x[400:450] = x[400] + rng.normal(size=(50, 12)) * 1e-5      # closer than single precision tells
    x = x * scale + move
    df = _frame(spark, x, [(900, None), (901, [float("nan")] * 12), (902, [float("inf")] + [0.0] * 11), (903, [None] * 12)])
    q = df.withColumnRenamed("item_id", "query_id")
    for blocks, shards in ((1, 1), (3, 2)):
        got = VEC.similarity_search(q, df, k=3, exclude_self=True, query_blocks=blocks, corpus_shards=shards)
        ids = {}
        for r in got.collect():
            ids.setdefault(r.query_id, {})[r["rank"]] = r.item_id
        assert {(i, n, j) for i, n, j, _ in _l2(x, range(500), 3)} == {(i, n, j) for i, g in ids.items() for n, j in g.items()}


def test_distances_beyond_single_precision(spark):
    x = np.random.default_rng(22).normal(size=(60, 4)) * 1e30
    df = _frame(spark, x)
    got = VEC.similarity_search(df.withColumnRenamed("item_id", "query_id"), df, k=4, exclude_self=True)
    assert [(r[0], r[1], r[2]) for r in _rows(got)] == [r[:3] for r in _l2(x, range(60), 4)]


def test_copies_of_an_id_do_not_hide_others(spark):
    rows = [(5, [1.0, 1.0])] * 9 + [(6, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "item_id long, vector array<double>")
    q = df.filter("item_id = 5").distinct().withColumnRenamed("item_id", "query_id")
    got = VEC.similarity_search(q, df, k=3, exclude_self=True)
    assert [r[2] for r in _rows(got)] == [6, 7, 8]


def test_vectors_that_are_not_finite_are_not_dealt_out(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(VEC, "search_cells", lambda q, c, *a, real=VEC.search_cells: dealt.append((q.count(), c.count())) or real(q, c, *a))
    nan = float("nan")
    df = _frame(spark, np.arange(8.0).reshape(4, 2), [(10 + i, [nan, 1.0]) for i in range(20)])
    q = df.withColumnRenamed("item_id", "query_id")
    assert len(VEC.similarity_search(q, df, k=2, query_blocks=1, corpus_shards=1).collect()) == 8
    assert dealt == [(4, 4)]


def test_index_search_deals_rows_to_blocks_not_to_pairs(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(IDX, "search_cells", lambda q, c, *a, real=IDX.search_cells: dealt.append((q.count(), c.count())) or real(q, c, *a))
    x = np.random.default_rng(23).normal(size=(400, 16))  # no structure: next to nothing can be left out
    df = _frame(spark, x)
    q = df.withColumnRenamed("item_id", "query_id")
    index = IDX.build_index(df, n_cells=40)
    got = IDX.index_search(index, q, k=3, exclude_self=True)
    assert [r[:3] for r in _rows(got)] == [r[:3] for r in _l2(x, range(400), 3)]
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt[-1][0] == 400 * shards and dealt[-1][1] <= 400  # one block


# --------------------------------------------------------- weighted terms --
def _texts(seed, n=250):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        words = [vocab[min(int(rng.paretovariate(0.6)), 120) - 1] for _ in range(rng.randint(0, 40))]
        rows.append((i, " ".join(words + ["The"] * rng.randint(0, 3))))
    return rows + [(n, None), (n + 1, ""), (n + 2, "  ,, "), (n + 3, rows[1][1]), (n + 4, rows[1][1])]


def _brute_vectors(rows):
    import re
    from collections import Counter
    counts = {i: Counter(w for w in re.split(r"[^\w]+", (t or "").lower()) if w) for i, t in rows}
    df = Counter(w for c in counts.values() for w in c)
    idf = {w: math.log((1 + len(rows)) / (1 + n)) + 1 for w, n in df.items()}
    return counts, idf


def _unit(c, idf):
    v = {w: n * idf[w] for w, n in c.items() if w in idf}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {w: x / norm for w, x in v.items()}


def test_tfidf_against_brute_force(spark):
    rows = _texts(1)
    df = spark.createDataFrame(rows, "id long, text string")
    counts, idf = _brute_vectors(rows)
    got = {r.id: {x.term: x.weight for x in r.vector} for r in TERMS.tfidf(df, ["id"]).vectors.collect()}
    want = {i: _unit(c, idf) for i, c in counts.items() if c}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i].keys() == want[i].keys() and all(math.isclose(got[i][w], want[i][w], rel_tol=1e-12) for w in want[i])


@pytest.mark.parametrize("block_rows", [10, 1 << 16])
def test_postings_search_equals_scoring_everything(spark, block_rows):
    rows = _texts(2)
    df = spark.createDataFrame(rows, "id long, text string")
    queries = [(i, rows[i][1]) for i in range(0, 60)] + [(900, "the"), (901, "unknown words"), (902, None), (903, "w0 the zzz"), (904, "w99 w100 the the w1")]
    q = spark.createDataFrame(queries, "query_id long, text string")
    index = TERMS.build_postings(df, ["id"], block_rows=block_rows)
    got = {}
    for r in TERMS.search_postings(index, q, k=5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, round(r.score, 7))
    counts, idf = _brute_vectors(rows)
    vectors = {i: _unit(c, idf) for i, c in counts.items() if c}
    for i, text in queries:
        c, _ = _brute_vectors([(i, text)])
        known = {w: n for w, n in c[i].items() if w in idf}
        if not known:
            assert i not in got
            continue
        v = _unit(known, idf)
        scores = {j: sum(x * v.get(w, 0) for w, x in u.items()) for j, u in vectors.items() if set(u) & set(v)}
        best = sorted(scores.items(), key=lambda s: (-round(s[1], 9), s[0]))[:5]
        assert got[i] == {n: (j, round(s, 7)) for n, (j, s) in enumerate(best, 1)}


def test_postings_of_empty_tables(spark):
    df = spark.createDataFrame([], "id long, text string")
    index = TERMS.build_postings(df, ["id"])
    q = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert TERMS.search_postings(index, q).collect() == []
    full = TERMS.build_postings(spark.createDataFrame([(1, "a b")], "id long, text string"), ["id"])
    assert TERMS.search_postings(full, q.limit(0)).collect() == []


def test_texts_of_many_queries_are_scored_once(spark, monkeypatch):
    """A text goes to tasks once per block of queries, not once per query that shares a word."""
    dealt = []
    real = TERMS._scored
    monkeypatch.setattr(TERMS, "_scored", lambda index, texts, *a: dealt.append(texts.count()) or real(index, texts, *a))
    monkeypatch.setattr(TERMS, "_CELLS", 50)
    monkeypatch.setattr(TERMS, "QUERIES_PER_BLOCK", 25)
    texts = [(i, f"all of them say w{i % 7} w{i % 7} and {'same words here' if i % 3 else i}") for i in range(90)] + [(None, "w1 w1 w1")]
    index = TERMS.build_postings(spark.createDataFrame(texts, "id long, text string"), ["id"])
    q = spark.createDataFrame([(i, f"all say w{i % 7} same") for i in range(60)], "query_id long, text string")
    got = {}
    for r in TERMS.search_postings(index, q, k=3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    counts, idf = _brute_vectors(texts)
    vectors = {i: _unit(c, idf) for i, c in counts.items() if i is not None}
    for i in range(60):
        v = _unit(_brute_vectors([(0, f"all say w{i % 7} same")])[0][0], idf)
        score = {j: round(sum(x * v.get(w, 0) for w, x in u.items()), 9) for j, u in vectors.items()}
        assert got[i] == dict(enumerate(sorted(score, key=lambda j: (-score[j], j))[:3], 1))
    assert max(dealt) <= len(texts)


def test_tfidf_joins_terms_of_groups_not_of_texts(spark, monkeypatch, scratch):
    monkeypatch.setattr(TERMS, "GROUP_ROWS", 40)
    rows = _texts(5)
    counts, idf = _brute_vectors(rows)
    out = TERMS.tfidf(spark.createDataFrame(rows, "id long, text string"), ["id"], path=f"{scratch}/counts")
    got = {r.id: [(x.term, x.weight) for x in r.vector] for r in out.vectors.collect()}
    want = {i: sorted(_unit(c, idf).items()) for i, c in counts.items() if c}
    assert got.keys() == want.keys()
    for i in want:
        assert [t for t, _ in got[i]] == [t for t, _ in want[i]] and np.allclose([w for _, w in got[i]], [w for _, w in want[i]], rtol=1e-12)
    kept = spark.read.parquet(f"{scratch}/counts")
    assert kept.count() == len(rows) and kept.groupBy("__g").count().agg(F.max("count")).first()[0] <= 40


def test_postings_are_never_one_row_per_text_and_term(spark, scratch, monkeypatch):
    """What is written, and what the tables take on disk, follows the groups' terms and packed lists."""
    monkeypatch.setattr(TERMS, "GROUP_ROWS", 700)
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=90))) for i in range(2000)]
    pairs = sum(len(set(t.split())) for _, t in rows)
    index = TERMS.build_postings(spark.createDataFrame(rows, "id long, text string").repartition(1), ["id"], path=f"{scratch}/index")
    tables = {p.name: spark.read.parquet(str(p)) for p in Path(f"{scratch}/index").iterdir()}
    assert max(t.count() for t in tables.values()) <= len(rows) + 3 * len(words) < pairs / 20
    taken = sum(f.stat().st_size for f in Path(f"{scratch}/index").rglob("*.parquet"))
    assert taken < 2.5 * sum(len(t) for _, t in rows)
    assert index.postings.agg(F.sum(F.size("__places"))).first()[0] == pairs == index.vectors.agg(F.sum(F.size("vector"))).first()[0]
    assert tables["counts"].agg(F.max("__i")).first()[0] == 699


@pytest.mark.parametrize("words, per_block", [(1 << 22, 4096), (50, 1)])
def test_postings_ties_over_groups_go_by_keys(spark, monkeypatch, words, per_block):
    """Copies in many groups, text keys with nulls, repeated keys, and blocks without a query."""
    monkeypatch.setattr(TERMS, "GROUP_ROWS", 7)
    monkeypatch.setattr(TERMS, "GROUP_WORDS", words)
    monkeypatch.setattr(TERMS, "QUERIES_PER_BLOCK", per_block)
    monkeypatch.setattr(TERMS, "_CELLS", 30)
    rng = random.Random(8)
    texts = ["same words here", "same words there", "other w1 w1 same", "w2 w2 w2 words", "and w3", ""]
    rows = [(f"{rng.choice(['a', 'B', 'é', '10', '9'])}{i}", i % 3, rng.choice(texts)) for i in range(80)]
    rows += [(None, 1, texts[0]), ("a", None, texts[0]), ("a", 1, "same words"), ("a", 1, "here here")]
    df = spark.createDataFrame(rows, "name string, part int, text string").repartition(3)
    index = TERMS.build_postings(df, ["name", "part"], block_rows=3)
    got = {}
    asked = {1: "same words", 2: "words w2", 3: "here", 4: "w1 other and", 5: "nothing"}
    q = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    for r in TERMS.search_postings(index, q, k=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.name, r.part))
    merged = {}
    for name, part, text in rows:
        merged.setdefault((name, part), []).append(text)
    counts, _ = _brute_vectors([(key, " ".join(t)) for key, t in merged.items()])
    df = {}
    for c in counts.values():
        for w in c:
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((1 + len(rows)) / (1 + n)) + 1 for w, n in df.items()}
    vectors = {key: _unit(c, idf) for key, c in counts.items() if c and None not in key}
    for i, text in asked.items():
        v = _unit({w: n for w, n in _brute_vectors([(0, text)])[0][0].items() if w in idf}, idf) if i != 5 else {}
        score = {key: round(sum(x * u.get(w, 0) for w, x in v.items()), 9) for key, u in vectors.items() if set(u) & set(v)}
        best = sorted(score, key=lambda key: (-score[key], key[0].encode(), key[1]))[:4]
        assert sorted(got.get(i, [])) == [(n, *key) for n, key in enumerate(best, 1)]


def test_tfidf_rows_of_one_key_are_one_text(spark):
    rows = [(1, "a b"), (1, "b c"), (2, "c"), (None, "a"), (None, "d"), (3, None)]
    out = TERMS.tfidf(spark.createDataFrame(rows, "id long, text string"), ["id"])
    idf = {w: math.log(7 / (1 + n)) + 1 for w, n in {"a": 2, "b": 1, "c": 2, "d": 1}.items()}
    want = {1: {"a": 1, "b": 2, "c": 1}, 2: {"c": 1}, None: {"a": 1, "d": 1}}
    got = {r.id: {x.term: round(x.weight, 12) for x in r.vector} for r in out.vectors.collect()}
    assert got == {i: {w: round(x, 12) for w, x in _unit(c, idf).items()} for i, c in want.items()}


# --------------------------------------------------------------- the cut --
def test_boundary_oracle_computes_the_cut(spark):
    """The SQL twin cuts like the library, and differs when a rule is changed."""
    import duckdb
    import pandas as pd
    from casekit.plans import catalog
    rng = random.Random(4)
    texts = ["".join(rng.choice(["word ", "longerword ", "x" * rng.randint(1, 30), "\n", "\n\n", "\n\n\n", "  "]) for _ in range(rng.randint(1, 90)))
             for _ in range(60)] + ["", None, " \n ", "y" * 130, "a b", "\n\n" * 70]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    sql = lambda size, overlap: sorted(con.execute(
        f"WITH RECURSIVE {catalog._boundary_ctes(size, overlap)} SELECT doc_id, chunk_id, start, chunk_text FROM c").fetchall())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((50, 10), (20, 0), (40, 39)):
        got = sorted(tuple(r) for r in DOC.chunk_documents_boundary(df, size, overlap).collect())
        assert got == sql(size, overlap)
        assert got != sql(size + 1, overlap)
    assert sorted(tuple(r) for r in DOC.chunk_documents_boundary(df, 50, 11).collect()) != sql(50, 10)
