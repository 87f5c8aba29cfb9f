"""HTML extraction, language-model scores, mixing and the pipeline."""

import collections
import itertools
import math
import random
import textwrap
import tracemalloc
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from casekit.llm import attention, html_extract, html_tree, lm_score, mixing


def page(body, article=True, extra=""):
    tag = "article" if article else "div"
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
            f"<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>More</a></li></ul></nav><div class=\"ad\">Buy this now.</div>"
            f"<{tag}>{body}</{tag}>{extra}<footer>&copy; someone</footer></body></html>")


def training_pages(n=60):
    rng = random.Random(0)
    words = lambda k: " ".join(rng.choice("this that some of the other words here and there".split()) for _ in range(k)).capitalize()
    return [page(f"<h1>{words(4)}</h1>" + "".join(f"<p>{words(rng.randint(2, 60))}.</p>" for _ in range(rng.randint(1, 6))))
            for _ in range(n)]


def test_tree_is_lenient():
    t = html_tree.parse("<p>a<b>b</b>c<br>d<p>e &amp; f<ul><li>1<li>2</ul><script>x<y</script><!-- <p>z --><td>q\n <i>r</i>")
    assert [x for x in t.text if x] == ["abc d", "e & f", "1", "2", "q r"]
    for broken in ("", "<", "<<<", "</p>", "<p class=\"a>b<p>c", "<!--", "<script>never ends", "a < b > c", "<div" * 50, "&#0;&bad;"):
        html_tree.parse(broken)
    assert len(html_tree.parse("<div>" * 20000 + "deep").tag) == 20002
    assert [x for x in html_tree.parse("<a \"" * 20000 + "x").text if x] == []


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(1)
    parent = np.array([-1, 0, 0, 1, 1, 2])
    kind = np.array([0, 0, 1, 0, 2, 1])
    unary, pair = rng.normal(size=6), rng.normal(size=(3, 2, 2))
    forest = html_extract.Forest([parent, parent], np.tile(kind, 2))
    got, both = forest.marginals(np.tile(unary, 2), pair)
    total, one, joint = 0.0, np.zeros(6), np.zeros((6, 2, 2))
    for bits in range(64):
        y = [(bits >> i) & 1 for i in range(6)]
        w = math.exp(sum(u * v for u, v in zip(unary, y, strict=True)) + sum(pair[kind[i], y[parent[i]], y[i]] for i in range(1, 6)))
        total += w
        for i in range(6):
            one[i] += w * y[i]
            if i:
                joint[i, y[parent[i]], y[i]] += w
    assert np.allclose(got, np.tile(one / total, 2)) and np.allclose(both[7:12], joint[1:] / total)


def test_extraction(spark):
    weights = html_extract.train(training_pages())
    body = "<h1>Head &amp; line</h1><p>First\n paragraph, with <a href=x>a link</a> in it.</p><blockquote>Quoted words stand here.</blockquote><p>Last one.</p>"
    text = "Head & line First paragraph, with a link in it. Quoted words stand here. Last one."
    inner = ("<form><label>Mail</label><input><button>Send</button></form><aside>Related things to read.</aside>"
             "<div class=\"comments\"><h3>Comments</h3><p>I liked this one very much, thanks for it.</p></div>")
    around = ("<header><h1>Site</h1></header><div class=\"cookie-notice\">We use cookies to make this site better.</div>"
              "<aside><p>Sidebar text, long enough to be a sentence.</p></aside><div id=sidebar><p>Another one of these.</p></div>")
    pages = {1: page(body), 2: page(body + inner, extra=around), 3: page(body, article=False), 4: None, 5: "", 6: "<p>plain text only."}
    rows = spark.createDataFrame(list(pages.items()), "page_id long, html string")
    got = {r.page_id: r.m.text for r in rows.select("page_id", html_extract.main_text("html", weights).alias("m")).collect()}
    assert got == {1: text, 2: text, 3: text, 4: "", 5: "", 6: "plain text only."}


def test_extraction_of_rights_lines_and_clashing_columns(spark):
    weights = html_extract.train(training_pages())
    for line in ("Copyright 2024 Example", "(c) 2019 Example Inc.", "© Example", "Example 2024. All rights reserved."):
        hidden = page("<p>This one sentence is the text of the page, and it says so.</p>", article=False).replace(
            "<footer>&copy; someone</footer>", f"<div>{line}</div>")
        assert html_extract.extract([hidden], weights)[0][0] == "This one sentence is the text of the page, and it says so."
    law = "Lawyers met to discuss what the copyright of a photograph meant in 1998, and none of them agreed on it."
    assert html_extract.extract([page(f"<p>{law}</p><p>More of the same text follows here, as it should.</p>")], weights)[0][0].startswith(law)
    rows = spark.createDataFrame([(1, page("<p>Some text stands here, enough of it to count.</p>" * 4000), "mine", 7)],
                                 "page_id long, html string, text string, n_blocks int")
    fitted = html_extract.fit(rows, train_chars=1000)  # the page is too large to train on, and read whole
    got = rows.select("*", html_extract.main_text("html", weights).alias("m")).first()
    assert (got.text, got.n_blocks, got.m.n_blocks) == ("mine", 7, 4000)
    assert all(np.array_equal(a, b) for a, b in zip(fitted, html_extract.prior_weights(), strict=True))


def test_extraction_accuracy_on_held_out_pages():
    pages = training_pages(90)
    weights = html_extract.train(pages[:60])
    for p in pages[60:]:
        want = " ".join(t for t, y in zip(html_tree.parse(p).text, html_extract.labels(html_tree.parse(p)), strict=True) if t and y)
        assert html_extract.extract([p], weights)[0][0] == want
        hidden = p.replace("article>", "div>").replace("<nav>", "<div>").replace("</nav>", "</div>").replace(' class="ad"', "")
        assert html_extract.extract([hidden], weights)[0][0] == want
    prior = html_extract.train(["<p>no marks"])
    assert html_extract.extract([pages[0]], prior)[0][1] > 0


def test_extraction_empty_table(spark):
    rows = spark.createDataFrame([], "page_id long, html string")
    weights = html_extract.fit(rows)
    assert rows.select(html_extract.main_text("html", weights).alias("m")).collect() == []


def test_attention_gradient_and_windows():
    rng = np.random.default_rng(2)
    p = {k: v.astype(np.float64) for k, v in attention.initial(rng.integers(1, 99, attention.SLOTS)).items()}
    ids, targets = attention.windows(rng.integers(0, attention.SLOTS, 71))
    assert ids.shape == (3, attention.WINDOW) and (targets != attention.PAD).sum() == 70
    mean, g = attention.gradients(p, ids, targets)
    total = lambda q: attention.log_probs(q, ids, targets).sum()
    assert np.isclose(mean * 70, total(p))
    for key in p:
        at = (int(ids[1, 20]), 3) if key == "E" else tuple(int(rng.integers(0, s)) for s in p[key].shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[key][at] += 1e-5
        down[key][at] -= 1e-5
        assert np.isclose((total(up) - total(down)) / 2e-5 / 70, g[key][at], atol=1e-6)


def test_attention_is_a_distribution_and_causal():
    rng = np.random.default_rng(3)
    p = attention.initial(rng.integers(1, 99, attention.SLOTS))
    ids = np.tile(rng.integers(0, attention.SLOTS, attention.WINDOW), (attention.SLOTS, 1))
    targets = np.full((attention.SLOTS, attention.STRIDE), attention.PAD)
    targets[:, 5] = np.arange(attention.SLOTS)
    assert np.isclose(np.exp(attention.log_probs(p, ids, targets)[:, 5].astype(float)).sum(), 1, atol=1e-4)
    later = ids[:1].copy()
    later[0, attention.WINDOW - attention.STRIDE + 6:] = 1
    assert np.allclose(attention.log_probs(p, later, targets[:1])[0, 5], attention.log_probs(p, ids[:1], targets[:1])[0, 5])


def test_scoring_memory_does_not_follow_the_number_of_windows():
    rng = np.random.default_rng(4)
    p = attention.initial(rng.integers(1, 99, attention.SLOTS))
    ids, targets = attention.windows(rng.integers(0, attention.SLOTS, 4096 * attention.STRIDE))
    targets[::7, 3] = attention.PAD
    attention.log_probs(p, ids[:9], targets[:9])
    tracemalloc.start()
    got = attention.log_probs(p, ids, targets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < got.nbytes + (8 << 20)
    one = np.concatenate([attention.log_probs(p, ids[i:i + 1], targets[i:i + 1]) for i in range(200)])
    assert np.allclose(got[:200], one, atol=1e-5) and not got[::7, 3].any()


def test_large_logits_stay_finite():
    rng = np.random.default_rng(6)
    p = attention.initial(rng.integers(1, 99, attention.SLOTS))
    p = {k: v * np.float32(40) if k in ("E", "Wq", "Wk", "C", "O") else v for k, v in p.items()}
    ids, targets = attention.windows(rng.integers(0, attention.SLOTS, 300))
    mean, g = attention.gradients(p, ids, targets)
    assert np.isfinite(mean) and all(np.isfinite(x).all() for x in g.values())
    assert np.isfinite(attention.log_probs(p, ids, targets)).all()


def test_train_pass_is_adam_over_gradients():
    rng = np.random.default_rng(5)
    start = {k: v.astype(np.float64) for k, v in attention.initial(rng.integers(1, 99, attention.SLOTS)).items()}
    ids, targets = (x.astype(np.int16) for x in attention.windows(rng.integers(0, attention.SLOTS, 1700)))
    p, m, s = dict(start), dict.fromkeys(start, 0.0), dict.fromkeys(start, 0.0)
    for step, at in enumerate(range(0, len(ids), 8), 1):
        _, g = attention.gradients(p, ids[at:at + 8], targets[at:at + 8])
        for k in p:
            m[k], s[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * s[k] + 0.01 * g[k] ** 2
            p[k] = p[k] + 0.02 * min(1.0, step / 10) * m[k] / (1 - 0.9 ** step) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-6)
    got = attention.train_pass(start, ids, targets, 0.02, 8)
    assert all(got[k].shape == p[k].shape and np.allclose(got[k], p[k], atol=1e-5) for k in p)


def test_chunk_spells_words_whatever_ends_them():
    path = lm_score.public_tokenizers.path(lm_score.RANK_FILE)
    with open(path, "rb") as f:
        enc = lm_score.encoder(f.read(), lm_score.public_tokenizers.PATTERN)
    texts = ["", "one\ttwo\none\x0bthree's", " \r\n", "\xa0word \u00e9\u00e9  last", "one"]
    chunk = lm_score.Chunk([t.encode() for t in texts], enc)
    words = [w for t in texts for w in t.encode().split()]
    assert chunk.counts.tolist() == [len(t.encode().split()) for t in texts]
    assert chunk.subwords(chunk.word).tolist() == [i for w in words for i in enc.encode_ordinary(" " + w.decode())]
    assert len(lm_score.Chunk([b"", b" "], enc).hashes) == 0


def brute_base(rows):
    docs = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    out = {i: zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 1 for i, _ in docs}
    c = collections.Counter(w for i, ws in docs if not out[i] for w in ws)
    n, d = sum(c.values()), math.log10(sum(c.values()) + 0.5 * (len(c) + 1))
    return {i: (out[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10(c[w] + 0.5) - d for w in ws)) for i, ws in docs}


def sentences(rng, n):
    syllables = "ka lo mi ne pu ra si to ve zu".split()
    vocab = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    return " ".join(vocab[int(rng.paretovariate(0.8)) % 400] + rng.choice(["", "", ",", "."]) for _ in range(n))


def test_scores_of_shuffled_inputs(spark, docs_of):
    """Input that is computed again must lose no row and swap no scores."""
    rng = random.Random(8)
    df = docs_of([(i, sentences(rng, rng.randint(1, 60))) for i in range(3000)])
    base = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    plain = {r.id: r for r in lm_score.score_texts(df).collect()}
    for shuffled in (df.repartition("doc_id"), df.dropDuplicates(["doc_id"])):
        got = lm_score.score_texts(shuffled).collect()
        assert len(got) == 3000 and {r.id for r in got} == set(plain)
        for r in got:
            want = plain[r.id]
            assert all(math.isclose(r[c], want[c], rel_tol=1e-9) for c in base)
            # the order of training windows in a task follows the input's order only in ties
            assert abs(r.score - want.score) <= 0.02 * abs(want.score)


def test_scores(docs_of, monkeypatch):
    rng = random.Random(6)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "Word WORD \xa0word é \x1c x")] + [(i, sentences(rng, rng.randint(1, 400))) for i in range(4, 160)]
    rows += [(500, sentences(rng, 9000))]
    df = docs_of(rows).withColumn("score", F.lit("clash"))
    got = {r.id: r for r in lm_score.score_texts(df).collect()}
    for i, (out, n, known, total, base) in brute_base(rows).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0 and math.isfinite(r.score)
    # held-out texts of the learned kind are likelier than noise of the same length
    noise = "".join(rng.choice("qxjwzkv ") for _ in range(2000))
    more = {r.id: r for r in lm_score.score_texts(docs_of([*rows, (501, noise)])).collect()}
    held = [r for r in more.values() if r.held_out and r.n_tokens > 50 and r.id != 501]
    assert min(r.score / r.n_tokens for r in held) > more[501].score / more[501].n_tokens
    monkeypatch.setattr(lm_score, "HEAD", 40)  # most words' counts then come from the join
    few = {r.id: r for r in lm_score.score_texts(df).collect()}
    assert all(few[i].n_known == got[i].n_known and math.isclose(few[i].base_score, got[i].base_score, rel_tol=1e-9) for i in got)


def counted_runs(texts, seeds, sizes):
    """Key -> run of training ids, from batches of the given sizes."""
    path = lm_score.public_tokenizers.path(lm_score.RANK_FILE)
    with open(path, "rb") as f:
        work = lm_score._counting(types.SimpleNamespace(value=f.read()), lm_score.public_tokenizers.PATTERN)
    at = [0, *itertools.accumulate(sizes)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[a:b], pa.string()), pa.array(seeds[a:b], pa.int64())], ["text", "seed"])
               for a, b in itertools.pairwise(at)]
    out = [r for b in work(iter(batches)) for r in b.to_pylist()]
    return {r["key"]: (r["n"], r["ids"]) for r in out if r["kind"] == 2}, {r["key"]: r["n"] for r in out if r["kind"] == 1}


def test_every_training_subword_is_a_target_once(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(lm_score, "_CHUNK", 1 << 12)  # long texts in several chunks
    texts = [None, "", "one", *(sentences(rng, n) for n in (5, 700, 9000))]
    runs, subwords = counted_runs(texts, list(range(len(texts))), [len(texts)])
    hit = collections.Counter()
    for n, ids in runs.values():
        inputs, targets = attention.windows(np.array(ids) + 1, 0 if ids[0] < 0 else attention.WINDOW - attention.STRIDE)
        assert len(inputs) == n
        hit.update(targets[targets != attention.PAD].tolist())
    assert hit.pop(0) == len(texts)  # ends
    assert {i - 1: n for i, n in hit.items()} == {i: n for i, n in subwords.items() if i != attention.PAD - 1}


def test_training_depends_on_the_data_only(spark, monkeypatch):
    rng = random.Random(9)
    texts = [sentences(rng, n) for n in (3, 900, 40, 2500, 700, 1)]
    seeds = [rng.getrandbits(63) - (1 << 62) for _ in texts]
    runs, _ = counted_runs(texts, seeds, [6])
    assert runs == counted_runs(texts, seeds, [1, 2, 3])[0]
    monkeypatch.setattr(lm_score, "TASK_WINDOWS", 64)  # several tasks a round
    table = np.append(np.arange(300000) % attention.SLOTS, 0)
    rows = spark.createDataFrame([(k, n, ids) for k, (n, ids) in runs.items()], "key long, n long, ids array<int>")
    start = attention.initial(np.ones(attention.SLOTS))
    one, many = (lm_score.train(rows.repartition(parts), start, table) for parts in (1, 7))
    assert all((one[k] == many[k]).all() for k in one) and not np.allclose(one["E"], start["E"])
    taken = []
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda sc: taken.append(1) or 3))
    lm_score.train(rows, start, table, rounds=1)
    assert not taken


def test_long_text_scores_as_one_run(monkeypatch):
    rng = random.Random(10)
    path = lm_score.public_tokenizers.path(lm_score.RANK_FILE)
    with open(path, "rb") as f:
        ranks = f.read()
    p = attention.initial(np.ones(attention.SLOTS))
    p = {k: v * 3 if k in ("E", "C", "O") else v for k, v in p.items()}  # context matters
    table = np.append(np.arange(300000) % attention.SLOTS, 0)
    held = [types.SimpleNamespace(value=x) for x in (
        ranks, p, table, np.zeros(300001), (np.zeros(0, np.uint64), np.zeros(0, np.int64)))]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([sentences(rng, 6000), sentences(rng, 30)])], ["rid", "text"])

    def scores():
        work = lm_score._scoring(held[0], lm_score.public_tokenizers.PATTERN, *held[1:])
        return [r["score"] for b in work(iter([batch])) for r in b.to_pylist() if r["key"] is None]
    whole = scores()
    monkeypatch.setattr(lm_score, "_CHUNK", 1 << 10)
    monkeypatch.setattr("casekit.llm.lm_score.pieces", lambda texts: (
        (i, line.encode()) for i, t in enumerate(texts) for line in textwrap.wrap(t.decode(), 500)))
    monkeypatch.setattr(lm_score, "BATCH", 7)
    assert np.allclose(scores(), whole, rtol=1e-6)


def test_scores_without_training_texts(docs_of):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    got = lm_score.score_texts(docs_of([(i, "a b") for i in held])).collect()
    assert {(r.n_known, r.train_tokens) for r in got} == {(0, 0)} and all(math.isclose(r.base_score, 0, abs_tol=1e-9) for r in got)
    assert lm_score.score_texts(docs_of([])).collect() == []


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free = {}, set(names)
    while True:
        rest = sum(sizes.values()) - sum(out.values())
        total = sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: rest * w[s] / total for s in free}
        for s in over:
            out[s] = float(cap * sizes[s])
            free.discard(s)


def test_mixing(docs_of):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randint(1, 300)), rng.choice(["a", "b", "Z", "é", None])) for i in range(600)]
    rows += [(1000 + i, "same size text here", "a") for i in range(400)] + [(2000, None, "b"), (2001, "", "only empty"), (None, "x y", "b")]
    rows += [(3000, "one big text " * 2000, "small"), (3001, "x", "tiny")]
    df = docs_of(rows).withColumn("taken", F.lit("clash"))
    got = mixing.mix(df).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    taken = collections.Counter()
    for r in got:
        n = len((r.text or "").split())
        assert r.size == n and r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert r.taken == r.copies * n and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s in ("a", "b", "Z", "é", None):
        assert abs(taken[s] - want[s]) <= 1
    key = lambda r: (str(r.doc_id), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(df.repartition(3)).collect()))
    assert mixing.mix(docs_of([])).collect() == []


def test_fit_lengths_against_every_subset():
    rng = random.Random(9)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 4))}
        total = sum(n * c for n, c in counts.items())
        budget = rng.randint(0, total + 5)
        take = mixing.fit_lengths(counts, budget)
        assert all(0 <= take[n] <= counts[n] for n in take)
        got = sum(n * k for n, k in take.items())
        share = {n: c * budget // total for n, c in counts.items()} if budget < total else dict(counts)
        sums = {sum(n * k for n, k in share.items())}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c - share[n] + 1)}
        assert got == max(s for s in sums if s <= max(budget, 0)) if budget < total else got == total


def test_pipeline_stages(spark, docs_of):
    prose = lambda k: " ".join(f"Topic{k} sentence {i} says something of value{k}x{i}." for i in range(15))
    rows = [(i, prose(i), "en", f"s{i % 3}", 0, "x", "y") for i in range(12)]
    rows += [(100, prose(1), "en", "s0", 0, "x", "y"), (101, "too short", "en", "s0", 0, "x", "y"), (102, None, "en", "s1", 0, "x", "y"),
             (103, "a | b | c | d | e | f\n" * 30, "en", "s1", 0, "x", "y"), (104, prose(50) + " Mail me@host.org now.", "en", "s2", 0, "x", "y"),
             (None, prose(60), "en", None, 0, "x", "y"), (7, prose(7), "en", "s1", 0, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, kept string")
    out, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "").cache()
        seen[name] = out.collect()
        assert name == "byte_bpe" or out.columns == docs.columns and {(r["size"], r.kept) for r in seen[name]} == {("x", "y")}
    assert {r.doc_id for r in seen["quality"]} == {*range(12), 100, 104, None}
    assert sorted(str(r.doc_id) for r in seen["near_duplicates"]) == sorted(str(x) for x in [*range(12), 104, None])
    assert {r.text[-18:] for r in seen["pii"] if r.doc_id == 104} == {" Mail [EMAIL] now."}
    assert all(r.n_chars == len(r.text) for r in seen["pii"])
    copies = collections.Counter(r.doc_id for r in seen["mixing"])
    assert set(copies) <= {*range(12), 104, None} and max(copies.values()) <= 3
    assert collections.Counter(r.doc_id for r in seen["byte_bpe"]) == copies
    import hashlib
    text = {r.doc_id: r.text for r in seen["mixing"]}
    assert all(r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
               for r in seen["byte_bpe"])


def test_pipeline_with_a_very_long_text(spark):
    words = lambda k: " ".join(f"Sentence {i} of text {k} tells of thing{k * 7919 + i * 31}." for i in range(30000))
    long = words(1)
    mail = long + " Write to someone@example.org today."
    rows = [(1, mail, "en", "a", len(mail)), (2, mail + " And more.", "en", "a", len(mail) + 10), (3, "Short but clean text. " + words(3)[:2000] + ".", "en", "b", 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "").cache()
        seen[name] = {r.doc_id: r for r in out.collect()}
    assert set(seen["quality"]) == {1, 2, 3} and len(long) > 1_000_000
    assert set(seen["near_duplicates"]) == {1, 3}
    assert seen["pii"][1].text == long + " Write to [EMAIL] today."
    assert set(seen["byte_bpe"]) == set(seen["mixing"]) <= {1, 3} and seen["byte_bpe"]


def test_pipeline_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []
