"""MinHash, embedding and suffix de-duplication against brute force."""

import hashlib
import random

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from casekit.llm import embed_dedup, minhash, shingles, substrings, suffix_dedup
from casekit.llm.graph import connected_components


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    links += [(900, x) for x in range(901, 960)] + [(5, 5)]
    want = Union({x for p in links for x in p})
    for a, b in links:
        want.link(a, b)
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: want.find(i) for p in links for i in p if i in got} and len(got) >= len({x for a, b in links if a != b for x in (a, b)})
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingle_sets(rows, width):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        out[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
    return out


def brute_minhash(rows, width, pct=80):
    sets = shingle_sets(rows, width)
    u = Union(sets)
    ids = [i for i in sets if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 100 * both >= pct * (len(sets[a]) + len(sets[b]) - both):
                u.link(a, b)
    return {i: (len(s), u.find(i), u.find(i) == i) for i, s in sets.items()}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        action = rng.random()
        if action < 0.5:
            words[k] = f"new{rng.randrange(10 ** 6)}"
        elif action < 0.75 and len(words) > 5:
            del words[k]
        else:
            words.insert(k, f"ins{rng.randrange(10 ** 6)}")
    return " ".join(words)


def test_minhash_against_brute_force(docs_of):
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = [None, "", " \t\n", "one", "One", "two words", "TWO  words\n", "a b c d", "a b c d", "a b c e"]
    texts += [edited(rng, base, rng.randint(0, 14)) for _ in range(120)]  # a group of copies around one text
    chain = list(base[:90])
    for _ in range(25):  # each a copy of the one before
        chain = edited(rng, chain, 3).split()
        texts.append(" ".join(chain))
    for _ in range(40):
        other = [f"z{rng.randrange(9000)}" for _ in range(rng.randint(3, 200))]
        texts += [" ".join(other), edited(rng, other, 2)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    for width in (4, 5):
        df = docs_of(rows).withColumn("n_shingles", F.lit("clash"))
        got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, width=width).collect()}
        assert got == brute_minhash(rows, width)


def test_minhash_nulls_repeats_and_empty(docs_of):
    text = "the same words again and again in a row"
    got = [tuple(r) for r in minhash.near_duplicates(docs_of([(3, text), (3, text), (None, text), (9, text), (5, None)])).collect()]
    assert sorted(got, key=str) == sorted([(3, 5, 3, True), (3, 5, 3, True), (None, 5, None, True), (9, 5, 3, False),
                                           (5, 0, 5, True)], key=str)
    assert minhash.near_duplicates(docs_of([])).collect() == []


def test_sketch_similarity_and_fill():
    rng = np.random.default_rng(0)
    for size in (1, 3, 50, 1000):
        a = rng.integers(0, 1 << 63, size).astype(np.uint64)
        assert (minhash.sketch(a) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (800, 100, 100))
    same = [np.mean(minhash.sketch(np.append(common, a) + np.uint64(s)) == minhash.sketch(np.append(common, b) + np.uint64(s)))
            for s in range(30)]
    assert abs(np.mean(same) - 0.8) < 0.03


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["aa", "b", "ccc", "é"]) for _ in range(rng.randint(0, 300))).encode() for _ in range(50)]
    texts += [b"", b"   ", b"x" * 500, b"\tq\x0bw\x0c \r\n e"]
    whole = [x.tolist() for x in shingles.word_hashes(texts)]
    assert [len(x) for x in whole] == [len(t.split()) for t in texts]
    monkeypatch.setattr(shingles, "CHUNK_BYTES", 64)
    assert [x.tolist() for x in shingles.word_hashes(texts)] == whole
    by_word = {}
    for t, hashes in zip(texts, whole, strict=True):
        for w, h in zip(t.split(), hashes, strict=True):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def brute_strings(rows, length=200):
    seen = {}
    for k, (_, t) in enumerate(rows):
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            seen.setdefault(raw[p:p + length], []).append((k, p))
    gone = [bytearray(len((t or "").encode())) for _, t in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                gone[k][p:p + length] = b"\1" * length
    out = []
    for (i, t), g in zip(rows, gone, strict=True):
        raw = (t or "").encode()
        runs = sum(1 for j in range(len(g)) if g[j] and (j == 0 or not g[j - 1]))
        out.append((i, len(raw), sum(g), runs, hashlib.sha256(bytes(b for b, x in zip(raw, g, strict=True) if not x)).hexdigest()))
    return sorted(out, key=str)


def test_repeated_strings_against_brute_force(docs_of):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passage, other = noise(420), noise(199)
    rows = [(0, None), (1, ""), (2, noise(150)), (3, passage), (4, "x" * 450), (5, noise(700)), (None, noise(500))]
    for k in range(6, 40):
        cut = sorted(rng.sample(range(421), 2))
        rows.append((k, noise(rng.randint(0, 300)) + passage[cut[0]:cut[1]] + noise(rng.randint(0, 300))))
    rows += [(50, noise(90) + passage + noise(80) + passage[7:] + noise(10)), (51, "ab" * 260 + noise(50)), (52, "ba" * 200)]
    rows += [(53, other + noise(5)), (54, noise(5) + other), (55, noise(120) + passage[:260]), (56, passage[200:] + noise(90))]
    copy = noise(333)
    rows += [(60, copy), (61, copy), (61, copy), (62, copy + "!")]
    got = sorted((tuple(r) for r in suffix_dedup.digest(docs_of(rows).withColumn("n_bytes", F.lit("clash"))).collect()), key=str)
    assert got == brute_strings(rows)


def test_repeated_strings_long_text_and_empty(docs_of, monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 700)
    monkeypatch.setattr(substrings, "CHUNK", 300)
    rng = random.Random(10)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a = noise(3000)
    raw = np.frombuffer(a.encode(), np.uint8)
    import pyarrow as pa
    parts = [(p.tolist(), b.tolist()) for _, p, b in substrings.anchor_buckets(pa.array([a.encode()], pa.binary()))]
    positions = [x for p, _ in parts for x in p]
    assert len(parts) > 3 and positions == sorted(set(positions))
    at = substrings._anchors(raw, substrings.grams(raw))
    assert positions == sorted(set(at.tolist()))
    assert suffix_dedup.digest(docs_of([])).collect() == []


def brute_vectors(rows, threshold=0.95):
    unit = {}
    for k, (i, v) in enumerate(rows):
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, dtype=np.float64)
        unit[k] = x / np.abs(x).max()
        unit[k] /= np.linalg.norm(unit[k])
    u, n = Union(i for i, _ in rows if i is not None), [0] * len(rows)
    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                n[a] += 1
                n[b] += 1
                u.link(rows[a][0], rows[b][0])
    return sorted(((i, n[k], None if i is None else u.find(i), i is None or u.find(i) == i) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("dims", [64, 20])
def test_vectors_against_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    rows, at = [], 0

    def put(v):
        nonlocal at
        rows.append((at, [float(np.float32(x)) for x in v]))
        at += 1
    for spread in (0.0, 0.05, 0.15, 0.25, 0.33, 0.36):  # tight to loose groups, some near the threshold
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        for _ in range(25):
            noise = rng.normal(size=dims)
            put((centre + spread * noise / np.linalg.norm(noise)) * rng.uniform(0.1, 9))
    for _ in range(60):
        put(rng.normal(size=dims))
    rows += [(900, None), (901, []), (902, [0.0] * dims), (903, [float("nan")] + [1.0] * (dims - 1)), (904, [None] + [1.0] * (dims - 1)),
             (905, [float("inf")] * dims), (None, rows[0][1]), (0, rows[0][1]), (906, [1e30] * dims), (907, [1e-30] * dims),
             (908, [1.0, 2.0]), (909, [2.0, 4.0])]
    order = rng.permutation(len(rows)).tolist()
    df = spark.createDataFrame([(*rows[i], "x") for i in order], "vec_id long, embedding array<float>, n_links string")
    got = sorted((tuple(r) for r in embed_dedup.near_duplicate_vectors(df).collect()), key=str)
    assert got == brute_vectors(rows)
    assert embed_dedup.near_duplicate_vectors(df.limit(0)).collect() == []


@pytest.mark.parametrize("hashes", [4, 5])
def test_balls_are_found_by_their_members(spark, hashes):
    """More hashes to a key, as large tables have: vectors linked with members
    at the rim of a ball lie far from its centre."""
    rng, dims = np.random.default_rng(hashes), 64
    theta = math.acos(0.95)

    def turned(v, angle):
        side = rng.normal(size=dims)
        side -= side @ v * v
        return math.cos(angle) * v + math.sin(angle) * side / np.linalg.norm(side)
    vectors = []
    for _ in range(25):
        centre = turned(np.eye(dims)[0], rng.uniform(0.5, 3))
        rim = [turned(centre, theta * 0.47) for _ in range(12)]
        vectors += rim + [turned(centre, theta * rng.uniform(0, 0.2)) for _ in range(10)]
        for x in rim[:8]:  # outside the ball, near one member
            out = x - x @ centre * centre
            out /= np.linalg.norm(out)
            far = theta * rng.uniform(1.2, 1.45)
            vectors.append(math.cos(far) * centre + math.sin(far) * out)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.id: r.n_links for r in embed_dedup.near_duplicate_vectors(df, hashes=hashes).collect()}
    want = {i: n for i, n, *_ in brute_vectors(rows)}
    assert all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.99 * sum(want.values())
    outer = [i for k in range(25) for i in range(30 * k + 22, 30 * k + 30)]
    assert sum(got[i] for i in outer) >= 0.95 * sum(want[i] for i in outer) > 0


def test_hadamard_is_orthonormal():
    h = embed_dedup.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))
