"""Whitening, alignment of tokenizers and packing against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casekit.llm import alignment, packing, whitening


# ------------------------------------------------------------ whitening --
def brute_whitening(rows, k=8):
    """(id, component) -> values, by the covariance in exact integers and its eigenvectors."""
    x = [(i, [math.floor(1024 * float(c)) + 100000 for c in v]) for i, v in rows]
    n, d = len(x), len(x[0][1])
    s = [sum(v[j] for _, v in x) for j in range(d)]
    away = [[n * v[j] - s[j] for j in range(d)] for _, v in x]
    cov = np.array([[sum(a[i] * a[j] for a in away) / n ** 3 for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    y = np.array(away, float) / n @ u / np.sqrt(e)
    return {(i, c + 1): (n, sum(a * a for a in away[r]), y[r, c], e[c] / np.trace(cov)) for r, (i, _) in enumerate(x) for c in range(k)}


def check_whitening(got, rows, k=8):
    want = brute_whitening(rows, k)
    found = {(r.id, r.component): r for r in got}
    assert set(found) == set(want) and len(got) == len(want)
    for c in range(1, k + 1):
        keys = [key for key in want if key[1] == c]
        sign = 1 if sum(found[key].whitened * want[key][2] for key in keys) > 0 else -1
        for key in keys:
            r, (n, deviation, y, explained) = found[key], want[key]
            assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-7
            assert math.isclose(r.explained, explained, rel_tol=1e-6) and abs(sign * r.whitened - y) < 1e-5


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("clash")).withColumn(
        "component", F.lit("clash"))


def test_whitening_against_eigenvectors(spark):
    rng = np.random.default_rng(4)
    scale = 2.0 ** -np.arange(12) * 4
    rows = [(i, (rng.normal(size=12) * scale + 50).tolist()) for i in range(300)]
    bad = [(900, None), (901, []), (902, [float("nan")] * 12), (903, [1.0] * 11 + [None]), (904, [1.0] * 11 + [float("-inf")]),
           (905, [1.0] * 5), (906, [1e300] * 12)]
    got = whitening.components(vectors(spark, rows + bad).repartition(5)).collect()
    check_whitening(got, rows)


def test_whitening_of_ill_conditioned_rows(spark):
    rng = np.random.default_rng(5)
    mix = np.linalg.qr(rng.normal(size=(10, 10)))[0]
    scale = 10.0 ** np.linspace(5, -1, 10)
    rows = [(i, (rng.normal(size=10) * scale @ mix).tolist()) for i in range(400)]
    x = np.floor(1024 * np.array([v for _, v in rows])) + 100000
    got = whitening.components(vectors(spark, rows)).collect()
    assert len(got) == 8 * 400 and max(r.identity_error for r in got) < 1e-6
    sigma = np.linalg.svd(x - x.mean(axis=0))[1] ** 2
    share = {r.component: r.explained for r in got}
    assert all(math.isclose(share[c], sigma[c - 1] / sigma.sum(), rel_tol=1e-6) for c in range(1, 9))


def test_whitening_without_full_rank(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(200, 3))
    rows = [(i % 50, [*map(float, v), 7.0, 2 * float(v[0]) // 1, 0.0]) for i, v in enumerate(np.floor(base * 8))]
    rows = [(i, [v[0], v[1], v[2], v[3], v[0] * 2, v[5]]) for i, v in rows]  # three directions vary; ids repeat
    got = whitening.components(vectors(spark, rows)).collect()
    assert len(got) == 3 * 200 and {r.component for r in got} == {1, 2, 3} and got[0].identity_error < 1e-7
    assert math.isclose(sum({r.component: r.explained for r in got}.values()), 1, rel_tol=1e-9)
    one = vectors(spark, [(1, [1.0, 2.0])])
    same = vectors(spark, [(i, [1.0, 2.0]) for i in range(9)])
    for df in (one, same, vectors(spark, []), vectors(spark, [(1, None)])):
        out = whitening.components(df)
        assert out.collect() == [] and out.schema["deviation"].dataType.simpleString() == "bigint"


def test_triangular_solve_and_shifted_factor():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(40, 6)) * 10.0 ** -np.arange(6)
    r = whitening.factor(a.T @ a, 40, True)
    assert np.allclose(whitening.solve_upper(a, r) @ r, a)
    flat = np.zeros((6, 6))
    flat[0, 0] = 1
    assert np.allclose(np.triu(whitening.factor(flat, 40, False)), whitening.factor(flat, 40, False))


# ------------------------------------------------------------ alignment --
HARD = ["plain words here", " leading", "trailing ", "a  b   c ", "tabs\tand\nlines\n\n x", "don't you'll", "<|endoftext|> <s> </s> <unk>",
        "naïve café Ångström ﬁ", "日本語 テキスト です", "emoji 👩‍👩‍👧 here", "1234567 3.14 $$$", " \n ", " ", "\n", "x y  z w", "a\x1c b\x1f\x1f c",
        "▁marked ▁ text", "nul\x00 char", "é ́combining", "word" * 50, "a▁b", "\u0085 x \u0085 ", "  ", "ends in break\n",
        "It's 'tis ' s  's", "…—“quotes”"]


@pytest.fixture(scope="module")
def both_tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute_align(rows, both):
    a, b = both
    spelled = alignment.byte_alphabet()
    docs = []
    for i, text in rows:
        text = text or ""
        raw = (" " + text).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(spelled[c] for c in a.id_to_token(x)) for x in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            docs.append((i, [], [], [], []))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        links = [(x, y) for x, (s, e) in zip(ids_a, spans[0], strict=True) for y, (t, f) in zip(ids_b, spans[1], strict=True)
                 if s < f and t < e]
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, lo = [], 0
        for c in common:
            groups.append(tuple(",".join(str(x) for x, (s, _) in zip(ids, sp, strict=True) if lo <= s < c)
                                for ids, sp in ((ids_a, spans[0]), (ids_b, spans[1]))))
            lo = c
        docs.append((i, ids_a, ids_b, links, groups))
    count = collections.Counter(p for d in docs for p in set(d[3]))
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return sorted((i, len(ia), len(ib), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
                   hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if groups else "")
                  for i, ia, ib, links, groups in docs)


def aligned(df, **kw):
    return sorted(tuple(r) for r in alignment.align(df, **kw).collect())


def test_alignment_against_brute_force(docs_of, both_tokenizers):
    rng = random.Random(9)
    pieces = HARD + "the quick brown fox, jumped! over 12 lazy dogs; naïve".split()
    rows = list(enumerate(HARD)) + [(100, None), (101, ""), (5, "repeated id"), (5, "repeated id")]
    rows += [(200 + i, rng.choice([" ", "  ", "\n", ""]).join(rng.choices([p for p in pieces if "▁" not in p], k=rng.randint(1, 40))))
             for i in range(60)]
    df = docs_of(rows).withColumn("n_a", F.lit("clash")).withColumn("pair", F.lit("clash"))
    want = brute_align(rows, both_tokenizers)
    assert aligned(df) == want
    # every text in many fragments, most pairs outside the head
    assert aligned(df, long=16, head_size=20) == want


def test_alignment_of_very_long_texts_and_empty_tables(docs_of, both_tokenizers):
    rng = random.Random(10)
    words = "alpha beta gämma 12 , ... don't antidisestablishmentarianism".split()
    rows = [(1, " ".join(rng.choices(words, k=3000))), (2, "x" * 3000 + " end"), (3, "ab " * 2000), (4, "日本" * 500)]
    rows.append((6, rows[0][1] + "▁"))
    assert aligned(docs_of(rows), long=200) == brute_align(rows, both_tokenizers)
    assert aligned(docs_of([])) == []


def test_fragments_compose_associatively(both_tokenizers):
    spec = [open(public_tokenizers.path(f), "rb").read() for f in (alignment.FILE_A, alignment.FILE_B)]
    tokens = alignment.Tokens(*spec)
    text = "antidisestablishmentarianism of internationalization, reconsidered: 日本語 und so weiter"
    a, b, good = tokens.encode(text)
    assert good
    ends_a, ends_b = np.cumsum(tokens.size_a[a]), np.cumsum(tokens.size_b[b])
    rng = random.Random(11)

    def fold(parts):
        """Compose neighbours in a random order; all groups by place."""
        groups = []
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            both, closed = alignment.compose(parts[i], parts[i + 1])
            groups += [closed] if closed else []
            parts[i:i + 2] = [both]
        end = parts[0]
        return [(end.first, end.prefix), *groups, *([(1 << 62, end.suffix)] if end.suffix[0] else [])]

    for span in (1, 2, 3, 5, 8, 200):
        cuts = list(range(0, int(ends_a[-1]) + span, span))
        for _ in range(4):
            parts, lines = [], []
            for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                (i, j), (m, n) = (np.searchsorted(e, [lo, hi], "right") for e in (ends_a, ends_b))
                f, closed = alignment.fragment(tokens, k, a[i:j], ends_a[i:j], b[m:n], ends_b[m:n])
                parts.append(f)
                lines += [(closed.key, True, closed.text)] if closed else []
            lines += [(key, False, alignment._closed(tokens, key, False, *(np.array(x) for x in ab)).text) for key, ab in fold(parts)]
            assert ";".join(t for *_, t in sorted(lines)) == alignment._closed(tokens, 0, False, a, b).text


# -------------------------------------------------------------- packing --
@pytest.fixture(scope="module")
def word_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check_packing(rows, got, tokenizer, length):
    """Every piece of every document, each sequence gapless and not too long."""
    texts = collections.Counter()
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), length)):
            part = ids[at:at + length]
            texts[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert texts == collections.Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences), sum(r.length for r in got)


def test_packing_against_brute_force(docs_of, word_tokenizer):
    rng = random.Random(12)
    words = "The quick BROWN fox's naïve 123 don't é <|endoftext|> ﬁ\x1cx   日本 ...  ".split(" ")
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "x y"), (3, "x y"), (None, "null id")]
    rows += [(10 + i, rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=int(rng.paretovariate(0.7) * 3) % 900 + 1))) for i in range(400)]
    df = docs_of(rows).withColumn("length", F.lit("clash")).withColumn("piece", F.lit("clash")).repartition(7)
    for kw in ({}, {"group": 20}, {"near": 0, "group": 64}):
        packed = packing.pack(df, length=256, **kw)
        n, total = check_packing(rows, packing.placements(packed).collect(), word_tokenizer, 256)
        assert n <= 1.08 * math.ceil(total / 256)
    whole = packing.pack(df)
    n, total = check_packing(rows, packing.placements(whole).collect(), word_tokenizer, 2048)
    assert n == math.ceil(total / 2048)


def test_packing_of_long_texts_and_empty_tables(docs_of, word_tokenizer, monkeypatch):
    rows = [(1, "long words in a row " * 90000), (2, "x" * 5000), (3, "one")]
    check_packing(rows, packing.placements(packing.pack(docs_of(rows))).collect(), word_tokenizer, 2048)
    assert packing.placements(packing.pack(docs_of([]))).collect() == []


def test_packing_ends_where_nothing_can_be_joined(docs_of, word_tokenizer):
    rows = [(i, "a " * 150) for i in range(300)]  # two never share 256
    packed = packing.pack(docs_of(rows).repartition(3), length=256, group=16)
    n, _ = check_packing(rows, packing.placements(packed).collect(), word_tokenizer, 256)
    assert n == 300


def test_word_ids_are_those_of_whole_texts(word_tokenizer):
    rng = random.Random(14)
    enc = packing.WordIds(open(public_tokenizers.path(packing.TOKENIZER), "rb").read())
    assert enc.parts_only is not None
    signs = [chr(c) for c in range(33, 127)] * 2 + list("sdtrevlm'") * 4 + ["\x00", "\x1c", "\x7f", "é", "É", "e\u0301", "İ", "ß", "ﬁ", "日", "Σ", "\u00a0", "\u2003", "½", "٣"]
    texts = [" ".join("".join(rng.choices(signs, k=rng.randint(1, 12))) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    texts += ["I'll he'd WE'RE 'S 's' ' 's don't", "<|startoftext|>a b<|endoftext|> <|ENDOFTEXT|>", "\t\n x \x0b y\x0cz\r"]
    for text, ids in zip(texts, enc.of([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == word_tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest_sequence():
    seq, offset = packing.best_fit(np.array([6, 5, 4, 3, 2, 1]), 10)
    fill = collections.Counter()
    for s, n in zip(seq.tolist(), [6, 5, 4, 3, 2, 1], strict=True):
        fill[s] += n
    assert sorted(fill.values()) == [1, 10, 10] and offset.tolist()[:2] == [0, 0]
    many = np.random.default_rng(13).integers(1, 2048, 20000)
    seq, _ = packing.best_fit(many, 2048)
    assert np.bincount(seq, many).max() <= 2048 and seq.max() + 1 <= 1.01 * math.ceil(many.sum() / 2048)
