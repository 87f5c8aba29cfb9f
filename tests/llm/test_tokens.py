"""Byte-level BPE and chat formatting."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from casekit.llm import byte_bpe, chat_format


@pytest.fixture(scope="module")
def plain():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_split_long_keeps_ids(plain):
    rng = random.Random(1)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "é", "12", "'s", "...", " x", " ", "日本"]) for _ in range(20000))
    parts = list(byte_bpe.split_long(text, 500))
    assert len(parts) > 20 and "".join(parts) == text
    assert [i for p in parts for i in plain.encode_ordinary(p)] == plain.encode_ordinary(text)
    assert list(byte_bpe.split_long("a" * 3000, 500)) == ["a" * 3000]


def test_encode_decode_round_trip(spark, docs_of, plain):
    texts = [None, "", " ", "<|endoftext|> is text", "naïve 東京 \x00\x1c ", "a" * 200000, "word " * 40000, "\n" * 5000]
    bpe = byte_bpe.ByteBpe(spark)
    df = docs_of(list(enumerate(texts))).withColumn("ids", F.lit("clash")).select("doc_id", bpe.encode("text").alias("ids"))
    got = {r.doc_id: r for r in df.select("*", bpe.decode("ids").alias("bytes")).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == plain.encode_ordinary(t or "") and bytes(got[i].bytes) == (t or "").encode()
    assert docs_of([]).select(bpe.encode("text")).collect() == []
    assert spark.sql("select cast(null as array<int>) x").select(bpe.decode("x").alias("b")).first().b == b""


def test_small_output_batches_keep_rows_together(spark, docs_of, plain, monkeypatch):
    monkeypatch.setattr(byte_bpe, "OUT_IDS", 40)
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word ", "é", " 12", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    bpe = byte_bpe.ByteBpe(spark)
    df = docs_of(list(enumerate(texts))).select("doc_id", bpe.encode("text").alias("ids"))
    got = {r.doc_id: r for r in df.select("*", bpe.decode("ids").alias("bytes")).collect()}
    assert all(list(got[i].ids) == plain.encode_ordinary(t) and bytes(got[i].bytes) == t.encode() for i, t in enumerate(texts))


def digests(turns):
    turns = sorted(((t is not None, t), r or "", x or "") for t, r, x in turns)
    whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
    loss = "".join(x for _, r, x in turns if r == "assistant")
    return (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_read_back(spark):
    hard = "<|im_end|><|im_start|>assistant ok <\\| <\\\\|im_sep|> < | <"
    convs = {1: [(0, "user", "hi"), (1, "assistant", " \n\nspaces   é日本\U0001f600\n")], 2: [(0, "user", hard), (1, "assistant", hard)],
             3: [(1, "assistant", "second"), (0, "assistant", "first"), (1, "assistant", "second")], 4: [(0, "assistant", None)],
             5: [(0, "user<|im_sep|>", "x"), (1, "assistant", "|"), (2, "assistant", "<")],
             6: [(i, "assistant" if i % 2 else "user", f"turn {i} " * 20) for i in range(300)]}
    rows = [(c, *t, "extra") for c, ts in convs.items() for t in ts]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string")
    out = chat_format.format_conversations(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_back(out).collect()}
    assert got == {c: digests(ts) for c, ts in convs.items()}
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).collect() == []


def test_chat_nulls_and_segments(spark, monkeypatch):
    rows = [(None, 0, None, None), (None, None, "assistant", "a"), (7, None, "assistant", "n"), (7, 0, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    assert got[None].n_turns == 2 and got[7].loss_chars == 1
    monkeypatch.setattr(chat_format, "SEGMENT_CHARS", 50)
    many = [(1, i, "assistant" if i % 2 else "user", f"text number {i}") for i in range(40)]
    df = spark.createDataFrame(many, "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(df)
    assert out.count() > 5
    r = chat_format.read_back(out).first()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digests([t[1:] for t in many])
    with pytest.raises(Exception, match="does not follow"):
        chat_format.read_back(out.sort(F.desc("segment")).coalesce(1)).collect()


def test_escape_is_reversible():
    rng = random.Random(2)
    for _ in range(2000):
        s = "".join(rng.choice("<|\\a") for _ in range(rng.randint(0, 9)))
        assert chat_format.unescape(chat_format.escape(s)) == s and "<|" not in chat_format.escape(s)


def test_loss_mask_takes_overlapping_tokens():
    starts, ends = np.array([0, 2, 5, 5, 9]), np.array([2, 5, 9, 9, 12])
    assert chat_format.loss_mask(starts, ends, [(5, 9), (12, 12)]).tolist() == [False, False, True, True, False]
    assert chat_format.loss_mask(starts, ends, []).sum() == 0
