"""Alignment of two tokenizations of the same bytes.

Tokenizer A is byte-level BPE, tokenizer B a piece model that marks words with
U+2581 and puts one such mark before a text; both therefore read the bytes of
space + text.  Byte offsets where an A and a B token end are the bounds of
*groups*; an A and a B token that share a byte are *linked*.

Fragments
---------
A byte range of a document gives a fragment: an open prefix (tokens up to the
first common end in it), closed groups, and an open suffix (tokens behind the
last common end); a range without a common end is open as a whole.  Fragments
compose: the suffix of the left and the prefix of the right one close a group.
Composition is associative and the empty fragment its identity, so the ranges
of one document are reduced as a tree, ``FAN`` neighbours at a time, by tasks
that need not know each other.  A token belongs to the range it ends in.

The smallest range is a *unit*: a space that follows a character other than
white space, and what comes up to the next such space.  Neither tokenizer
merges anything across the start of a unit (checked for B when it is loaded),
so a unit's tokens do not depend on its surroundings, and its fragment is
closed.  Each distinct unit is encoded and aligned once per worker (as long as
the units fit); the composition of closed fragments is their concatenation.

Steps: (1) texts up to ``LONG`` characters are aligned where they are read.
Longer ones are cut at units into parts of at least that many characters,
stored, dealt over the tasks, and cut again at multiples of ``LONG`` bytes into
fragments, whatever tokens lie there; the open ends go through the tree, closed
groups stay where they are.  (2) How many documents hold a linked id pair is
counted by Spark, partial counts first.  (3) The counts of the ``HEAD`` most
frequent pairs at most are broadcast and summed up where the documents' pairs
are stored; pairs outside the head are joined with their counts by a shuffle.

Defined results: a null or empty text, and one whose tokens' bytes differ from
space + text, has no tokens: zeros, and an empty digest.  Rows are documents of
their own, whatever their ids (null, repeated).  A very long stretch without a
unit's start is one unit, and a very long group is held by one task.  The digest
of a document is sequential: one task streams its groups.  An empty table gives
an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count, islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from casekit.functions.workers import ship_with_tasks
from casekit.llm.common import store, worker_cache

ship_with_tasks(__name__)

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
MAX_FILE_BYTES = 64 << 20  # bound on what is broadcast
LONG = 1 << 17
FAN_BITS = 4
HEAD = 1 << 19
MARK = "▁"
_UNITS, _UNIT_BYTES = 3 << 17, 1 << 25  # units a worker keeps
_CHUNK = 1 << 21        # characters of texts looked at together
_BULK = 1 << 16         # characters encoded at a time
_OUT_PAIRS = 1 << 20    # pairs after which a worker hands on what it has
_START = re.compile(r"(?<=\S) ")   # where a unit starts
_SPACED = re.compile(r"\s ")


def units(text: str) -> list[str]:
    """The units of space + text, each without its first space."""
    if MARK in text:  # B reads the mark as a space: nothing to align
        return [text]
    if text[0] == " " or _SPACED.search(text):
        return _START.split(text)
    return text.split(" ")


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE spells bytes as characters: printable ones of Latin-1 as
    themselves, all others by the characters from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _joined(tokens: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


class Tokens:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, spec_a: bytes, spec_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_str(spec_a.decode())
        self.a.encode_special_tokens = True  # special strings in a text are ordinary text
        self.b = SentencePieceProcessor(model_proto=spec_b)
        spelled = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(spelled.get(c, 0) for c in token)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in names):
            raise ValueError("tokenizer B has pieces that go on beyond a word")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(names)]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        n = max(len(self.bytes_a), len(self.bytes_b))
        # Every id as text with what can follow it: another id, the other side, another group.
        self.spelled = [f"{i}{sep}" for sep in ",|;" for i in range(n)]
        self.widths = np.array(list(map(len, self.spelled[:n])), np.int64)
        self._x = len(self.b.encode("x"))

    def encode(self, unit: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of some units joined (all but the last character white space
        free at its end), and whether both spell space + unit."""
        raw = (" " + unit).encode()
        a = np.array(self.a.encode(" " + unit, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode("x " + unit, num_threads=1)[self._x:], np.int64)
        return a, b, _joined(self.bytes_a, a) == raw and _joined(self.bytes_b, b) == raw


def pair_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << 32) | b


def _common(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Ends that two rising lists share."""
    if not len(ends_a) or not len(ends_b):
        return ends_a[:0]
    at = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
    return ends_a[ends_b[at] == ends_a]


def linked(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last byte of the overlap, id pair) of every linked pair of occurrences:
    between two neighbouring ends lies the overlap of exactly one pair."""
    ends = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")
    ends = ends[np.concatenate((ends[1:] != ends[:-1], [True]))[:len(ends)]]
    return ends, pair_of(a[np.searchsorted(ends_a, ends)], b[np.searchsorted(ends_b, ends)])


def group_text(tokens: Tokens, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray,
               common: np.ndarray) -> tuple[str, np.ndarray]:
    """The groups as text, each with a semicolon behind it, and where the text
    of each group ends."""
    side = np.concatenate((2 * np.searchsorted(common, ends_a), 2 * np.searchsorted(common, ends_b) + 1))
    order = np.argsort(side, kind="stable")
    side, ids = side[order], np.concatenate((a, b))[order]
    last = np.concatenate((side[1:] != side[:-1], [True]))[:len(side)]
    sep = np.where(last, 1 + (side & 1), 0)
    text = "".join(map(tokens.spelled.__getitem__, (ids + sep * len(tokens.widths)).tolist()))
    return text, np.cumsum(tokens.widths[ids])[last & (side & 1 == 1)]


class Units:
    """The distinct units a worker has met: tokens, groups and links."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = defaultdict(count().__next__)  # units are numbered as they come
        self.texts: list[str] = []
        self.size = 0
        self.good = np.zeros(0, bool)
        self.counts = np.zeros((4, 0), np.int64)  # A tokens, B tokens, groups, links
        self.flat = [np.zeros(0, np.int64) for _ in range(3)]  # A ids, B ids, linked pairs

    def _take(self, kind: int, at: np.ndarray) -> np.ndarray:
        """The ids (0: A, 1: B) or pairs (2) of a run of units."""
        row = (0, 1, 3)[kind]
        n = self.counts[row, at]
        return self.flat[kind][np.repeat(self.starts[kind][at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def _add(self, names: list[str]) -> None:
        done: list[tuple] = []
        at = 0
        while at < len(names):  # units joined to texts of about _BULK characters
            end, size = at, 0
            while end < len(names) and (end == at or size < _BULK) and not names[end][-1:].isspace() and names[end]:
                size += len(names[end]) + 1
                end += 1
            end = max(end, at + 1)  # one that ends in white space, alone
            a, b, good = self.tokens.encode(" ".join(names[at:end]))
            if good or end == at + 1:
                done.append((names[at:end], a, b, good))
            else:
                done += [([name], *self.tokens.encode(name)) for name in names[at:end]]
            at = end
        counts, good, flat = [self.counts], [self.good], [[x] for x in self.flat]
        for group, a, b, fits in done:
            good.append(np.full(len(group), fits))
            if not fits:
                counts.append(np.zeros((4, len(group)), np.int64))
                self.texts += [""] * len(group)
                continue
            ends_a, ends_b = np.cumsum(self.tokens.size_a[a]), np.cumsum(self.tokens.size_b[b])
            bounds = np.cumsum([len(u.encode()) + 1 for u in group])
            common = _common(ends_a, ends_b)
            ends, pairs = linked(a, ends_a, b, ends_b)
            places = [np.append(0, np.searchsorted(x, bounds) + 1) for x in (ends_a, ends_b, common, ends)]
            counts.append(np.stack([np.diff(p) for p in places]))
            text, until = group_text(self.tokens, a, ends_a, b, ends_b, common)
            until = np.append(0, until)[places[2]].tolist()
            self.texts += [text[i:j - 1] for i, j in zip(until, until[1:], strict=False)]
            for held, new in zip(flat, (a, b, pairs), strict=True):
                held.append(new)
        self.counts, self.good = np.concatenate(counts, axis=1), np.concatenate(good)
        self.flat = [np.concatenate(x) for x in flat]
        self.starts = [np.cumsum(self.counts[k]) - self.counts[k] for k in (0, 1, 3)]
        self.size += sum(map(len, names))

    def places(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Places of the units of some texts."""
        if len(self.place) > _UNITS or self.size > _UNIT_BYTES:
            self.clear()
        known = len(self.place)
        places = [np.fromiter(map(self.place.__getitem__, t), np.int64, len(t)) for t in texts]
        if len(self.place) > known:
            self._add(list(islice(self.place, known, None)))
        return places


def _units_of(spec: Broadcast) -> Units:
    cache = worker_cache()
    key = ("aligned units", hashlib.sha256(b"".join(spec.value)).digest())
    if key not in cache:
        cache[key] = Units(Tokens(*spec.value))
    return cache[key]


def _chunks(texts: pa.Array) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for row, text in enumerate(texts):
        held.append((row, text.as_py() or ""))
        size += len(held[-1][1])
        if size >= _CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def _named(schema: T.StructType, columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    """A batch of all columns of the schema; those not given are null."""
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.RecordBatch.from_arrays(
        [columns[f.name].cast(to_arrow_type(f.dataType)) if f.name in columns else pa.nulls(n, to_arrow_type(f.dataType))
         for f in schema.fields], schema.names)


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_PAIRS = T.ArrayType(T.LongType())


def _whole_schema(id_type: T.DataType) -> T.StructType:
    """Documents (pair null), and how many documents hold a pair (n_a null)."""
    out = T.StructType([T.StructField("id", id_type)])
    for name in NUMBERS:
        out = out.add(name, "long")
    return out.add("sha", "string").add("pairs", _PAIRS).add("times", _PAIRS).add("pair", "long").add("docs", "long")


def _whole(spec: Broadcast, schema: T.StructType):
    """Texts of one part each: their results and pairs, and the pairs' counts."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _units_of(spec)
        for batch in batches:
            ids = batch.column("id")
            rows, numbers, digests, pairs, times, held = [], [], [], [], [], 0

            def done(rows: list, numbers: list, digests: list, pairs: list, times: list, ids: pa.Array = ids) -> Iterator[pa.RecordBatch]:
                columns = {name: pa.array(x, pa.int64()) for name, x in zip(NUMBERS, zip(*numbers, strict=True), strict=True)}
                yield _named(schema, columns | {
                    "id": ids.take(pa.array(rows, pa.int64())), "sha": pa.array(digests, pa.string()),
                    "pairs": _lists(pairs), "times": _lists(times)}, len(rows))
                pair, docs = np.unique(np.concatenate(pairs), return_counts=True)
                yield _named(schema, {"pair": pa.array(pair), "docs": pa.array(docs)}, len(pair))

            for chunk in _chunks(batch.column("text")):
                cut = [units(t) if t else [] for _, t in chunk]
                for (row, _), at in zip(chunk, known.places(cut), strict=True):
                    rows.append(row)
                    if len(at) and known.good[at].all():
                        numbers.append(known.counts[:, at].sum(axis=1).tolist())
                        digests.append(hashlib.sha256(";".join(map(known.texts.__getitem__, at.tolist())).encode()).hexdigest())
                        pair, n = np.unique(known._take(2, at), return_counts=True)
                    else:
                        numbers.append([0] * 4)
                        digests.append("")
                        pair = n = np.zeros(0, np.int64)
                    pairs.append(pair)
                    times.append(n)
                    held += len(pair)
                    if held >= _OUT_PAIRS:
                        yield from done(rows, numbers, digests, pairs, times)
                        rows, numbers, digests, pairs, times, held = [], [], [], [], [], 0
            if rows:
                yield from done(rows, numbers, digests, pairs, times)
    return work


# ------------------------------------------------- very long documents --
def _cut(limit: int):
    """Texts -> parts of whole units, at least ``limit`` characters each, with
    the byte of space + text at which they begin."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text"), strict=True):
                text, start, at = text.as_py(), 0, 0
                while start <= len(text):
                    cut = _START.search(text, start + limit) if len(text) - start > limit else None
                    end = cut.start() if cut else len(text)
                    part = text[start:end]
                    yield pa.RecordBatch.from_arrays([pa.array([rid]), pa.array([at], pa.int64()), pa.array([part])],
                                                     ["rid", "at", "text"])
                    at += len(part.encode()) + 1
                    start = end + 1
    return work


@dataclass
class Fragment:
    """What a byte range leaves open; ``first`` is the place of the first of
    its ranges that has a common end (-1: none, all tokens are in the prefix)."""
    key: int
    first: int = -1
    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    good: bool = True


def _plus(x: tuple[list[int], list[int]], y: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    return x[0] + y[0], x[1] + y[1]


def compose(x: Fragment, y: Fragment) -> tuple[Fragment, tuple[int, tuple[list[int], list[int]]] | None]:
    """x before y, and the group (with its place) that closes between them."""
    good = x.good and y.good
    if y.first < 0:
        if x.first < 0:
            return Fragment(x.key, -1, _plus(x.prefix, y.prefix), ([], []), good), None
        return Fragment(x.key, x.first, x.prefix, _plus(x.suffix, y.prefix), good), None
    if x.first < 0:
        return Fragment(x.key, y.first, _plus(x.prefix, y.prefix), y.suffix, good), None
    return Fragment(x.key, x.first, x.prefix, y.suffix, good), (y.first, _plus(x.suffix, y.prefix))


@dataclass
class Closed:
    """A run of closed groups at a place of a document."""
    key: int
    inner: bool           # behind the group that ends with the place's first common end
    text: str
    numbers: list[int]
    pairs: np.ndarray
    times: np.ndarray


def _closed(tokens: Tokens, key: int, inner: bool, a: np.ndarray, b: np.ndarray) -> Closed:
    """Groups of tokens that begin and end together."""
    ends_a, ends_b = np.cumsum(tokens.size_a[a]), np.cumsum(tokens.size_b[b])
    common = _common(ends_a, ends_b)
    text, _ = group_text(tokens, a, ends_a, b, ends_b, common)
    ends, found = linked(a, ends_a, b, ends_b)
    pairs, times = np.unique(found, return_counts=True)
    return Closed(key, inner, text[:-1], [len(a), len(b), len(common), len(ends)], pairs, times)


def fragment(tokens: Tokens, key: int, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray,
             ends_b: np.ndarray) -> tuple[Fragment, Closed | None]:
    """The fragment of the tokens that end in one byte range."""
    common = _common(ends_a, ends_b)
    if not len(common):
        return Fragment(key, -1, (a.tolist(), b.tolist())), None
    (a1, a2), (b1, b2) = (np.searchsorted(e, common[[0, -1]]) + 1 for e in (ends_a, ends_b))
    open_ = Fragment(key, key, (a[:a1].tolist(), b[:b1].tolist()), (a[a2:].tolist(), b[b2:].tolist()))
    return open_, _closed(tokens, key, True, a[a1:a2], b[b1:b2]) if a2 > a1 else None


_OPEN = ["prefix_a", "prefix_b", "suffix_a", "suffix_b"]
# Fragments (text null) and runs of closed groups.
PART_SCHEMA = T.StructType([T.StructField("rid", T.LongType()), T.StructField("key", T.LongType()),
                            T.StructField("first", T.LongType()), T.StructField("good", T.BooleanType()),
                            *[T.StructField(n, _PAIRS) for n in _OPEN], T.StructField("inner", T.BooleanType()),
                            T.StructField("text", T.StringType()), *[T.StructField(n, T.LongType()) for n in NUMBERS],
                            T.StructField("pairs", _PAIRS), T.StructField("times", _PAIRS)])


def _open_row(rid: int, f: Fragment) -> dict:
    return {"rid": rid, "key": f.key, "first": f.first, "good": f.good} | dict(zip(_OPEN, (*f.prefix, *f.suffix), strict=True))


def _closed_row(rid: int, c: Closed) -> dict:
    return {"rid": rid, "key": c.key, "inner": c.inner, "text": c.text, "pairs": c.pairs, "times": c.times} | dict(
        zip(NUMBERS, c.numbers, strict=True))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.RecordBatch.from_arrays(
        [pa.array([r.get(f.name) for r in rows], to_arrow_type(f.dataType)) for f in PART_SCHEMA.fields], PART_SCHEMA.names)


def _fragments(spec: Broadcast, span: int):
    """Parts of texts -> a fragment for each multiple of ``span`` bytes they
    reach into, and its closed groups."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _units_of(spec)
        size_a, size_b = known.tokens.size_a, known.tokens.size_b
        for batch in batches:
            for rid, lo, text in zip(*(batch.column(c).to_pylist() for c in ("rid", "at", "text")), strict=True):
                at = known.places([units(text) if text else [""]])[0]
                begin = lo // span
                if not known.good[at].all():
                    yield _batch([_open_row(rid, Fragment(2 * begin + 1, good=False))])
                    continue
                a, b = known._take(0, at), known._take(1, at)
                ends_a, ends_b = lo + np.cumsum(size_a[a]), lo + np.cumsum(size_b[b])
                for r in range(begin, (int(ends_a[-1]) - 1) // span + 1):
                    # a part starts in its first range behind what an earlier part left there
                    (a1, a2), (b1, b2) = (np.searchsorted(e, [r * span, (r + 1) * span], "right") for e in (ends_a, ends_b))
                    open_, closed = fragment(known.tokens, 2 * r + (r == begin), a[a1:a2], ends_a[a1:a2], b[b1:b2], ends_b[b1:b2])
                    yield _batch([_open_row(rid, open_)] + ([_closed_row(rid, closed)] if closed else []))
    return work


def _fragment_of(row) -> Fragment:
    return Fragment(row.key, row.first, (list(row.prefix_a), list(row.prefix_b)), (list(row.suffix_a), list(row.suffix_b)), row.good)


def _reduced(spec: Broadcast, last: bool):
    """Neighbouring fragments of a document -> one, and the groups closed
    between them; the last one's prefix and suffix are groups themselves."""
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        tokens = _units_of(spec).tokens
        group = lambda key, ab: _closed_row(rid, _closed(tokens, key, False, *(np.array(x, np.int64) for x in ab)))
        rid, total, out = int(rows["rid"].iloc[0]), None, []
        for row in rows.sort_values("key").itertuples(index=False):
            if total is None:
                total, closed = _fragment_of(row), None
            else:
                total, closed = compose(total, _fragment_of(row))
            if closed:
                out.append(group(*closed))
        if last and total.good:
            out += [group(total.first, total.prefix)] if total.prefix[0] else []
            out += [group(total.key + (1 << 62), total.suffix)] if total.suffix[0] else []
        out.append(_open_row(rid, total))
        return pd.DataFrame([{n: r.get(n) for n in PART_SCHEMA.names} for r in out], dtype=object)
    return work


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of groups in order -> one digest per document."""
    at, sha = None, None
    for batch in batches:
        for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if rid != at:
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([sha.hexdigest()])], ["rid", "sha"])
                at, sha = rid, hashlib.sha256(text.encode())
            else:
                sha.update(b";" + text.encode())
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([sha.hexdigest()])], ["rid", "sha"])


def _align_long(docs: DataFrame, spec: Broadcast, long: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rid, id), results by rid, and linked pairs (rid, pair, times) of documents longer than a part."""
    named = store(docs.select(F.monotonically_increasing_id().alias("rid"), "id", "text"), "align-long")
    parts = named.select("rid", "text").mapInArrow(_cut(long), "rid long, at long, text string")
    parts = parts.repartition(F.xxhash64("rid", "at"))
    level = store(parts.mapInArrow(_fragments(spec, long), PART_SCHEMA), "align-parts")
    closed = level.filter("text is not null")
    level = level.filter("text is null")
    top, turn = level.agg(F.coalesce(F.max("key"), F.lit(0))).first()[0], 1
    while True:
        last = top >> (FAN_BITS * turn) == 0
        near = level.groupBy("rid", F.shiftright("key", FAN_BITS * turn).alias("near"))
        both = store(near.applyInPandas(_reduced(spec, last), PART_SCHEMA), "align-level")
        closed, level = closed.unionByName(both.filter("text is not null")), both.filter("text is null")
        if last:
            break
        turn += 1
    fits = level.filter("good").select("rid")
    closed = closed.join(fits, "rid")
    sums = closed.groupBy("rid").agg(*[F.sum(n).alias(n) for n in NUMBERS])
    ordered = closed.select("rid", "key", "inner", "text").repartition("rid").sortWithinPartitions("rid", "key", "inner")
    found = sums.join(ordered.select("rid", "text").mapInArrow(_digest, "rid long, sha string"), "rid")
    pairs = closed.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(
        "rid", F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("times"))
    return named.select("rid", "id"), found, store(pairs, "align-long-pairs")


# --------------------------------------------------------------- counts --
def _valued(head: Broadcast, schema: T.StructType):
    """Documents' pairs -> sums over pairs of the head, and one row for each
    other pair (n_best null)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = head.value
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            lists = batch.column("pairs")
            owner = np.repeat(np.arange(len(rid)), lists.value_lengths().to_numpy())
            pairs, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            n_best, total = np.zeros(len(rid), np.int64), np.zeros(len(rid), np.int64)
            np.add.at(n_best, owner[known], times[known] * best[at[known]])
            np.add.at(total, owner[known], times[known] * counts[at[known]])
            yield _named(schema, {"rid": pa.array(rid), "n_best": pa.array(n_best), "count_sum": pa.array(total)}, len(rid))
            rest = ~known
            if rest.any():
                yield _named(schema, {"rid": pa.array(rid[owner[rest]]), "pair": pa.array(pairs[rest]),
                                      "times": pa.array(times[rest])}, int(rest.sum()))
    return work


def _read_checked(path: str) -> bytes:
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"tokenizer over {MAX_FILE_BYTES} bytes: {path}")
    with open(path, "rb") as f:
        return f.read()


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None,
          path_b: str | None = None, long: int = LONG, head_size: int = HEAD) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    spec = sc.broadcast((_read_checked(path_a or public_tokenizers.path(FILE_A)),
                         _read_checked(path_b or public_tokenizers.path(FILE_B))))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > long
    schema = _whole_schema(texts.schema["id"].dataType)
    first = texts.filter(~is_long).mapInArrow(_whole(spec, schema), schema)
    first = store(first.withColumn("rid", F.monotonically_increasing_id()), "align-docs")
    long_names, long_found, long_pairs = _align_long(texts.filter(is_long), spec, long)

    counted = first.filter("pair is not null").select("pair", "docs").unionByName(
        long_pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("docs")))
    counts = store(counted.groupBy("pair").agg(F.sum("docs").alias("c")), "align-pairs")
    id_a = F.shiftright("pair", 32).alias("a")
    most = counts.groupBy(id_a).agg(F.max("c").alias("most"))
    counts = store(counts.withColumn("a", id_a).join(most, "a").select(
        "pair", "c", (F.col("c") == F.col("most")).alias("best")), "align-counts")
    # The head: all pairs counted at least so often that there are no more than head_size.
    least, so_far = 1 << 62, 0
    for c, w in counts.groupBy("c").agg(F.count(F.lit(1)).alias("w")).orderBy(F.desc("c")).limit(head_size).collect():
        so_far += w
        if so_far > head_size:
            break
        least = c
    head = counts.filter(F.col("c") >= least).toArrow()
    keys, c, best = (head.column(n).to_numpy() for n in ("pair", "c", "best"))
    order = np.argsort(keys)
    head = sc.broadcast((keys[order].astype(np.int64), c[order].astype(np.int64), best[order].astype(bool)))

    short = first.filter("pair is null")
    value = T.StructType([T.StructField(n, T.LongType()) for n in ("rid", "n_best", "count_sum", "pair", "times")])
    valued = store(short.select("rid", "pairs", "times").mapInArrow(_valued(head, value), value), "align-valued")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("c")).alias("count_sum")]
    tail = valued.filter("pair is not null").select("rid", "pair", "times").join(counts, "pair").groupBy("rid").agg(*sums)
    known = valued.filter("pair is null").select("rid", "n_best", "count_sum")
    total = known.unionByName(tail).groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = short.select("rid", "id", *NUMBERS, "sha").join(total, "rid")
    long_total = long_pairs.join(counts, "pair").groupBy("rid").agg(*sums)
    long_out = long_names.join(long_found.join(long_total, "rid"), "rid", "left")
    columns = ["id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in (*NUMBERS, "n_best", "count_sum")],
               F.coalesce("sha", F.lit("")).alias("groups_sha256")]
    return out.select(*columns).unionByName(long_out.select(*columns))
