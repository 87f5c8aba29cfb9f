"""Packing token ids into sequences: hierarchical residual best fit.

A document's ids end with ``end_id``.  Documents longer than a sequence are cut
into pieces of a whole sequence; only the last piece may be shorter.  Whole
pieces are sequences of their own.  All others are packed in rounds:

* Round 0, where the texts are encoded: a task packs its pieces best fit, the
  longest first, ``GROUP`` pieces at a time.
* Sequences that are nearly full (room for ``NEAR`` ids at most) are emitted.
* Every later round deals the underfull sequences of the round before to
  groups, and packs them as items: whole sequences are joined, best fit, the
  fullest first.  The rounds end with the round that has one group, or with one
  that several groups could hardly shorten (``STALL``): their sequences are too
  full to be joined at all, whatever they meet.

Scale: pieces travel with their sequence (id, piece, start, length, checksum --
not their ids), so nothing is joined back and only underfull sequences are
shuffled.  A group holds ``GROUP`` sequences and ``GROUP_PIECES`` pieces on
average, dealt by hash, at every size of the input; groups grow in number.
Every round is written to the shared checkpoint folder.

Encoding: the tokenizer drops white space and merges nothing across it, so
words are encoded apart, each distinct one once per worker (as long as ``WORDS``
distinct ones fit); ASCII words are put together from their distinct parts.

Defined results: a null or empty text has the end id only.  Null ids and rows
repeated in full are documents of their own.  Very long texts are read in parts
and give their pieces as they come.  An empty table gives an empty result;
extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from casekit.functions.workers import ship_with_tasks
from casekit.llm.common import store, worker_cache
from casekit.llm.shingles import pieces as parts_of

ship_with_tasks(__name__)

TOKENIZER = "word_bpe_49k.json"
MAX_TOKENIZER_BYTES = 64 << 20  # bound on what is broadcast
LENGTH = 2048
END_ID = 0
NEAR = 4
GROUP = 1 << 16
GROUP_PIECES = 1 << 20
STALL = 0.02
WORDS = 1 << 20
_CHUNK = 4 << 20
_WORDS_AT_ONCE = 1 << 16
_ROUND_BITS = 6
_FIELDS = ["piece", "start", "length", "ids_crc32", "offset"]


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every item: the largest item first, into the
    sequence with the least room that still holds it."""
    seq, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    with_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms, count = 0, 0  # rooms: bit r is set if some sequence has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            s = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, s, count = length, count, count + 1
        seq[i], offset[i] = s, length - room
        room -= size
        if room:
            with_room[room].append(s)
            rooms |= 1 << room
    return seq, offset


# The form of tokenizer whose ASCII words are taken apart here: lower-cased, cut
# by this pattern, each match encoded by itself with an end-of-word token.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+| ")


class _Kept:
    """Runs of ids by number, in one flat array."""

    def __init__(self):
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes, self.ids = np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, ids))

    def of(self, at: np.ndarray) -> np.ndarray:
        n = self.sizes[at]
        return self.ids[np.repeat(self.starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class WordIds:
    """Token ids of words, each distinct word encoded once; ASCII words from
    their distinct parts."""

    def __init__(self, spec: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.parts_only = Tokenizer.from_str(spec.decode()), None
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        form = json.loads(spec)
        before, cut = form.get("normalizer") or {}, form.get("pre_tokenizer") or {}
        known = ([n["type"] for n in before.get("normalizers", [])] == _NORMALIZERS
                 and [c.get("pattern", {}).get("Regex") for c in cut.get("pretokenizers", [])][:1] == [_PATTERN])
        suffix = form["model"].get("end_of_word_suffix")
        if known and suffix:
            self.parts_only = Tokenizer.from_str(spec.decode())
            self.parts_only.normalizer = None
            self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
            for token, i in self.tokenizer.get_vocab().items():
                self.ends_word[i] = token.endswith(suffix)
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = defaultdict(count().__next__)  # words are numbered as they come
        self.words, self.parts = _Kept(), _Kept()
        self.part_place: dict[str, int] = defaultdict(count(1).__next__)
        self.part_place[" "] = 0
        self.parts.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _by_offsets(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each word has): the words in one text, told apart by
        where their tokens lie."""
        text = [w.decode("utf-8", "replace") for w in words]
        if any(t in b" ".join(words) for t in self.added):
            found = [e.ids for e in self.tokenizer.encode_batch(text, add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.uint32), np.array(list(map(len, found)), np.int64)
        e = self.tokenizer.encode(" ".join(text), add_special_tokens=False)
        ends = np.cumsum(np.array(list(map(len, text)), np.int64) + 1)
        owner = np.searchsorted(ends, np.array([s for s, _ in e.offsets], np.int64), "right")
        return np.array(e.ids, np.uint32), np.bincount(owner, minlength=len(words))

    def _by_parts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = _ASCII.findall(b" ".join(words).decode().lower())
        known = len(self.part_place)
        at = np.fromiter(map(self.part_place.__getitem__, found), np.int64, len(found))
        if len(self.part_place) > known:
            new = list(islice(self.part_place, known, None))
            ids = np.array(self.parts_only.encode(" ".join(new), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids])
            self.parts.add(ids, np.diff(ends, prepend=-1))
        word = np.cumsum(at == 0)
        return self.parts.of(at), np.bincount(word, self.parts.sizes[at], len(words)).astype(np.int64)

    def _add(self, words: list[bytes]) -> None:
        for lo in range(0, len(words), _WORDS_AT_ONCE):
            run = words[lo:lo + _WORDS_AT_ONCE]
            plain = np.array([self.parts_only is not None and w.isascii() and not (b"<" in w and any(t in w for t in self.added))
                              for w in run])
            ids, sizes = np.zeros(0, np.uint32), np.zeros(len(run), np.int64)
            starts = sizes.copy()
            for rows, encode in ((np.flatnonzero(plain), self._by_parts), (np.flatnonzero(~plain), self._by_offsets)):
                if len(rows):
                    new, n = encode([run[i] for i in rows])
                    starts[rows], sizes[rows] = len(ids) + np.cumsum(n) - n, n
                    ids = np.concatenate((ids, new))
            self.words.starts = np.concatenate((self.words.starts, len(self.words.ids) + starts))
            self.words.sizes, self.words.ids = np.concatenate((self.words.sizes, sizes)), np.concatenate((self.words.ids, ids))

    def of(self, parts: list[bytes]) -> list[np.ndarray]:
        """The ids of some texts (or parts of texts, cut at white space)."""
        words = [p.split() for p in parts]
        if len(self.place) > WORDS:
            self.clear()
        known = len(self.place)
        places = [np.fromiter(map(self.place.__getitem__, ws), np.int64, len(ws)) for ws in words]
        if len(self.place) > known:
            self._add(list(islice(self.place, known, None)))
        return [self.words.of(at) for at in places]


def word_ids(spec: bytes) -> WordIds:
    cache = worker_cache()
    key = ("word ids", hashlib.sha256(spec).digest())
    if key not in cache:
        cache[key] = WordIds(spec)
    return cache[key]


def _parts(batch: pa.RecordBatch) -> Iterator[list[tuple[int, bytes, bool]]]:
    """Lists of (row, part of its text, whether it is the last), about
    ``_CHUNK`` bytes each; long texts come in several parts."""
    held, size = [], 0
    for row, text in enumerate(batch.column("text").cast(pa.binary())):
        parts = [p for _, p in parts_of([text.as_py() or b""])]
        for k, part in enumerate(parts):
            held.append((row, part, k == len(parts) - 1))
            size += len(part)
            if size >= _CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


class _Cutter:
    """Cuts the ids of one document after the other into pieces."""

    def __init__(self, length: int, end_id: int):
        self.length, self.end = length, np.array([end_id], np.uint32)
        self.held, self.piece = np.zeros(0, np.uint32), 0

    def add(self, ids: np.ndarray, last: bool) -> Iterator[tuple[int, int, int, int]]:
        """(piece, start, length, checksum) of the pieces that are complete."""
        held = np.concatenate((self.held, ids, self.end[:last]))
        whole = -(-len(held) // self.length) if last else len(held) // self.length
        for k in range(self.piece, self.piece + whole):
            piece, held = held[:self.length], held[self.length:]
            yield k, k * self.length, len(piece), zlib.crc32(piece.astype("<u4").tobytes())
        self.held, self.piece = held, 0 if last else self.piece + whole


def _bins(ids: pa.Array, fields: np.ndarray, cuts: np.ndarray, near: int, length: int) -> pa.RecordBatch:
    """Sequences from their pieces, in order; ``cuts``: where sequences begin."""
    used = np.add.reduceat(fields[2], cuts[:-1])
    members = pa.StructArray.from_arrays(
        [ids, pa.array(fields[0], pa.int32()), *[pa.array(x, pa.int64()) for x in fields[1:]]], ["id", *_FIELDS])
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int64()), pa.array(used >= length - near), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), members)],
        ["used", "full", "members"])


def _joined(ids: pa.Array, fields: np.ndarray, firsts: np.ndarray, length: int, near: int) -> pa.RecordBatch:
    """Pack items, each a run of pieces that begins at ``firsts``."""
    counts = np.diff(np.append(firsts, fields.shape[1]))
    sizes = np.add.reduceat(fields[2], firsts)
    seq, offset = best_fit(sizes, length)
    order = np.lexsort((offset, seq))
    n = counts[order]
    take = np.repeat(firsts[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    fields = fields[:, take]
    fields[4] += np.repeat(offset[order], n)
    begins = np.flatnonzero(np.concatenate(([True], seq[order][1:] != seq[order][:-1])))
    cuts = np.append((np.cumsum(n) - n)[begins], n.sum())
    return _bins(ids.take(pa.array(take)), fields, cuts, near, length)


def _encode_and_pack(spec: Broadcast, length: int, end_id: int, near: int, group: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, cutter = word_ids(spec.value), _Cutter(length, end_id)
        ids, rows = [], []

        def done(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            fields = np.array([(*r, 0) for r in rows], np.int64).T
            own = pa.array(ids, kind)
            whole = fields[2] == length
            if whole.any():
                at = np.flatnonzero(whole)
                yield _bins(own.take(pa.array(at)), fields[:, at], np.arange(len(at) + 1), near, length)
            if not whole.all():
                at = np.flatnonzero(~whole)
                yield _joined(own.take(pa.array(at)), fields[:, at], np.arange(len(at)), length, near)

        kind = pa.null()
        for batch in batches:
            kind = batch.column("id").type
            keys = batch.column("id").to_pylist()
            for parts in _parts(batch):
                for (row, _, last), found in zip(parts, enc.of([p for _, p, _ in parts]), strict=True):
                    for piece in cutter.add(found, last):
                        ids.append(keys[row])
                        rows.append(piece)
                        if len(rows) >= group:
                            yield from done(kind)
                            ids, rows = [], []
        if rows:
            yield from done(kind)
    return work


def _pack_again(length: int, near: int):
    """All sequences of a group -> fewer of them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            lists = pa.chunked_array([b.column("members") for b in got]).combine_chunks()
            counts = lists.value_lengths().to_numpy()
            values = lists.flatten()
            fields = np.stack([values.field(f).to_numpy().astype(np.int64) for f in _FIELDS])
            yield _joined(values.field("id"), fields, np.cumsum(counts) - counts, length, near)
    return work


def _stored(bins: DataFrame, number: int) -> DataFrame:
    name = F.shiftleft(F.monotonically_increasing_id(), _ROUND_BITS) + F.lit(number)  # given once, where it is written
    return store(bins.select(name.alias("sequence_id"), "used", "full", "members"), "packing-round")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
         length: int = LENGTH, end_id: int = END_ID, near: int = NEAR, group: int = GROUP) -> DataFrame:
    """(sequence_id, used, members): one row per sequence; its members are
    (id, piece, start, length, ids_crc32, offset), gapless by offset."""
    spark = docs.sparkSession
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    if os.path.getsize(path) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"tokenizer over {MAX_TOKENIZER_BYTES} bytes: {path}")
    with open(path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    member = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("piece", T.IntegerType()),
                           *[T.StructField(f, T.LongType()) for f in _FIELDS[1:]]])
    schema = T.StructType([T.StructField("used", T.LongType()), T.StructField("full", T.BooleanType()),
                           T.StructField("members", T.ArrayType(member))])
    size = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("members")), F.lit(0))).first()

    current = _stored(rows.mapInArrow(_encode_and_pack(spec, length, end_id, near, group), schema), 0)
    emitted, number = None, 0
    while True:
        out = current.filter("full")
        emitted = out if emitted is None else emitted.unionByName(out)
        under = current.filter("not full")
        n, members = size(under)
        if not n or number and (last_groups == 1 or n > (1 - STALL) * last_n):  # nothing more to gain
            return emitted.unionByName(under).drop("full")
        groups = max(1, -(-n // group), -(-members // GROUP_PIECES))
        number, last_groups, last_n = number + 1, groups, n
        dealt = under.repartition(groups, F.xxhash64("sequence_id")).sortWithinPartitions("sequence_id")
        current = _stored(dealt.select("members").mapInArrow(_pack_again(length, near), schema), number)


def placements(packed: DataFrame) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return packed.select("sequence_id", F.inline("members")).select(
        "id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
