"""Byte-level BPE by a local rank file, with the tiktoken library.

The driver reads the rank file (its size is checked) and broadcasts its bytes;
each Python worker builds one encoder from them.  Texts longer than
``PART_CHARS`` are cut first, only before a single space between two word
characters: the pre-split pattern always begins a new match there, so the
parts encode to the same ids as the whole.  Decoding joins raw token bytes,
which restores the text byte for byte.

Defined results: a null text encodes like an empty one, to no ids; null ids
decode to no bytes.  Special-token strings are ordinary text.  Rows are
independent, so repeated rows, ties and extra columns of any name do no harm,
and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from casekit.functions.workers import ship_with_tasks
from casekit.llm.common import worker_cache

ship_with_tasks(__name__)

RANK_FILE = "byte_bpe_50k.tiktoken"
MAX_RANK_BYTES = 64 << 20  # bound on what is broadcast
PART_CHARS = 1 << 16
OUT_IDS = 1 << 20  # ids (or bytes) after which a worker hands on what it has
_CUT = re.compile(r"(?<=\w) (?=\w)")


def split_long(text: str, limit: int = PART_CHARS) -> Iterator[str]:
    """Parts of ``text`` of about ``limit`` characters, cut where a pre-split
    match begins; a stretch without such a place stays whole."""
    start = 0
    while len(text) - start > limit:
        cut = _CUT.search(text, start + limit)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encoder(rank_bytes: bytes, pattern: str) -> tiktoken.Encoding:
    key = ("bpe", hashlib.sha256(rank_bytes + pattern.encode()).digest())
    cache = worker_cache()
    if key not in cache:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_bytes.splitlines())}
        cache[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return cache[key]


class ByteBpe:
    """Column functions that encode texts and decode ids by one rank file."""

    def __init__(self, spark: SparkSession, rank_path: str | None = None, pattern: str = public_tokenizers.PATTERN):
        path = rank_path or public_tokenizers.path(RANK_FILE)
        if os.path.getsize(path) > MAX_RANK_BYTES:
            raise ValueError(f"rank file over {MAX_RANK_BYTES} bytes: {path}")
        with open(path, "rb") as f:
            ranks = spark.sparkContext.broadcast(f.read())

        @F.arrow_udf("array<int>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            enc = encoder(ranks.value, pattern)
            for texts in batches:
                flat, ends = [np.zeros(0, np.int32)], [0]
                for text in texts:  # one Python string at a time
                    parts = [enc.encode_to_numpy(p).astype(np.int32) for p in split_long(text.as_py() or "")]
                    flat += parts
                    ends.append(ends[-1] + sum(map(len, parts)))
                    if ends[-1] > OUT_IDS:
                        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
                        flat, ends = [np.zeros(0, np.int32)], [0]
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))

        @F.arrow_udf("binary")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            enc = encoder(ranks.value, pattern)
            for ids in batches:
                out, size = [], 0
                for x in ids:
                    out.append(enc.decode_bytes(x.values.to_numpy().tolist()) if x.is_valid and len(x) else b"")
                    size += len(out[-1])
                    if size > OUT_IDS:
                        yield pa.array(out, pa.binary())
                        out, size = [], 0
                yield pa.array(out, pa.binary())

        self._encode, self._decode = encode, decode

    def encode(self, text: Column | str) -> Column:
        """Token ids of a text as ``array<int>``."""
        return self._encode(text)

    def decode(self, ids: Column | str) -> Column:
        """The bytes that ids stand for."""
        return self._decode(ids)


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(ids.cast("array<string>"), " ")
