"""Chat conversations rendered by a template, with offset-aligned loss masks.

Every turn becomes ``<|im_start|>ROLE<|im_sep|>TEXT<|im_end|>`` and a line feed.
Control strings inside roles and texts are escaped reversibly: a backslash goes
between ``<`` and ``|`` (one more where backslashes stand already), so a text
never holds ``<|``.  A conversation is rendered whole and encoded once with
character offsets; the tokens of each assistant text are found by binary search
of its span in the sorted token spans.

Scale: rows are dealt by conversation and sorted by turn, and each task streams
through them holding one conversation at a time.  A conversation of more than
``SEGMENT_CHARS`` characters goes on in further segments, cut between turns
(where the control tokens make the encoding equal to that of the whole), so
memory is bounded for a conversation of any length.

Defined results: null roles and texts count as empty; turns sort by number
(null first), then role, then text; repeated rows are turns of their own.  A
null conversation id is a conversation.  An empty table gives an empty result,
extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.functions.workers import ship_with_tasks
from casekit.llm.common import worker_cache

ship_with_tasks(__name__)

TOKENIZER_FILE = "byte_bpe_50k.json"
MAX_TOKENIZER_BYTES = 64 << 20  # bound on what is broadcast
SEGMENT_CHARS = 1 << 20
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"

FORMAT_SCHEMA = ("conv_id long, segment int, n_turns long, formatted string, ids array<int>, "
                 "starts array<int>, ends array<int>, loss array<boolean>")
DIGEST_SCHEMA = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                 "formatted_chars long")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns and the sorted spans of the
    loss role's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        parts += [head, body, END, "\n"]
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; the inverse of :func:`render`."""
    out = []
    for piece in formatted.split(START)[1:]:
        role, _, rest = piece.partition(SEP)
        out.append((unescape(role), unescape(rest[:rest.rindex(END)])))
    return out


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens overlap one of the sorted spans."""
    mask = np.zeros(len(starts), bool)
    if spans:
        s, e = np.array(spans).T
        for lo, hi in zip(np.searchsorted(ends, s, "right"), np.searchsorted(starts, e, "left"), strict=True):
            mask[lo:hi] = True
    return mask


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """What the masked tokens cover, one text per run of them, unescaped."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return [unescape(formatted[starts[a]:ends[b - 1]])
            for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _tokenizer(blob: bytes):
    from tokenizers import AddedToken, Tokenizer

    key = ("chat", hashlib.sha256(blob).digest())
    cache = worker_cache()
    if key not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = json.loads(blob)
        model["post_processor"] = None  # it would trim spaces off the offsets
        tok = Tokenizer.from_str(json.dumps(model))
        tok.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (START, SEP, END)])
        cache[key] = tok
    return cache[key]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, list[tuple[str, str]]]]:
    """(conversation, segment, turns) from rows sorted by conversation."""
    conv, segment, turns, size = None, 0, [], 0
    for batch in batches:
        for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
            if turns and (c != conv or size > SEGMENT_CHARS):
                yield conv, segment, turns
                segment, turns, size = (segment + 1 if c == conv else 0), [], 0
            conv = c
            turns.append((role or "", text or ""))
            size += len(turns[-1][1])
    if turns:
        yield conv, segment, turns


def _int_lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    sizes = np.cumsum([0] + [len(x) for x in arrays])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(arrays), kind))


def format_conversations(rows: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """conv_id, turn, role, text rows -> one row per conversation (segment):
    formatted text, token ids, token offsets and the loss mask.

    The result's rows stand in order within a task; :func:`read_back` relies
    on that.
    """
    path = tokenizer_path or public_tokenizers.path(TOKENIZER_FILE)
    if os.path.getsize(path) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"tokenizer file over {MAX_TOKENIZER_BYTES} bytes: {path}")
    with open(path, "rb") as f:
        blob = rows.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(blob.value)
        out, size = [], 0
        for conv, segment, turns in _grouped(batches):
            formatted, spans = render(turns)
            enc = tok.encode(formatted, add_special_tokens=False)
            offsets = np.array(enc.offsets, np.int32).reshape(-1, 2)
            starts, ends = offsets[:, 0], offsets[:, 1]
            out.append((conv, segment, len(turns), formatted, np.array(enc.ids, np.int32), starts, ends,
                        loss_mask(starts, ends, spans)))
            size += len(formatted)
            if size > SEGMENT_CHARS:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string()),
             _int_lists(c[4], pa.int32()), _int_lists(c[5], pa.int32()), _int_lists(c[6], pa.int32()),
             _int_lists(c[7], pa.bool_())],
            ["conv_id", "segment", "n_turns", "formatted", "ids", "starts", "ends", "loss"])

    ordered = rows.select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition("conv_id")
    return ordered.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(work, FORMAT_SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, from :func:`format_conversations`'s output:
    turns parsed from the text, loss text taken through the token mask.

    The segments of a conversation must come in order, as they do there; a table
    dealt otherwise raises and is to be sorted by conv_id and segment first."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
        state, last = None, (None, -1)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["segment"] and (row["conv_id"], row["segment"] - 1) != last:
                    raise ValueError(f"segment {row['segment']} of conversation {row['conv_id']} does not follow the one before it")
                last = row["conv_id"], row["segment"]
                if row["segment"] == 0:
                    if state:
                        out.append(state)
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse(row["formatted"])
                state[1] += len(turns)
                for role, text in turns:
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                arrays = [np.array(row[k]) for k in ("starts", "ends", "loss")]
                for text in masked_texts(row["formatted"], *arrays):
                    state[3] += len(text)
                    state[4].update(text.encode("utf-8", "surrogatepass"))
                state[5] += len(row["formatted"])
            if out:
                yield _digests(out, names)
        if state:
            yield _digests([state], names)

    def _digests(states: list[list], names: list[str]) -> pa.RecordBatch:
        rows = [[c, n, t.hexdigest(), lc, lt.hexdigest(), fc] for c, n, t, lc, lt, fc in states]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return formatted.mapInArrow(work, DIGEST_SCHEMA)
