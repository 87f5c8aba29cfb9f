"""Identifiers of byte strings at every position, and sparse anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from casekit.functions.workers import ship_with_tasks

ship_with_tasks(__name__)

LENGTH = 200          # bytes of a repeated string
GRAM = 100            # bytes of an anchor's bucket
SPAN = LENGTH - GRAM  # an anchor lies at most so far behind a string's start
CHUNK = 1 << 19
SEGMENT = 1 << 23     # positions inside a segment fit 24 bits
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of a string from those of its front and its back part."""
    x = a * _K1 + ((b << np.uint64(29)) | (b >> np.uint64(35))) * _K2
    return x ^ (x >> np.uint64(31))


def grams(raw: np.ndarray) -> np.ndarray:
    """Identifiers of the 100-byte strings at all positions (n >= 100).

    Initial buckets are 8-byte strings, exactly; each is refined by the bucket
    identifier at a later offset: 8, 16, 32, 64, then 100 by two overlapping 64.
    """
    b = raw.astype(np.uint64)
    for k in (1, 2, 4):
        b = b[:-k] | (b[k:] << np.uint64(8 * k))
    for k in (8, 16, 32, GRAM - 64):
        b = join(b[:-k], b[k:])
    return b


def _anchors(raw: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every start of a 200-byte string the position, in its first 101, of
    the smallest bucket identifier (the first of equal ones)."""
    low = (ids >> np.uint64(24) << np.uint64(24)) | np.arange(len(ids), dtype=np.uint64)
    k = 1
    while 2 * k <= SPAN + 1:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    rest = SPAN + 1 - k
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    return (low & np.uint64(0xFFFFFF)).astype(np.int64)


def _changes(a: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], a[1:] != a[:-1]))


def anchor_buckets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row number, position, bucket) of the anchors of a binary array's texts.

    Whatever two places hold equal 200-byte strings, both have an anchor at the
    same distance behind the string's start, with the same bucket.
    """
    data, offsets = _buffers(texts)
    row, n_rows = 0, len(offsets) - 1
    while row < n_rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        if last == row + 1 and offsets[last] - offsets[row] > SEGMENT:
            yield from _long(data[offsets[row]:offsets[last]], row)
        else:
            raw = data[offsets[row]:offsets[last]]
            if len(raw) >= LENGTH:
                ids = grams(raw)
                at = _anchors(raw, ids)
                owner = np.repeat(np.arange(row, last), np.diff(offsets[row:last + 1]))
                at = at[owner[:len(at)] == owner[LENGTH - 1:]]  # strings inside one text
                if len(at):
                    at = at[_changes(at)]
                    yield owner[at], at - (offsets[owner[at]] - offsets[row]), ids[at]
        row = last


def _long(raw: np.ndarray, row: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The anchors of one very long text, segment by segment."""
    before = -1
    for start in range(0, len(raw) - LENGTH + 1, SEGMENT):
        part = raw[start:start + SEGMENT + LENGTH - 1]
        ids = grams(part)
        at = _anchors(part, ids)
        at = at[_changes(at)]
        keep = at + start != before  # the last segment's last anchor may go on
        before = int(at[-1]) + start
        at = at[keep]
        yield np.full(len(at), row), at + start, ids[at]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary array's bytes and offsets; nulls count as empty."""
    if texts.null_count:
        texts = texts.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


class Buckets:
    """Bucket identifiers of one text's strings of 100 to 300 bytes."""

    def __init__(self, raw: np.ndarray):
        self.size = len(raw)
        self.g100 = grams(raw)
        self.g200 = join(self.g100[:-GRAM], self.g100[GRAM:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Identifiers of [start, stop): the bucket at the start refined by the
        bucket that ends at the stop."""
        wide = stop - start >= LENGTH
        a = np.where(wide, self.g200[np.where(wide, start, 0)], self.g100[start])
        b = np.where(wide, self.g200[np.where(wide, stop - LENGTH, 0)], self.g100[stop - GRAM])
        return join(a, join(b, (stop - start).astype(np.uint64)))
