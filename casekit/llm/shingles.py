"""Word hashes of whole texts, vectorised, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from casekit.functions.workers import ship_with_tasks

ship_with_tasks(__name__)

GAPS = b" \t\n\x0b\x0c\r"
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(text number, part): long texts are cut where white space begins."""
    for i, t in enumerate(texts):
        start = 0
        while len(t) - start > CHUNK_BYTES:
            cut = min((p for p in (t.find(bytes([g]), start + CHUNK_BYTES) for g in GAPS) if p >= 0), default=-1)
            if cut < 0:
                break
            yield i, t[start:cut]
            start = cut
        yield i, t[start:] if start else t


def split_words(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some parts joined by spaces: first byte, size and hash of
    each, and how many words each part has."""
    raw = np.frombuffer(b" ".join(parts), np.uint8)
    table = np.zeros(256, bool)
    table[list(GAPS)] = True
    gap = table[raw]
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64), np.zeros(len(parts), np.int64)
    ends = np.flatnonzero(~gap & np.concatenate((gap[1:], [True]))) + 1
    sizes = ends - starts
    letters = raw[~gap].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(sizes) - sizes
    powers = np.full(int(sizes.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    letters *= powers[np.arange(len(letters)) - np.repeat(first, sizes)]
    begins = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
    counts = np.diff(np.searchsorted(starts, np.append(begins, len(raw) + 1)))
    return starts, sizes, mix(np.add.reduceat(letters, first) + sizes.astype(np.uint64)), counts


def _hash_chunk(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some parts, and how many words each part has."""
    _, _, hashes, counts = split_words(parts)
    return hashes, counts


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """One array of word hashes per text, in order.

    Works on about ``CHUNK_BYTES`` at a time, whatever the batch holds.
    """
    def flush(chunk: list[tuple[int, bytes]]) -> None:
        hashes, counts = _hash_chunk([p for _, p in chunk])
        at = 0
        for (i, _), n in zip(chunk, counts.tolist(), strict=True):
            if done and done[-1][0] == i:
                done[-1][1].append(hashes[at:at + n])
            else:
                done.append((i, [hashes[at:at + n]]))
            at += n

    done: list[tuple[int, list[np.ndarray]]] = []
    chunk, size = [], 0
    with np.errstate(over="ignore"):
        for piece in pieces(texts):
            chunk.append(piece)
            size += len(piece[1])
            if size >= CHUNK_BYTES:
                flush(chunk)
                chunk, size = [], 0
                for _, arrays in done[:-1]:  # the last text may go on
                    yield arrays[0] if len(arrays) == 1 else np.concatenate(arrays)
                del done[:-1]
        if chunk:
            flush(chunk)
        for _, arrays in done:
            yield arrays[0] if len(arrays) == 1 else np.concatenate(arrays)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct ``width``-word shingles, sorted; a shorter text is one shingle,
    a text without words none."""
    n = len(words)
    if not n:
        return words
    w = min(width, n)
    with np.errstate(over="ignore"):
        acc = np.full(n - w + 1, np.uint64(w), np.uint64)
        for k in range(w):
            step = np.uint64(pow(int(_STEPS[k % 4]), k // 4 + 1, 1 << 64))
            acc += words[k:n - w + 1 + k] * step
        return np.unique(mix(acc, 1))
