"""Words and word-window hashes of whole Arrow text columns, without a Python loop per word.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  All functions work on one bounded chunk
of a batch, so memory does not depend on the number of rows; one very long text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 2)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


@dataclass
class Words:
    """Words of a chunk: ``first[d]:first[d + 1]`` are those of text ``d``."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of the texts; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) with at most ``limit`` bytes, or one longer text."""
    if not len(column):
        return
    raw, offsets = text_buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def words_of(raw: np.ndarray, offsets: np.ndarray, powers: Powers) -> Words:
    """Words and their 64-bit hashes (equal words have equal hashes at any place)."""
    n = len(raw)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(solid & ~after) + 1
    up, down = powers.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(raw, starts, ends, np.searchsorted(starts, offsets), hashes)


def _factor(j: int) -> np.uint64:
    """Odd factor of place ``j``; no linear rule, or windows with words swapped in pairs would hash alike."""
    return mix(np.full(1, (_BASE * (j + 1)) & (2**64 - 1), np.uint64))[0] | np.uint64(1)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive entries (runs may cross texts: see ``inside``)."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out += hashes[j:j + m] * _factor(j)
    return mix(out)


def inside(words: Words, k: int) -> np.ndarray:
    """Indexes of the ``k``-word windows that lie within one text."""
    m = len(words.starts) - k + 1
    if m <= 0:
        return np.empty(0, np.int64)
    doc = words.doc_of()
    return np.flatnonzero(doc[:m] == doc[k - 1:])


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each ``k``-word shingle; a shorter text with a word is one shingle."""
    at = inside(words, k)
    doc = words.doc_of()
    sizes = np.diff(words.first)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    extra = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        has = sizes[short] > j
        extra[has] += words.hashes[words.first[:-1][short[has]] + j] * _factor(j)
    extra = mix(extra)
    return np.concatenate([doc[at], short]), np.concatenate([window_hashes(words.hashes, k)[at], extra])
