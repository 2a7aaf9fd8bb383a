"""Words and word n-grams of many texts at once, as 64-bit hashes in numpy.

Texts arrive as one Arrow binary column. Word bounds come from a byte table,
word hashes from prefix sums of a polynomial over the bytes, n-gram hashes from
prefix sums of a polynomial over word hashes; both are mixed at the end. So no
Python object is made for a word, and the cost follows the bytes read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Any odd numbers serve; they only have to be the same in all tasks.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = np.where((IDENTITY >= 0x41) & (IDENTITY <= 0x5A), IDENTITY + 32, IDENTITY).astype(np.uint8)
SPACE = np.isin(IDENTITY, [0x20, *range(0x09, 0x0E)])

#: Bytes of text that callers take at once, and bytes or words that are hashed at once: arrays of eight bytes for each are held.
CHUNK_BYTES, BLOCK = 1 << 20, 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.full(BLOCK, base, np.uint64)]).cumprod(dtype=np.uint64)


class _Base:
    """The first BLOCK + 1 powers of a base and of its inverse, modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = _powers(self.base), _powers(self.inverse)


_BYTES, _WORDS, _CHECKS = _Base(BYTE_BASE), _Base(WORD_BASE), _Base(0xA24BAED4963EE407)


@dataclass
class Words:
    """The words of several texts: ``bounds[i]:bounds[i + 1]`` are text i's; ``starts`` and ``ends`` are places in the bytes."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def places(self) -> np.ndarray:
        """Each word's place in its text."""
        return np.arange(len(self.hashes)) - np.repeat(self.bounds[:-1], self.counts)

    def checks(self, n: int) -> np.ndarray:
        """Of each n-gram of ngrams(n) a second hash, by another base."""
        return self.ngrams(n, _CHECKS)[1]

    def ngrams(self, n: int, by: _Base = _WORDS) -> tuple[np.ndarray, np.ndarray]:
        """(indices of the words at which an n-gram within one text starts, its hash)."""
        total = len(self.hashes)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        left = np.repeat(self.bounds[1:], self.counts) - np.arange(total)
        at = np.flatnonzero(left >= n)
        out = np.empty(len(at), np.uint64)
        step = BLOCK - n
        for first in range(0, total, step):  # a gram's hash doesn't depend on the block
            lo, hi = np.searchsorted(at, [first, first + step])
            part = self.hashes[first : first + BLOCK]
            sums = np.concatenate([np.zeros(1, np.uint64), (part * by.up[: len(part)]).cumsum(dtype=np.uint64)])
            own = at[lo:hi] - first
            out[lo:hi] = mix((sums[own + n] - sums[own]) * by.down[own] + np.uint64(n))
        return at, out


def hash_words(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = IDENTITY, separator: np.ndarray = SPACE) -> Words:
    """``data[offsets[i]:offsets[i + 1]]`` is text i; ``fold`` maps bytes before hashing."""
    offsets = offsets.astype(np.int64)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = ~separator[data]
    edges = offsets[:-1][offsets[:-1] < n]
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    before[edges] = after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    from_, to = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    inverse = np.empty(len(starts), np.uint64)
    base, up, down = 0, 1, 1  # the sum before the block, and the powers at its start
    for first in range(0, n, BLOCK):
        part = fold[data[first : first + BLOCK]].astype(np.uint64) + np.uint64(1)
        local = np.concatenate([np.zeros(1, np.uint64), (part * _BYTES.up[: len(part)]).cumsum(dtype=np.uint64)])
        lo, hi = np.searchsorted(starts, [first, first + BLOCK])
        own = starts[lo:hi] - first
        from_[lo:hi], inverse[lo:hi] = np.uint64(base) + np.uint64(up) * local[own], np.uint64(down) * _BYTES.down[own]
        lo, hi = np.searchsorted(ends, [first, first + BLOCK], "right")
        to[lo:hi] = np.uint64(base) + np.uint64(up) * local[ends[lo:hi] - first]
        base = (base + up * int(local[-1])) % (1 << 64)
        up, down = up * pow(_BYTES.base, len(part), 1 << 64) % (1 << 64), down * pow(_BYTES.inverse, len(part), 1 << 64) % (1 << 64)
    return Words(mix((to - from_) * inverse), np.searchsorted(starts, offsets), starts, ends)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def text_chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, data, offsets) of runs of texts of about ``chunk_bytes``; a longer text is a run of its own."""
    data, offsets = _binary(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk_bytes, "right")) - 1)
        yield at, to, data, offsets[at : to + 1]
        at = to
