"""Words and their hashes for whole Arrow batches, in NumPy.

A word is a run of bytes other than the six white-space bytes.  Its hash is a polynomial
over a random 64-bit value per byte, so that prefix sums over a block give the hashes of
all words at once.  ``A-Z`` count as ``a-z``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that are hashed at once; one longer text is a block of its own.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits (splitmix64's finish)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(salt)) * U64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    values = seeds(256, 7)
    lower = np.arange(256)
    lower[65:91] += 32
    inside = np.ones(256, bool)
    inside[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return values[lower], inside


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, U64), np.full(n, inverse, U64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more offset at the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1)
    at = at.astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def spans(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose bytes stay under ``limit``; a larger row is a run of its own."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = int(np.searchsorted(ends, ends[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def hash_words(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block, and where the words of each text begin."""
    values, inside = _byte_tables()
    if not len(body):
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    word = inside[body]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    before[heads] = False
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[heads[heads > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after)
    size = 1 << max(20, int(len(body) - 1).bit_length())
    up, down = _powers(size)
    sums = np.cumsum(values[body] * up[: len(body)])
    first = np.where(starts > 0, sums[starts - 1], U64(0))
    hashes = mix((sums[ends] - first) * down[starts])
    return hashes, np.searchsorted(starts, at)


def word_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, offsets of each row's words) by block."""
    body, at = buffers(texts)
    for i, j in spans(at, BLOCK_BYTES):
        yield (i, j, *hash_words(body[at[i] : at[j]], at[i : j + 1] - at[i]))


class Lookup:
    """Positions of 64-bit keys in a fixed list, for whole arrays (open addressing)."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, U64)
        self.at = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = (keys >> self.shift).astype(np.int64)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = np.flatnonzero(self.at[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.at[slot[won]], self.keys[slot[won]] = left[won], keys[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The position of each value, -1 where it is not a key."""
        slot = (x >> self.shift).astype(np.int64)
        at = self.at[slot]
        out = np.where(self.keys[slot] == x, at, -1)
        todo = np.flatnonzero((out < 0) & (at >= 0))
        slot = slot[todo]
        for _ in range(self.probes):
            if not len(todo):
                break
            slot = (slot + 1) & self.mask
            at, hit = self.at[slot], self.keys[slot] == x[todo]
            hit &= at >= 0
            out[todo[hit]] = at[hit]
            more = (at >= 0) & ~hit
            todo, slot = todo[more], slot[more]
        return out
