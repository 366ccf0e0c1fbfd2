"""Whole-column text work in NumPy: word boundaries, word hashes and a hash table, without a Python loop per word.

A block is a run of texts laid end to end as code points, one blank between neighbours, so that every step is an
array operation over the block. Blocks are cut by size, not by number of rows: memory is bounded by the block size or
by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_CHARS = 2_000_000
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_TILE = 1 << 18


def blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """(first, last) index pairs of consecutive texts of at most `limit` characters together, or one longer text."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text) + 1
        if held and held + n > limit:
            yield first, i
            first, held = i, 0
        held += n
    if len(texts) > first:
        yield first, len(texts)


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most `limit` bytes of text, or one longer text: what Python holds at a time."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            ahead = int(upto[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(upto, ahead + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by one blank; and where each text starts, plus the total length."""
    cps = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return cps, starts


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; spans must ascend and not overlap.

    Each value is mixed with its place in the span, and the results are summed: unlike a polynomial modulo 2**64 this
    has no texts of a simple kind that always collide. Sums are taken over one tile of the values at a time.
    """
    out = np.zeros(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + _TILE)))
        s, e = starts[a:b] - starts[a], ends[a:b] - starts[a]
        total = int(e[-1])
        place = np.arange(total) - np.repeat(s, np.diff(np.append(s, total)))
        m = (values[starts[a] : starts[a] + total].astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD[0]) + place.astype(np.uint64) * np.uint64(_ODD[1])
        m ^= m >> np.uint64(32)
        m *= np.uint64(_ODD[2])
        m ^= m >> np.uint64(29)
        m *= np.uint64(_ODD[3])
        m ^= m >> np.uint64(32)
        prefix = np.zeros(total + 1, dtype=np.uint64)
        np.cumsum(m, out=prefix[1:])
        h = prefix[e] - prefix[s] + (e - s).astype(np.uint64) * np.uint64(_ODD[0])
        h ^= h >> np.uint64(31)
        h *= np.uint64(_ODD[2])
        out[a:b] = h ^ (h >> np.uint64(29))
        a = b
    return out


class HashTable:
    """Open addressing over NumPy arrays: 64-bit keys to consecutive numbers; emptied when it is full."""

    def __init__(self, bits: int = 21) -> None:
        self.size = 1 << bits
        self.room = self.size * 6 // 10
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.size, dtype=np.uint64)
        self.values = np.full(self.size, -1, dtype=np.int32)
        self.n = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        mask = np.uint64(self.size - 1)
        slot = (keys & mask).astype(np.int64)
        out = self.values[slot]
        wrong = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        out[(self.keys[slot] != keys)] = -1
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & (self.size - 1)
            hit, got = self.keys[slot] == keys[wrong], self.values[slot]
            found = hit & (got >= 0)
            out[wrong[found]] = got[found]
            go = ~hit & (got >= 0)
            wrong, slot = wrong[go], slot[go]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers for distinct keys that are not in the table."""
        numbers = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        left = np.arange(len(keys))
        slot = (keys & np.uint64(self.size - 1)).astype(np.int64)
        while len(left):
            empty = self.values[slot] < 0
            try_at, who = slot[empty], left[empty]
            self.values[try_at] = numbers[who]  # of several at one slot the last stays
            self.keys[try_at] = keys[who]
            stays = np.zeros(len(left), dtype=bool)
            stays[empty] = self.values[try_at] == numbers[who]
            left, slot = left[~stays], (slot[~stays] + 1) & (self.size - 1)
        self.n += len(keys)
        return numbers
