"""Vectorised word and shingle hashes over the bytes of a batch of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gneiss.llm.common import utf8

BASE = np.uint64(0x9E3779B97F4A7C15)
_table = np.random.RandomState(20_11).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)
_inverse = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(n: int) -> np.ndarray:
    """BASE ** 0..n-1 modulo 2**64; grown on demand."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers)), BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the blank-separated words of all rows, and the offsets of each row's words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_blank[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begin[edges] = word[edges]
    starts = np.flatnonzero(begin)
    # a word's hash is the sum of T[byte] * BASE**(position in the word); sums over runs are differences of prefix sums
    last = word.copy()
    last[:-1] &= ~word[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = word[tails]
    ends = np.flatnonzero(last)
    lengths = ends - starts + 1
    at = np.arange(len(data), dtype=np.int64)
    index = np.cumsum(begin) - 1
    pos = at - starts[np.maximum(index, 0)] if len(starts) else at
    values = np.where(word, _table[data] * powers(int(lengths.max(initial=1)) + 1)[np.where(word, pos, 0)], np.uint64(0))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    h = mix64(total[ends + 1] - total[starts] + lengths.astype(np.uint64))
    return h, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words (a shorter row that has words is one shingle), sorted and distinct within a row."""
    n = np.diff(offsets)
    count = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(offsets[:-1], count) + np.arange(out[-1]) - np.repeat(out[:-1], count)
    stop = np.repeat(offsets[1:], count)
    s = np.zeros(len(first), np.uint64)
    for i in range(k):
        inside = first + i < stop
        s = s * BASE + np.where(inside, words[np.minimum(first + i, max(len(words) - 1, 0))] if len(words) else 0, np.uint64(i + 1))
    s = mix64(s)
    row = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    s, row = s[keep], row[keep]
    return s, np.searchsorted(row, np.arange(len(n) + 1))


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a string column's lower-cased texts and each row's offsets."""
    data, offsets = utf8(lower(column))
    return shingle_hashes(*word_hashes(data, offsets), k)
