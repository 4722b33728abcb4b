"""Words, shingles and their hashes for whole Arrow columns of texts, in numpy.

A batch is one byte buffer; nothing loops over words in Python.  Hashes are 64-bit polynomials
over random byte values, mixed; equal words always have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes worked on at a time; a longer text is worked on alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts and ends; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts [i, j) of about ``size`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """The words of texts i..j of a buffer: hash, doc (0 for text i) and, per doc, first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True):
        at = offsets - offsets[0]
        data = data[offsets[0] : offsets[-1]]
        if fold:
            data = _LOWER[data]
        word = ~_SPACE[data]
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        cut = at[(at > 0) & (at < len(data))]
        starts[cut] = word[cut]
        self.start = np.flatnonzero(starts)
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        before = cut - 1
        ends[before] = word[before]
        self.end = np.flatnonzero(ends) + 1
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        size = (self.end - self.start).astype(np.uint64)
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + size * _MULT)
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(at) - 1), self.count)
        self.data, self.at = data, at


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words with their docs; a shorter text gives its whole sequence as one."""
    h, n = words.hash, max(len(words.hash) - k + 1, 0)
    run = np.zeros(n, np.uint64)
    for j in range(k):
        run = run * _MULT + h[j : j + n]
    whole = words.doc[:n] == words.doc[k - 1 :] if n else np.zeros(0, bool)
    values, docs = mix(run[whole]), words.doc[:n][whole]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        own = []
        for d in short:
            x = np.uint64(words.count[d])
            for y in h[words.first[d] : words.first[d + 1]]:
                x = x * _MULT + y
            own.append(x)
        values = np.concatenate([values, mix(np.array(own, np.uint64) ^ np.uint64(k))])
        docs = np.concatenate([docs, short])
        order = np.argsort(docs, kind="stable")
        values, docs = values[order], docs[order]
    return values, docs


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each run of texts: the number of its first text, and the sorted distinct shingles of each."""
    for i, j in chunks(offsets):
        with np.errstate(over="ignore"):
            values, docs = shingles(Words(data, offsets[i : j + 1]), k)
        cut = np.searchsorted(docs, np.arange(j - i + 1))
        sets = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = np.sort(values[a:b])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            sets.append(own)
        yield i, sets
