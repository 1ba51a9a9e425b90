"""Vectorised text primitives for Arrow batches.

A batch's UTF-8 bytes are read as one numpy array: a 256-entry table folds A-Z
and says which bytes belong to words, word edges are where that flag flips, and
word hashes are differences of one running polynomial sum modulo 2**64. Texts
are taken whole; only the number of texts handled at once is bounded, so memory
follows CHUNK_BYTES or the longest single text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: Powers kept between tasks; only a text longer than a chunk needs more.
LEAST_POWERS = 1 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _rng.integers(1, 2**64, size=256, dtype=np.uint64)
_BYTE_VALUE[ord("A") : ord("Z") + 1] = _BYTE_VALUE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_SHINGLE_BASE = 0xD1342543DE82EF95

#: ASCII white space separates words.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits and everything beyond ASCII make words.
ALNUM = np.zeros(256, dtype=bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_low : _high + 1] = True

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, LEAST_POWERS)
        with np.errstate(over="ignore"):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            table = np.multiply.accumulate(steps)
        _powers[base] = table
    return table[:n]


def shorten_tables() -> None:
    """Drops what a long text has added to the tables of powers."""
    for base, table in _powers.items():
        if len(table) > LEAST_POWERS:
            _powers[base] = table[:LEAST_POWERS].copy()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
        h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return h ^ (h >> _U(32))


@dataclass
class Chunk:
    """Texts first..last of a batch as bytes; bounds has their edges in buf."""

    first: int
    buf: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.bounds[i] : self.bounds[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a string column into runs of whole texts of about limit bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(edges, edges[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield Chunk(i, raw[edges[i] : edges[j]], edges[i : j + 1] - edges[i])
        i = j


@dataclass
class Words:
    """Words of a chunk: byte edges, hashes, and each text's range of words."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    range: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.range)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.range) - 1), self.counts())


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes, with A-Z as a-z."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[buf] * _power_table(_BASE, len(buf)), out=total[1:])
        return mix((total[ends] - total[starts]) * _power_table(_BASE_INV, len(buf))[starts])


def words(chunk: Chunk, table: np.ndarray, hashed: bool = True) -> Words:
    buf, bounds = chunk.buf, chunk.bounds
    n = len(buf)
    if n == 0:
        empty = np.zeros(0, dtype=np.int64)
        return Words(empty, empty, np.zeros(0, dtype=np.uint64), np.zeros(len(bounds), dtype=np.int64))
    inside = table[buf]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first, last = bounds[:-1], bounds[1:] - 1
    first, last = first[first < n], last[last >= 0]
    begin[first] = inside[first]
    end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    hashes = np.zeros(0, dtype=np.uint64)
    if hashed:
        hashes = span_hashes(buf, starts, ends)
    return Words(starts, ends, hashes, np.searchsorted(starts, bounds))


def hash_word(word: bytes) -> int:
    """The hash that words() gives this word."""
    buf = np.frombuffer(word, dtype=np.uint8)
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.sum(_BYTE_VALUE[buf] * _power_table(_BASE, len(buf)), dtype=np.uint64)], dtype=np.uint64))[0])


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; entry i covers words i to i+n-1."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
        weight = 1
        for k in range(n):
            out += hashes[k : len(hashes) - n + 1 + k] * _U(weight)
            weight = weight * _SHINGLE_BASE % 2**64
        return mix(out + _U(n))


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of each text's distinct n-word shingles, by owner and hash.

    A text of 1 to n-1 words has its whole sequence as its one shingle; a text
    without words has none.
    """
    counts = w.counts()
    if len(w.hashes) >= n:
        whole = window_hashes(w.hashes, n)
        at = np.arange(len(whole))
        owner = w.owner()[: len(whole)]
        fits = at + n <= w.range[1:][owner]
        owner, found = owner[fits], whole[fits]
    else:
        owner, found = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        alone = np.array([window_hashes(w.hashes[w.range[i] : w.range[i + 1]], int(counts[i]))[0] for i in short], dtype=np.uint64)
        owner, found = np.concatenate([owner, short]), np.concatenate([found, alone])
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    if len(owner):
        new = np.ones(len(owner), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
        owner, found = owner[new], found[new]
    return owner, found
