"""Token ids of whole texts by a public tokenizer, a batch at a time.

The vocabulary file splits texts at white space and between letters and other
signs before anything else, so the ids of a text are those of its segments put
together. Only segments not met before go through the tokenizer; ids of the
others come from a table in the worker that is emptied when it is full. Texts
with a special token's string are encoded as they are.
"""

from __future__ import annotations

import os

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm import textvec

CACHE_SEGMENTS = 1_500_000

#: Of bytes: 0 white space, 1 letters, apostrophes and all beyond ASCII, 2 other ASCII.
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
for _low, _high in ((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF), (0x27, 0x27)):
    _KIND[_low : _high + 1] = 1


def _cuts(buf: np.ndarray) -> np.ndarray:
    """Where a segment may begin inside a word: between an ASCII sign and a letter that is surely one."""
    kind = _KIND[buf]
    at = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    before, after = buf[at - 1], buf[at]
    ends = kind[at - 1] == 1  # a letter run ends here
    second = np.where(at >= 2, buf[np.maximum(at - 2, 0)], 0)
    follows = buf[np.minimum(at + 1, len(buf) - 1)]
    letter_end = ((before < 0x80) & (before != 0x27)) | ((second == 0xC3) & (before >= 0x80) & (before < 0xC0) & (before != 0x97) & (before != 0xB7))
    letter_start = ((after < 0x80) & (after != 0x27)) | ((after == 0xC3) & (follows != 0x97) & (follows != 0xB7))
    return at[np.where(ends, letter_end, letter_start)]


def segments(chunk: textvec.Chunk) -> textvec.Words:
    buf, bounds = chunk.buf, chunk.bounds
    n = len(buf)
    if n < 2:
        return textvec.words(chunk, textvec.SPACED)
    inside = _KIND[buf] > 0
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first, last = bounds[:-1], bounds[1:] - 1
    first, last = first[first < n], last[last >= 0]
    cuts = _cuts(buf)
    begin[cuts] = True
    end[cuts - 1] = True
    begin[first] = inside[first]
    end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return textvec.Words(starts, ends, textvec.span_hashes(buf, starts, ends), np.searchsorted(starts, bounds))


class Encoder:
    """Ids of whole texts; one for each worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Between joined segments stands a sign that no other byte gives.
        (self.mark,) = self.tokenizer.encode("\0", add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)  # sorted hashes of known segments
        self.begins = np.zeros(0, dtype=np.int32)  # where the ids of each stand in flat
        self.lengths = np.zeros(0, dtype=np.int32)
        self.flat = np.zeros(1 << 20, dtype=np.uint32)
        self.size = 0

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments in order, number of ids of each)."""
        if any("\0" in t for t in texts):
            each = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(each), np.array([len(x) for x in each])
        joined = [" \0 ".join(texts[k : k + 512]) + " \0" for k in range(0, len(texts), 512)]
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        marks = np.flatnonzero(ids == self.mark)
        return ids[ids != self.mark], np.diff(marks, prepend=-1) - 1

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        ids, lengths = self._ids(texts)
        while self.size + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.size : self.size + len(ids)] = ids
        begins = self.size + np.cumsum(lengths) - lengths
        self.size += len(ids)
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        self.begins = np.insert(self.begins, at, begins)
        self.lengths = np.insert(self.lengths, at, lengths)

    def encode(self, chunk: textvec.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, where each text's ids begin, and their end)."""
        s = segments(chunk)
        if len(self.keys) > CACHE_SEGMENTS:
            self._clear()
        unique, first, inverse = np.unique(s.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != unique) if len(self.keys) else np.arange(len(unique))
        if len(new):
            where = first[new]
            self._learn(unique[new], [chunk.buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(s.starts[where].tolist(), s.ends[where].tolist(), strict=True)])
            at = np.searchsorted(self.keys, unique)
        lengths = self.lengths[at][inverse]
        total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        source = np.repeat((self.begins[at][inverse] - total[:-1]).astype(np.int32), lengths)
        source += np.arange(len(source), dtype=np.int32)
        ids = self.flat[source]
        edges = total[s.range]
        if any(x in chunk.buf.tobytes() for x in self.special):
            return self._with_special(chunk, ids, edges)
        return ids, edges

    def _with_special(self, chunk: textvec.Chunk, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for i in range(len(chunk)):
            text = chunk.text(i)
            if any(x in text for x in self.special):
                parts.append(np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype=np.uint32))
            else:
                parts.append(ids[edges[i] : edges[i + 1]])
        return np.concatenate(parts) if parts else ids, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

