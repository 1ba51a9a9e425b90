"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of WINDOW consecutive words (a shorter item is one
window). A window is the set of its five-word shingles (of its only one, if it is
shorter). A text holds a window only if it holds all its shingles, so for this
containment the necessary prefix is one token: the window's rarest shingle, in
the order of how many windows have each. The join goes by these prefix tokens
alone. A text position that matches fixes where the window would begin (the
positional bound) and must leave room for it in the text (the length bound);
what passes is verified word by word over the window.

Items are cut into windows on the executors, and distinct pairs of window and item
are written. They reach the tasks as arrays; what one pass over the texts holds is
counted first, and more than MAX_WINDOWS pairs are cut into slices by their hash until
none has more. The texts are read once for each slice, and what was found is put
together. So neither a long item nor a window of many items exceeds a slice. Words
and windows are known by 64-bit hashes of words.

Null or empty texts and items have no words. Texts are read whole. Repeated
items with one id count once; windows that several items share count for each;
an item without an id marks words but is not listed. Repeated texts are judged
one by one. Empty tables give results without hits. Other columns pass through
and columns named like a result are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textvec
from tidemark.llm.shared import free_name, written
from tidemark.llm.workers import tidy

WINDOW = 10
SHINGLE = 5
MAX_WINDOWS = 500_000


@dataclass
class Index:
    """Distinct windows of a benchmark slice, by length and by prefix token."""

    lengths: np.ndarray  # of each window
    words: np.ndarray  # hashes, one row a window, 0 behind short ones
    keys: dict[int, np.ndarray]  # by shingle size: sorted prefix tokens, one entry a window
    window: dict[int, np.ndarray]  # the window of each entry
    shift: dict[int, np.ndarray]  # where in the window the token stands
    items: list[list[str]]  # ids of the items of each window


def item_windows(text: str, window: int) -> Iterator[np.ndarray]:
    for chunk in textvec.chunks(pa.array([text])):
        h = textvec.words(chunk, textvec.ALNUM).hashes
        if len(h):
            for i in range(max(1, len(h) - window + 1)):
                yield h[i : i + window]


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """id and words (the hashes as bytes) of each distinct window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = item_windows(text or "", window)
                while part := [w.tobytes() for w in itertools.islice(found, 20_000)]:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part, pa.binary())], names=["id", "words"])

    items = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").filter("text IS NOT NULL")
    return items.mapInArrow(tidy(run), "id string, words binary").distinct()


def build_index(pairs: Iterable[tuple[str | None, bytes]], shingle: int, window: int) -> Index:
    found: dict[bytes, set[str]] = {}
    for name, w in pairs:
        found.setdefault(w, set()).update([] if name is None else [name])
    listed = [np.frombuffer(k, dtype=np.uint64) for k in found]
    lengths = np.array([len(w) for w in listed], dtype=np.int64)
    words = np.zeros((len(listed), window), dtype=np.uint64)
    for i, w in enumerate(listed):
        words[i, : len(w)] = w
    keys, owner, shift = {}, {}, {}
    for size in sorted({min(shingle, int(n)) for n in lengths}):
        mine = [i for i in range(len(listed)) if min(shingle, lengths[i]) == size]
        tokens = [textvec.window_hashes(listed[i], size) for i in mine]
        values, counts = np.unique(np.concatenate(tokens), return_counts=True)
        prefix, at = [], []
        for t in tokens:
            k = int(np.argmin(counts[np.searchsorted(values, t)]))  # the rarest; the first on ties
            prefix.append(t[k])
            at.append(k)
        order = np.argsort(np.array(prefix, dtype=np.uint64), kind="stable")
        keys[size] = np.array(prefix, dtype=np.uint64)[order]
        owner[size] = np.array(mine, dtype=np.int64)[order]
        shift[size] = np.array(at, dtype=np.int64)[order]
    return Index(lengths, words, keys, owner, shift, [sorted(s) for s in found.values()])


def find_windows(w: textvec.Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window within one text."""
    starts, windows = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    owner_end = None
    for size, keys in index.keys.items():
        tokens = textvec.window_hashes(w.hashes, size)
        # A small table of bits passes over nearly all positions before the search.
        bits = np.zeros(1 << 20, dtype=bool)
        bits[(keys >> np.uint64(44)).astype(np.int64)] = True
        position = np.flatnonzero(bits[(tokens >> np.uint64(44)).astype(np.int64)])
        low = np.searchsorted(keys, tokens[position])
        many = np.searchsorted(keys, tokens[position], side="right") - low
        position, low, many = position[many > 0], low[many > 0], many[many > 0]
        if not len(position):
            continue
        if owner_end is None:
            counts = w.counts()
            owner_begin, owner_end = np.repeat(w.range[:-1], counts), np.repeat(w.range[1:], counts)
        entry = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        position = np.repeat(position, many)
        window = index.window[size][entry]
        start = position - index.shift[size][entry]
        length = index.lengths[window]
        room = (start >= owner_begin[position]) & (start + length <= owner_end[position])
        start, window, length = start[room], window[room], length[room]
        same = np.ones(len(start), dtype=bool)
        for k in range(index.words.shape[1]):
            inside = length > k
            same &= ~inside | (w.hashes[np.minimum(start + k, len(w.hashes) - 1)] == index.words[window, k])
        starts.append(start[same])
        windows.append(window[same])
    return np.concatenate(starts), np.concatenate(windows)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def _merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Spans in order, with those that touch put together."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(starts[1:] > ends[:-1]) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]]) - 1
    return list(zip(starts[first].tolist(), (ends[last] - starts[first]).tolist(), strict=True))


def mark(docs: DataFrame, index: Index, column: str = "text") -> DataFrame:
    """docs with n_words, spans (start and length in words of all that is hit) and items (ids, sorted)."""
    names = ("n_words", "spans", "items")
    kept = [c for c in docs.columns if c not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            n_words: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]
            spans: list[list] = []
            items: list[list[str]] = []
            for chunk in textvec.chunks(batch[column]):
                w = textvec.words(chunk, textvec.ALNUM)
                n_words.append(w.counts())
                mine: list[list] = [[] for _ in range(len(chunk))]
                theirs: list[list[str]] = [[] for _ in range(len(chunk))]
                start, found = find_windows(w, index)
                text = np.searchsorted(w.range, start, side="right") - 1
                order = np.argsort(text, kind="stable")
                start, found, text = start[order], found[order], text[order]
                cut = np.flatnonzero(np.diff(text)) + 1
                for s, f, i in zip(np.split(start, cut), np.split(found, cut), text[np.concatenate([[0], cut])] if len(text) else (), strict=len(text) > 0):
                    s = s - w.range[i]
                    mine[i] = _merge(s, s + index.lengths[f])
                    theirs[i] = sorted({x for k in set(f.tolist()) for x in index.items[k]})
                spans += mine
                items += theirs
            arrays = [batch[c] for c in kept]
            arrays += [pa.array(np.concatenate(n_words), type=pa.int64()), pa.array([[{"start": a, "length": b} for a, b in x] for x in spans], type=pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), pa.array(items, type=pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(tidy(run), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, column: str = "text", window: int = WINDOW, shingle: int = SHINGLE, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (ids, sorted) and contaminated.

    The benchmark's windows reach the driver a slice at a time, each of at most
    max_windows pairs of window and item.
    """
    pairs = written(benchmark_windows(benchmark, window), "windows")
    n_slices = max(1, -(-pairs.count() // max_windows))
    of = lambda n: F.pmod(F.xxhash64("id", "words"), F.lit(n))
    while n_slices > 1 and pairs.groupBy(of(n_slices)).count().agg(F.max("count")).first()[0] > max_windows:
        n_slices += -(-n_slices // 4)
    temporary = [(free_name(docs, f"spans{k}"), free_name(docs, f"items{k}")) for k in range(1, n_slices)]
    made = docs.drop("n_words", "spans", "items")
    for k in range(n_slices):
        if k:
            made = made.drop("n_words").withColumnsRenamed(dict(zip(("spans", "items"), temporary[k - 1], strict=True)))
        found = pairs.filter(of(n_slices) == k).toArrow()
        made = mark(made, build_index(zip(found["id"].to_pylist(), found["words"].to_pylist(), strict=True), shingle, window), column)
    spans = [t[0] for t in temporary] + ["spans"]
    lists = [t[1] for t in temporary] + ["items"]
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    if n_slices > 1:
        every = F.flatten(F.transform(F.concat(*spans), lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1)))
        hit = F.size(F.array_distinct(every)).cast("long")
    listed = F.sort_array(F.array_distinct(F.concat(*lists))) if n_slices > 1 else F.col("items")
    kept = [c for c in docs.columns if c not in ("n_words", "n_hit", "n_items", "items", "contaminated")]
    return made.select(*[f"`{c}`" for c in kept], "n_words", hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), (hit > 0).alias("contaminated"))

