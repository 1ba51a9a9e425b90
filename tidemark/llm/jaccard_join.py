"""N-gram Jaccard join by vertical partitioning of the shingle order.

Two texts link when their sets of n-word shingles have a Jaccard similarity of
num / den or more. Shingles are put in one global order (that of their 64-bit
hashes), which is cut into fragments.

Candidates. Sets of one size class can differ in at most D shingles and still
link, so of D + 1 + K fragments at least K + 1 agree exactly. Each set gives one
key for each non-empty fragment; sets that link share a key unless all agreeing
fragments are empty, which needs more than K empty ones; a set with so many also
gives the keys of another order, and so on. Where fragments would be too thin (in
small sets, or at low similarities) a set gives its prefix instead: as many of
its first shingles as no linked set can miss, the rare ones first. How often shingles
occur is counted over all vertices, in a table of fixed size for the frequent ones;
any one table gives right results, a good one gives few keys in common. Sets at a
class edge give the keys of both classes. Keys of several shingles make common
passages harmless: a key is shared only by sets that agree on a whole fragment.

Filter. Each set has a parity sketch: bit i is the parity of how many shingles
hash to i. The number of bits in which two sketches differ is never above the
size of the sets' difference, so a pair beyond D is dropped safely.

Groups. Texts with equal sets are one vertex. Rows are dealt by ranges of key and
vertex, so a key with many vertices is spread over tasks, in blocks of BLOCK at most.
Of keys with the same vertices one is kept. Of a block's vertices, the one that
passes with most others leads; those that pass with it are paired with it, and so
on with the rest. After these pairs are verified, pairs within a key are needed only
between different components. Of keys with several blocks, each two components of two
blocks first get their closest pair tested, which joins what was only cut apart; a
last round tests all pairs that still pass between different components. No task
holds more than two blocks of a key.

Verification. For each pair, the fragments of both sets are joined, the overlap of
each fragment is counted apart, and the counts are summed. Links then go through
connected components.

Null texts, empty texts and texts without words have no shingles and link with
nothing; a text shorter than n words has its whole sequence as its one shingle.
Texts are read whole. Repeated rows each get a row. An empty table gives an empty
result. Other columns pass through and columns named like a result are replaced.
Ids must be of one orderable type; a null id never becomes a component's id,
unless all ids of the component are null. Shingles are known by 64-bit hashes: results
are exact as long as no two shingles share one. Components are complete, but pairs
within a component are not all tested, so links are not counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textvec
from tidemark.llm.components import components
from tidemark.llm.shared import Scratch, free_name, written
from tidemark.llm.workers import tidy

BLOCK = 2048
MAX_SKETCH_BITS = 1 << 14
#: Fragments into which verification cuts a set.
VERIFY_FRAGMENTS = 8
#: Bits of a table that says which rows may be wanted: 16 for each, within these bounds, so at most 32 MB are broadcast.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Cells of the table of frequent shingles, by a shingle's first bits.
CELL_BITS = 20
_SEEN = 1_000_000
#: Keys by which the second round tells in which group a pair is given.
LEAST_KEYS = 24
_U = np.uint64


@dataclass(frozen=True)
class SizeClass:
    low: int
    high: int  # exclusive
    most_apart: int  # D
    fragments: int  # 0: prefixes are used
    spare: int  # K
    bits: int


@dataclass(frozen=True)
class Plan:
    """Size classes for the similarity num / den."""

    words: int
    num: int
    den: int

    def apart(self, a: int | np.ndarray, b: int | np.ndarray) -> int | np.ndarray:
        """The largest difference of two sets of these sizes that still link."""
        return a + b - 2 * -(-self.num * (a + b) // (self.den + self.num))

    def size_class(self, k: int) -> SizeClass:
        return _size_class(self, k)

    def classes_of(self, n: int) -> list[int]:
        """The class of size n and those above that hold sizes which can link with it."""
        k = _class_index(n)
        out = [k]
        while n * self.den // self.num >= _edge(out[-1] + 1):
            out.append(out[-1] + 1)
        return out


_edges = [1]


def _edge(k: int) -> int:
    while len(_edges) <= k:
        _edges.append(max(_edges[-1] + 1, _edges[-1] * 3 // 2))
    return _edges[k]


def _class_index(n: int) -> int:
    k = 0
    while _edge(k + 1) <= n:
        k += 1
    return k


_class_cache: dict[tuple[Plan, int], SizeClass] = {}


def _size_class(plan: Plan, k: int) -> SizeClass:
    if (plan, k) not in _class_cache:
        low, high = _edge(k), _edge(k + 1)
        apart = 2 * (high - 1) * (plan.den - plan.num) // (plan.den + plan.num)
        least = -(-low * plan.num // plan.den)
        fragments, spare = 0, 0
        if apart:
            spare = 2
            for _ in range(50):
                fragments = apart + 1 + spare
                empty = math.ceil(1.5 * fragments * math.exp(-least / fragments)) + 2
                if empty <= spare:
                    break
                spare = empty
            if fragments * 2 > least:
                fragments = 0
        bits = min(64 * -(-5 * (apart + 1) // 64), MAX_SKETCH_BITS)
        _class_cache[plan, k] = SizeClass(low, high, apart, fragments, spare, bits)
    return _class_cache[plan, k]


def cells(s: np.ndarray) -> np.ndarray:
    return (s >> _U(64 - CELL_BITS)).astype(np.int64)


def set_keys(plan: Plan, k: int, s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The candidate keys of a sorted shingle set in class k; rank says of each cell how frequent its shingles are."""
    c = plan.size_class(k)
    if not c.most_apart:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        salt = _U((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
        if not c.fragments:
            prefix = len(s) - -(-plan.num * len(s) // plan.den) + 1
            rarest = np.argsort(rank[cells(s)], kind="stable")[:prefix]
            return textvec.mix(s[rarest] ^ salt)
        out = []
        order = 0
        while True:
            turned = s if order == 0 else textvec.mix(s + _U(order))
            fragment = (turned >> _U(32)) * _U(c.fragments) >> _U(32)
            counts = np.bincount(fragment.astype(np.int64), minlength=c.fragments)
            if order == 0:
                ends = np.cumsum(counts)
                total = np.concatenate([[_U(0)], np.cumsum(textvec.mix(s), dtype=np.uint64)])
                sums = total[ends] - total[ends - counts]
            else:
                by = np.argsort(fragment, kind="stable")
                ends = np.cumsum(counts)
                total = np.concatenate([[_U(0)], np.cumsum(textvec.mix(s)[by], dtype=np.uint64)])
                sums = total[ends] - total[ends - counts]
            full = np.flatnonzero(counts)
            out.append(textvec.mix(textvec.mix(sums[full]) + full.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _U(order) + salt))
            if c.fragments - len(full) <= c.spare:
                return np.concatenate(out)
            order += 1


def sketch(bits: int, s: np.ndarray) -> bytes:
    at = (textvec.mix(s ^ _U(0x5851F42D4C957F2D)) % _U(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


_SKETCHES = T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("sketch", T.BinaryType())]))


def _vertices(owner: np.ndarray, found: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set size, vertex, check hash) of each text."""
    sizes = np.bincount(owner, minlength=n)
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        out = []
        for salt in (2 * seed + 1, 2 * seed + 2):
            total = np.concatenate([[_U(0)], np.cumsum(textvec.mix(found + _U(salt)), dtype=np.uint64)])
            out.append(textvec.mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)).view(np.int64))
    return sizes, out[0], out[1]


def _first_seen(nodes: list[int], sizes: list[int], seen: set[int]) -> Iterator[int]:
    """Which texts of a chunk are the first of their vertex in this task, as far as it remembers."""
    if len(seen) > _SEEN:
        seen.clear()
    for i, (v, n) in enumerate(zip(nodes, sizes, strict=True)):
        if n and v not in seen:
            seen.add(v)
            yield i


_COMMON = T.ArrayType(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType())]))


def _first_pass(docs: DataFrame, plan: Plan, seed: int) -> DataFrame:
    """id and row of each text with its set's size n, vertex and check hash; sketches where its task meets a vertex first.

    Each task ends with one more row that only has `common`: the cells that it filled
    far above the average, counted over its vertices.
    """
    named = {"id": docs.schema["id"].dataType, "row": docs.schema["row"].dataType, "n": T.LongType(), "node": T.LongType(), "check": T.LongType(), "sketches": _SKETCHES, "common": _COMMON}
    schema = T.StructType([T.StructField(n, t) for n, t in named.items()])
    sketch_type = pa.list_(pa.struct([("k", pa.int32()), ("sketch", pa.binary())]))
    common_type = pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        filled = np.zeros(1 << CELL_BITS, dtype=np.int64)
        last = None
        for batch in batches:
            last = batch
            for chunk in textvec.chunks(batch["text"]):
                owner, found = textvec.shingle_sets(textvec.words(chunk, textvec.SPACED), plan.words)
                sizes, node, check = _vertices(owner, found, len(chunk), seed)
                ends = np.cumsum(sizes)
                sketches: list[list | None] = [None] * len(chunk)
                fresh = np.zeros(len(chunk), dtype=bool)
                for i in _first_seen(node.tolist(), sizes.tolist(), seen):
                    fresh[i] = True
                    s = found[ends[i] - sizes[i] : ends[i]]
                    of = [(k, plan.size_class(k)) for k in plan.classes_of(len(s))]
                    sketches[i] = [{"k": k, "sketch": sketch(c.bits, s)} for k, c in of if c.most_apart]
                filled += np.bincount(cells(found[fresh[owner]]), minlength=len(filled))
                part = batch.slice(chunk.first, len(chunk))
                arrays = [part["id"], part["row"], pa.array(sizes), pa.array(node, mask=sizes == 0), pa.array(check), pa.array(sketches, type=sketch_type), pa.nulls(len(chunk), common_type)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        at = np.flatnonzero(filled > max(8, 4 * filled.mean()))
        if last is not None:
            told = pa.array([[{"cell": c, "n": n} for c, n in zip(at.tolist(), filled[at].tolist(), strict=True)]], type=common_type)
            arrays = [pa.nulls(1, last["id"].type), pa.nulls(1, last["row"].type), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, sketch_type), told]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select("id", "row", "text").mapInArrow(tidy(run), schema)


def _ranks(first: DataFrame) -> np.ndarray:
    """How frequent the shingles of each cell are, on a logarithmic scale; 0 for all that are not."""
    out = np.zeros(1 << CELL_BITS, dtype=np.uint8)
    counts = first.filter("common IS NOT NULL").select(F.explode("common").alias("c")).groupBy("c.cell").agg(F.sum("c.n").alias("n")).toArrow()  # at most 2**CELL_BITS rows
    out[counts["cell"].to_numpy()] = np.minimum(4 * np.log2(counts["n"].to_numpy()), 255).astype(np.uint8)
    return out


def _keys(docs: DataFrame, plan: Plan, seed: int, rank: np.ndarray) -> DataFrame:
    """node, k and key: the candidate keys of every vertex.

    A pass of its own over the texts, straight into the shuffle: kept beside the
    rows, the keys would take as much disk once more.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        rank = shared.value
        for batch in batches:
            for chunk in textvec.chunks(batch["text"]):
                owner, found = textvec.shingle_sets(textvec.words(chunk, textvec.SPACED), plan.words)
                sizes, node, _ = _vertices(owner, found, len(chunk), seed)
                ends = np.cumsum(sizes)
                keys, classes, nodes = [], [], []
                for i in _first_seen(node.tolist(), sizes.tolist(), seen):
                    mine = slice(ends[i] - sizes[i], ends[i])
                    for k in plan.classes_of(int(sizes[i])):
                        made = set_keys(plan, k, found[mine], rank)
                        keys.append(made)
                        classes.append(np.full(len(made), k, dtype=np.int32))
                        nodes.append(np.full(len(made), node[i]))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(keys).view(np.int64))], names=["node", "k", "key"])

    return docs.select("text").mapInArrow(tidy(run), "node long, k int, key long")


def _complete_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables that cut no group of equal names, with the groups' edges."""
    held: list[pa.RecordBatch] = []

    def edges(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), dtype=bool)
        new[:1] = True
        for c in names:
            v = table[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        same = bool(held) and all(held[-1][c][-1] == batch[c][0] == batch[c][-1] for c in names)
        held.append(batch)
        if same:
            continue  # the open group fills this whole batch
        table = pa.Table.from_batches(held)
        at = edges(table)
        if len(at) > 1:
            yield table.slice(0, at[-1]), np.append(at[:-1], at[-1])
            held = table.slice(at[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(edges(table), len(table))


def _members(rows: DataFrame) -> DataFrame:
    """key, k, node, block of every vertex under keys that several vertices share.

    A range's first and last key may go on in the next one, so their rows are kept
    even if they stand alone in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the open key: its last vertex, how many it has, and its first row until a second vertex shows that it is shared.
        last: tuple[int, int] | None = None
        first: int | None = None
        count = 0
        waiting: pa.RecordBatch | None = None
        base = TaskContext.get().partitionId() << 32
        names = ["key", "k", "node", "block"]
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes = batch["key"].to_numpy(), batch["node"].to_numpy()
            first = int(keys[0]) if first is None else first
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
            new[0] = last != (keys[0], nodes[0])
            batch = batch.filter(pa.array(new))
            if waiting is not None:
                batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            keys = batch["key"].to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            lengths = np.diff(np.append(begins, len(keys)))
            before = np.zeros(len(begins), dtype=np.int64)
            if waiting is None and last and last[0] == keys[0]:
                before[0] = count
            place = np.arange(len(keys)) - np.repeat(begins - before, lengths)
            keep = np.repeat(lengths + before > 1, lengths) | (keys == first)
            last, count = (int(keys[-1]), int(batch["node"][-1].as_py())), int(lengths[-1] + before[-1])
            waiting = batch.slice(len(keys) - 1) if count == 1 else None
            if waiting is not None:
                keep[-1] = False
            yield pa.RecordBatch.from_arrays([batch["key"], batch["k"], batch["node"], pa.array(base + place // BLOCK)], names=names).filter(pa.array(keep))
        if waiting is not None:
            yield pa.RecordBatch.from_arrays([waiting["key"], waiting["k"], waiting["node"], pa.array([base])], names=names)

    # Within a key the order is one of the key's own, so that blocks of one key mix those of another.
    mixed = F.xxhash64("key", "node")
    dealt = rows.repartitionByRange("key", mixed).sortWithinPartitions("key", mixed, "node")
    return dealt.select("key", "k", "node").mapInArrow(tidy(run), "key long, k int, node long, block long")


def _distinct_groups(members: DataFrame) -> DataFrame:
    """One key of those that the very same vertices share: near copies share many, which all give the same pairs."""
    of = F.col("node")
    sets = members.groupBy("key", "k").agg(F.bit_xor(F.xxhash64(of)).alias("x"), F.bit_xor(F.xxhash64(of, F.lit(1))).alias("y"), F.count("*").alias("n"))
    return members.join(sets.groupBy("k", "x", "y", "n").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def _passing(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, plan: Plan) -> np.ndarray:
    """Whether the sketches allow a link, for each of a (rows) with each of b (columns)."""
    out = np.zeros((len(a), len(b)), dtype=bool)
    step = max(1, (1 << 21) // max(1, b.size))
    for i in range(0, len(a), step):
        differ = np.bitwise_count(a[i : i + step, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int32)
        out[i : i + step] = differ <= plan.apart(sizes_a[i : i + step, None], sizes_b[None, :])
    return out


def _sketches(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype=np.uint64).reshape(len(column), -1)


def _leaders(groups: DataFrame, plan: Plan) -> DataFrame:
    """Pairs of leaders and those that pass with them, in each block of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _complete_groups(batches, ("key", "block")):
            nodes, sizes = table["node"].to_numpy(), table["n"].to_numpy()
            binary = table["sketch"].combine_chunks() if table["sketch"].num_chunks != 1 else table["sketch"].chunk(0)
            left: list[np.ndarray] = []
            right: list[np.ndarray] = []
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if j - i < 2:
                    continue
                x = _sketches(binary.slice(i, j - i))
                ok = _passing(x, x, sizes[i:j], sizes[i:j], plan)
                np.fill_diagonal(ok, False)
                free = ok.any(axis=1)
                while free.any():
                    many = np.where(free, ok[:, free].sum(axis=1), -1)
                    lead = int(np.argmax(many))
                    if many[lead] <= 0:
                        break
                    mine = np.flatnonzero(ok[lead] & free)
                    left.append(np.full(len(mine), nodes[i + lead]))
                    right.append(nodes[i + mine])
                    free[mine] = False
                    free[lead] = False
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return groups.select("key", "block", "node", "n", "sketch").mapInArrow(tidy(run), "a long, b long").distinct()


def _across(groups: DataFrame, plan: Plan, closest: bool) -> DataFrame:
    """Pairs that pass between different components, in each pair of blocks of each key: all, or the closest of each two components.

    Near copies share many keys. `least` has the smallest keys of a vertex, and of
    the keys that both lists hold only the smallest gives the pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _complete_groups(batches, ("key", "one", "two")):
            keys, nodes, sizes, roots, sides = (table[c].to_numpy() for c in ("key", "node", "n", "root", "side"))
            lists = table["least"].combine_chunks() if table["least"].num_chunks != 1 else table["least"].chunk(0)
            binary = table["sketch"].combine_chunks() if table["sketch"].num_chunks != 1 else table["sketch"].chunk(0)
            left: list[np.ndarray] = []
            right: list[np.ndarray] = []
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if j - i < 2:
                    continue
                x = _sketches(binary.slice(i, j - i))
                one = np.flatnonzero(sides[i:j] == 0)
                two = np.flatnonzero(sides[i:j] == 1) if (sides[i:j] == 1).any() else one
                ok = _passing(x[one], x[two], sizes[i:j][one], sizes[i:j][two], plan)
                ok &= roots[i:j][one][:, None] != roots[i:j][two][None, :]
                p, q = np.nonzero(ok)
                if not len(p):
                    continue
                if closest:
                    apart = np.concatenate([np.bitwise_count(x[one[p[n : n + 65_536]]] ^ x[two[q[n : n + 65_536]]]).sum(axis=1, dtype=np.int64) for n in range(0, len(p), 65_536)])
                    r, t = roots[i:j][one[p]], roots[i:j][two[q]]
                    order = np.lexsort((apart, t, r))
                    new = np.ones(len(order), dtype=bool)
                    new[1:] = (np.diff(r[order]) != 0) | (np.diff(t[order]) != 0)
                    p, q = p[order[new]], q[order[new]]
                mine = np.ones(len(p), dtype=bool)
                if not closest:
                    least = {k: set(lists[i + k].as_py()) for k in {*one[p].tolist(), *two[q].tolist()}}
                    mine = np.fromiter((min(least[a] & least[b], default=keys[i]) == keys[i] for a, b in zip(one[p].tolist(), two[q].tolist(), strict=True)), dtype=bool, count=len(p))
                left.append(nodes[i:j][one[p[mine]]])
                right.append(nodes[i:j][two[q[mine]]])
            a, b = np.concatenate(left or [np.zeros(0, dtype=np.int64)]), np.concatenate(right or [np.zeros(0, dtype=np.int64)])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return groups.select("key", "one", "two", "side", "node", "n", "root", "sketch", "least").mapInArrow(tidy(run), "a long, b long").distinct()


def bits_for(n: int) -> int:
    """How many bits a table of n entries gets."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))


def bit_table(bits: DataFrame, size: int) -> np.ndarray:
    """A table of size bits with those of the column bit set; its size is bounded, so it may be broadcast."""
    at = F.col("bit") + 1
    per = bits.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(size // 8, dtype=np.uint8)
    for r in per.toLocalIterator():  # at most size / 32768 rows of 4 KB
        start = (r["bucket"] - 1) * 4096
        out[start : start + len(r["bits"])] = np.frombuffer(r["bits"], dtype=np.uint8)[: size // 8 - start]
    return out


def among(one: Column, keys: DataFrame) -> Column:
    """Whether a key is perhaps in the column one of keys; false only where it is surely not."""
    size = bits_for(keys.count())
    bit = one.bitwiseAND(F.lit(size - 1))
    shared = keys.sparkSession.sparkContext.broadcast(bit_table(keys.select(F.col("one").bitwiseAND(F.lit(size - 1)).alias("bit")), size))

    @F.pandas_udf("boolean")
    def perhaps(at: pd.Series) -> pd.Series:
        n = at.to_numpy()
        return pd.Series((shared.value[n >> 3] >> (n & 7).astype(np.uint8)) & 1 == 1)

    return perhaps(bit)


def without_rows(docs: DataFrame, one: Column, two: Column, gone: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """The rows of docs whose keys (one, two) are not in gone; of rows whose keys are in again one each stays.

    A table of bits tells most rows that their key is surely not there, and these
    stay where they are; only the others are shuffled, with their texts.
    """
    names = [free_name(docs, n) for n in ("one", "two", "perhaps")]
    listed = gone if again is None else gone.unionByName(again)
    marked = docs.withColumns(dict(zip(names, (one, two, among(one, listed)), strict=True)))
    named = lambda df: df.select(F.col("one").alias(names[0]), F.col("two").alias(names[1]))
    columns = [f"`{c}`" for c in docs.columns]
    sure = marked.filter(~F.col(names[2])).select(*columns)
    rest = marked.filter(names[2]).join(named(gone), names[:2], "left_anti")
    if again is None:
        return sure.unionByName(rest.select(*columns))
    once = rest.join(named(again), names[:2], "left_semi").dropDuplicates(names[:2])
    return sure.unionByName(rest.join(named(again), names[:2], "left_anti").select(*columns)).unionByName(once.select(*columns))


def _fragments(docs: DataFrame, plan: Plan, seed: int, pairs: DataFrame) -> DataFrame:
    """node, f, shingles: the fragments of every vertex in pairs (and of some besides)."""
    size = bits_for(2 * pairs.count())
    bits = bit_table(pairs.select(F.explode(F.array("a", "b")).alias("node")).select(F.col("node").bitwiseAND(F.lit(size - 1)).alias("bit")), size)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    named = docs.select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for chunk in textvec.chunks(batch["text"]):
                owner, found = textvec.shingle_sets(textvec.words(chunk, textvec.SPACED), plan.words)
                sizes, node, _ = _vertices(owner, found, len(chunk), seed)
                if len(seen) > _SEEN:
                    seen.clear()
                ends = np.cumsum(sizes)
                out_node, out_f, cuts, parts, total = [], [], [0], [], 0
                at = node & (size - 1)
                hit = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
                for i in np.flatnonzero((hit == 1) & (sizes > 0)).tolist():
                    v = int(node[i])
                    if v in seen:
                        continue
                    seen.add(v)
                    s = found[ends[i] - sizes[i] : ends[i]]
                    f = (s >> _U(61)).astype(np.int64)
                    counts = np.bincount(f, minlength=VERIFY_FRAGMENTS)
                    parts.append(s)
                    for k in np.flatnonzero(counts).tolist():
                        out_node.append(v)
                        out_f.append(k)
                        total += int(counts[k])
                        cuts.append(total)
                if out_node:
                    values = pa.array(np.concatenate(parts).view(np.int64))
                    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([pa.array(out_node, pa.int64()), pa.array(out_f, pa.int32()), lists], names=["node", "f", "shingles"])

    return named.mapInArrow(tidy(sets), "node long, f int, shingles array<long>")


def _verified(docs: DataFrame, plan: Plan, seed: int, pairs: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs that link: overlaps are counted in each fragment and summed for each pair."""
    made = _fragments(docs, plan, seed, pairs).groupBy("node", "f").agg(F.first("shingles").alias("shingles"))
    cut = scratch.written(made, "fragments")
    each = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(VERIFY_FRAGMENTS - 1))).alias("f"))
    one = each.join(cut.select(F.col("node").alias("a"), "f", F.col("shingles").alias("x")), ["a", "f"])
    both = one.join(cut.select(F.col("node").alias("b"), "f", F.col("shingles").alias("y")), ["b", "f"])
    overlap = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("part"))
    summed = overlap.groupBy("a", "b").agg(F.sum("part").alias("common"))
    sizes = nodes.select("node", "n")
    sized = summed.join(sizes.withColumnsRenamed({"node": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"node": "b", "n": "nb"}), "b")
    return sized.filter(F.lit(plan.den) * F.col("common") >= F.lit(plan.num) * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _blocks_in_pairs(rows: DataFrame) -> DataFrame:
    """Each row of a key once for every pair of its key's blocks that holds it."""
    block = F.col("block")
    others = F.transform("blocks", lambda o: F.struct(F.least(o, block).alias("one"), F.greatest(o, block).alias("two"), (block > o).cast("int").alias("side")))
    return rows.withColumn("_p", F.explode(others)).select("*", "_p.*").drop("_p")


def _checked(num: int, den: int) -> None:
    if not 0 < num <= den:
        raise ValueError("the similarity must be above 0 and at most 1")


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", column: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without text, with n_shingles and component_id.

    Texts link at a similarity of num / den over sets of `words`-word shingles.
    """
    _checked(num, den)
    kept = [c for c in docs.columns if c not in (column, "n_shingles", "component_id")]
    # The columns travel in a struct of their own, so that no name can clash.
    given = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{column}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    with Scratch(docs.sparkSession) as scratch:
        found = _linked(given, Plan(words, num, den), scratch)
        own = [F.col("row").getField(c).alias(c) for c in kept]
        return written(found.select(*own, F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")), "linked")


def keep_one(docs: DataFrame, id_column: str = "doc_id", column: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, unchanged, but of each component of linked texts only one.

    The row with the smallest id stays (one without an id only if none has one); of
    rows that share that id, the one of the smallest digest. Rows are told apart by id
    and text together, so an id that two different texts share loses neither, and of
    repeated rows one stays. Texts without words link with nothing and all stay.
    """
    _checked(num, den)
    id_, text = F.col(f"`{id_column}`"), F.col(f"`{column}`")
    one, two = F.xxhash64(id_, text), F.xxhash64(text, id_, F.lit(1))
    given = docs.select(id_.alias("id"), text.alias("text"), F.struct(one.alias("one"), two.alias("two")).alias("row"))
    with Scratch(docs.sparkSession) as scratch:
        found = written(_linked(given, Plan(words, num, den), scratch).filter("node IS NOT NULL").select("root", F.struct(F.col("id").isNull().alias("none"), "id", "row.one", "row.two").alias("at")), "groups")
    first = found.groupBy("root").agg(F.min("at").alias("first"))
    apart = (F.col("at.one") != F.col("first.one")) | (F.col("at.two") != F.col("first.two"))
    gone = written(found.join(first, "root").filter(apart).select("at.one", "at.two").distinct(), "gone")
    again = found.groupBy("at.one", "at.two").count().filter("count > 1").select("one", "two").join(gone, ["one", "two"], "left_anti")
    again = written(again, "repeated")
    return without_rows(docs, one, two, gone, again if again.limit(1).count() else None)


def _linked(docs: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """row, id, n, node, root and component_id of each row of docs (id, row, text); the last three null without words."""
    seed = 0
    while True:
        passed = scratch.written(_first_pass(docs, plan, seed), "sets")
        first = passed.filter("common IS NULL")
        grouped = first.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
        nodes = scratch.written(grouped, "vertices")
        if not nodes.filter("low <> high").limit(1).count():
            break
        seed += 1  # two sets with one hash: again with others

    members = scratch.written(_distinct_groups(scratch.written(_members(_keys(docs, plan, seed, _ranks(passed))), "keyed")), "members")
    sketches = first.filter("sketches IS NOT NULL").select("node", "n", F.explode("sketches").alias("c")).groupBy("node", "c.k").agg(F.first("c.sketch").alias("sketch"), F.first("n").alias("n"))
    sketched = scratch.written(sketches.join(members.select("node", "k").distinct(), ["node", "k"], "left_semi"), "sketches")

    blocked = members.join(sketched, ["node", "k"])
    tested = scratch.written(_leaders(blocked.repartition("key", "block").sortWithinPartitions("key", "block", "node"), plan), "pairs")
    links = scratch.written(_verified(docs, plan, seed, tested, nodes, scratch), "links")
    roots = scratch.written(components(links, scratch), "roots")

    for closest in (True, False):
        of = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # Of two vertices in one block the only pair was tested by the leader.
        mixed = of.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m"), F.collect_set("block").alias("blocks")).filter("low <> high AND (m > 2 OR size(blocks) > 1)")
        mixed = scratch.written(mixed.filter("size(blocks) > 1" if closest else "true").select("key", "blocks"), "mixed")
        if not mixed.limit(1).count():
            continue
        left = of.join(mixed, "key")
        least = left.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LEAST_KEYS).alias("least"))
        open_rows = _blocks_in_pairs(left).join(sketched, ["node", "k"]).join(least, "node")
        across = _across(open_rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "node"), plan, closest)
        more = scratch.written(across.join(tested, ["a", "b"], "left_anti"), "pairs")
        if more.limit(1).count():
            tested = tested.union(more)
            links = links.union(scratch.written(_verified(docs, plan, seed, more, nodes, scratch), "links"))
            roots = scratch.written(components(links, scratch), "roots")

    rooted = nodes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    named_root = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    final = scratch.written(rooted.join(named_root, "root").select("node", "root", "component_id"), "components")
    return first.select("row", "id", "n", "node").join(final, "node", "left")
