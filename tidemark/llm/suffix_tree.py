"""A probabilistic suffix tree over words, and scoring texts with it.

The root state is the add-one unigram distribution over every word of the
training texts. States of one word and more hang below it, each under the longest
of its suffixes that is a state. Every context of up to max_depth words that occurs
MIN_CONTEXT times or more is tested; its successors are listed if they follow it
MIN_SUCCESSOR times or more. Both are fixed numbers, so the tree grows with the
corpus. The context becomes a state if a divergence test keeps it: with n
occurrences and k listed successors, n times the Kullback-Leibler divergence of its
successors from the prediction of the state above must exceed k * ln(n) / 2. Levels
end where the test keeps no state, or at max_depth. A kept state predicts

    P(w | s) = (count(s, w) + b * P(w | parent)) / (n + 1),  b = n + 1 - listed(s)

so all mass that is not listed is smoothed over the parent. A token is scored in
the longest suffix of its past that is a state.

How it is computed. Texts are read once and written as groups of about
GROUP_TOKENS tokens, each with a dictionary of its words. A group asks for the
counts of its distinct runs, one length after the other: it sends each run's key
and own training count to the key's range, the range sums them, and answers every
group that asked. So a run costs a group one key, however often it occurs in it,
and a frequent run costs a range one key a group: no key is hot. A longer run is
asked only where its beginning is a tested context and its end a listed run; for
others the answer is known. For the test, each listed pair has one owner among the
groups; owners sum their pairs by context, the contexts' ranges add the sums up,
test, and answer with b; a group that sees all of a context's listed pairs judges it
by itself. At last each group scores its own texts. Keys, counts and
sums travel as compressed arrays; nothing of the tree is broadcast or collected.

Runs are known by 64-bit hashes. A token is a word (as of white space in ASCII)
with A-Z lower-cased, and one end token closes each text. Null texts are empty: one
end token. Texts are read whole, and a group is never smaller than its longest
text; repeated rows are scored one by one. With no training text every token is
unknown and the score is the unigram one. An empty table gives an empty result.
Other columns pass through and columns named like a result are replaced.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textvec
from tidemark.llm.shared import Scratch, written
from tidemark.llm.workers import give_back

#: Occurrences of a context that is tested, and of a successor that is listed, at any size of corpus.
MIN_CONTEXT = 2
MIN_SUCCESSOR = 2
#: Words in the longest context; None goes on until the test keeps no state of a level.
MAX_DEPTH = 4
GROUP_TOKENS = 2_000_000
#: Tokens of the corpus for each range of keys.
RANGE_TOKENS = 2_000_000
#: Partitions of a shuffle; beyond it a task does several groups or ranges, one after the other.
MAX_PARTITIONS = 20_000
RESULT = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
_END = textvec.hash_word(b"\x00end of text\x00")
_U = np.uint64
_CHAIN = _U(0x9E6C63D0876A9A47)
_TOKENS, _COUNTS, _STATES = -1, 0, 1
_ROWS = "g long, kind int, length int, part long, data array<binary>"
_ASKS = "part long, kind int, g long, data array<binary>"
_ANSWERS = f"{_ROWS}, n long, v long"
#: The arrays are compressed already.
_PLAIN = {"compression": "none", "parquet.enable.dictionary": "false"}


def closed_words(chunk: textvec.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with an end token behind each text, and each text's range."""
    w = textvec.words(chunk, textvec.SPACED)
    edges = w.range + np.arange(len(w.range))
    out = np.full(int(edges[-1]), _END, dtype=np.uint64)
    inside = np.ones(len(out), dtype=bool)
    inside[edges[1:] - 1] = False
    out[inside] = w.hashes
    return out, edges


def packed(x: np.ndarray) -> bytes:
    """An array's byte planes, compressed, behind its type; whole numbers as narrow as they fit."""
    if x.dtype.kind in "iu" and len(x):
        low, high = np.min_scalar_type(x.min()), np.min_scalar_type(x.max())
        x = x.astype(np.promote_types(low, high), copy=False)
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return x.dtype.char.encode() + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(raw: bytes, dtype: type) -> np.ndarray:
    stored = np.dtype(chr(raw[0]))
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(raw)[1:]), dtype=np.uint8).reshape(stored.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(stored).reshape(-1).astype(dtype, copy=False)


def packed_keys(sorted_keys: np.ndarray) -> bytes:
    return packed(np.diff(sorted_keys, prepend=_U(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, np.uint64), dtype=np.uint64)


def _by_range(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of keys begins among sorted keys, and their end."""
    of = (keys >> _U(32)) * _U(ranges) >> _U(32)
    return np.searchsorted(of, np.arange(ranges + 1, dtype=np.uint64))


def distinct(x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of x (from 0 to below top) in order, where each stands, and the place of each entry among them."""
    shift = len(x).bit_length()
    if top.bit_length() + shift < 64:  # value and place fit one number, which sorts fastest
        both = np.sort(x << shift | np.arange(len(x)))
        values, order = both >> shift, both & ((1 << shift) - 1)
    else:
        order = np.argsort(x, kind="stable")
        values = x[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    inverse = np.empty(len(x), dtype=np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return values[new], order[new], inverse


def key_order(keys: np.ndarray) -> np.ndarray:
    """The places of keys by their high bits, then by place: the low bits hold the place, so that one plain sort does."""
    low = _U((1 << len(keys).bit_length()) - 1)
    return (np.sort(keys & ~low | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)


@dataclass
class Runs:
    """The distinct runs of one length in a group that are asked for."""

    at: np.ndarray | None = None  # the tokens with which such a run ends
    run: np.ndarray | None = None  # the run of each
    keys: np.ndarray | None = None
    order: np.ndarray | None = None  # the runs by key
    context: np.ndarray | None = None  # of each run: what stands before its last word, as a run of the length below
    first: np.ndarray | None = None  # a token where it ends
    count: np.ndarray | None = None  # in all training texts; 0 below MIN_SUCCESSOR, but for single words
    owned: np.ndarray | None = None
    rest: np.ndarray | None = None  # b where the run is a state, else -1
    next: tuple[np.ndarray, np.ndarray] | None = None  # its followers, while they are needed


@dataclass
class Group:
    words: np.ndarray  # sorted hashes
    ids: np.ndarray  # of each token: its word
    sizes: np.ndarray  # tokens of each text
    training: np.ndarray  # whether each text trains
    runs: list[Runs | None] = field(default_factory=list)  # by length; those that are done with go
    p: np.ndarray | None = None  # of each token: its probability in its longest state so far

    def __post_init__(self) -> None:
        ends = np.cumsum(self.sizes)
        self.train = np.repeat(self.training, self.sizes)
        self.closing = np.zeros(len(self.ids), dtype=bool)
        self.closing[ends - 1] = True

    def _spread(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """values by token, -1 elsewhere."""
        out = np.full(len(self.ids), -1, dtype=np.int32)
        out[at] = values
        return out

    def next_runs(self) -> Runs:
        """The runs that are one longer than the last."""
        none = np.zeros(0, dtype=np.int64)
        if not self.runs:
            return Runs(np.arange(len(self.ids)), self.ids, self.words, np.arange(len(self.words)), none, none)
        last = self.runs[-1]
        at, context = self.followers(len(self.runs))
        mine = (last.count >= MIN_SUCCESSOR)[last.run]
        if len(last.at) < len(self.ids):
            listed = np.zeros(len(self.ids), dtype=bool)
            listed[last.at] = mine
            mine = listed
        mine = mine[at]
        at, context = at[mine], context[mine]
        shift = len(self.words).bit_length()
        pairs, first, run = distinct(context.astype(np.int64) << shift | self.ids[at], len(last.keys) << shift)
        context, word = pairs >> shift, pairs & ((1 << shift) - 1)
        keys = textvec.mix(last.keys[context] * _CHAIN + self.words[word])
        return Runs(at, run, keys, key_order(keys), context, at[first])

    def trained(self, runs: Runs) -> np.ndarray:
        """How often each run occurs in the group's training texts."""
        return np.bincount(runs.run[self.train[runs.at]], minlength=len(runs.keys))

    def followers(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens that follow a tested context of this depth, and the context of each."""
        runs = self.runs[depth - 1]
        if runs.next is None:
            mine = (runs.count >= MIN_CONTEXT)[runs.run] & ~self.closing[runs.at]
            runs.next = runs.at[mine] + 1, runs.run[mine]
        return runs.next

    def contexts(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(asked, settled, pair): contexts to ask for, by key; others that the group can judge itself, and their listed pair or -1.

        Where the pairs that the group sees leave too few occurrences for another
        listed one, it knows all that the test needs. Such contexts of one listed pair
        at most are judged here, by the same sums; owners send theirs all the same.
        """
        runs, longer = self.runs[depth - 1], self.runs[depth]
        used = np.zeros(len(runs.keys), dtype=bool)
        used[self.followers(depth)[1]] = True
        listed = np.flatnonzero(longer.count >= MIN_SUCCESSOR)
        # A pair that is not listed occurs once at most, and then its owner is where it does.
        seen = np.bincount(longer.context, np.maximum(longer.count, longer.owned), len(runs.keys))
        many = np.bincount(longer.context[listed], minlength=len(runs.keys))
        owning = np.zeros(len(runs.keys), dtype=bool)
        owning[longer.context[listed[longer.owned[listed]]]] = True
        clear = (runs.count - seen < MIN_SUCCESSOR) & (many <= 1) & ~owning
        asked = used & ~clear
        settled = np.flatnonzero(used & clear)
        pair = np.full(len(runs.keys), -1, dtype=np.int64)
        pair[longer.context[listed]] = listed
        return runs.order[asked[runs.order]], settled, pair[settled]

    def learn(self, depth: int, told: np.ndarray) -> None:
        """Takes the answers about the contexts of a depth, judges the settled ones, and moves p down to that depth."""
        runs, longer = self.runs[depth - 1], self.runs[depth]
        runs.rest = np.full(len(runs.keys), -1, dtype=np.int64)
        asked, settled, pair = self.contexts(depth)
        runs.rest[asked] = told
        settled, pair = settled[pair >= 0], pair[pair >= 0]
        n, c, p = runs.count[settled], longer.count[pair], self.p[longer.first[pair]]
        runs.rest[settled] = _states(n, np.ones(len(n), dtype=np.int64), c, p, c * np.log(c / n / p))
        at, context = self.followers(depth)
        runs.next = None
        state = (runs.rest >= 0)[context]
        at, context = at[state], context[state]
        pair = self._spread(longer.at, longer.run)[at]
        count = np.append(longer.count, 0)[pair]  # the last is for those without a pair
        self.p[at] = (count + runs.rest[context] * self.p[at]) / (runs.count + 1)[context]
        # Nothing below this depth is looked at again, but the counts of single words.
        self.runs[depth - 1] = Runs(count=runs.count) if depth == 1 else None
        longer.context = longer.first = longer.owned = None

    def sums(self, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The contexts to ask for, and by context over the pairs that the group owns n, k, listed, expected and gain."""
        runs, longer = self.runs[depth - 1], self.runs[depth]
        mine = np.flatnonzero(longer.owned & (longer.count >= MIN_SUCCESSOR))
        context, c, p = longer.context[mine], longer.count[mine], self.p[longer.first[mine]]
        n, size = runs.count[context], len(runs.keys)
        chosen = self.contexts(depth)[0]
        of = [np.bincount(context, minlength=size), np.bincount(context, c, size), np.bincount(context, p, size), np.bincount(context, c * np.log(c / n / p), size)]
        k, listed, expected, gain = (x[chosen] for x in of)
        return chosen, [np.where(k > 0, runs.count[chosen], 0), k.astype(np.int32), listed.astype(np.int64), expected, gain]


def _read(table: pa.Table, lengths: int, depths: int, norm: float) -> Group:
    """A group from its row of tokens and the rows of answers to it, about runs up to a length and contexts up to a depth."""
    rows = table.select(["kind", "length", "part", "data"]).to_pylist()
    (tokens,) = (r["data"] for r in rows if r["kind"] == _TOKENS)
    group = Group(unpacked_keys(tokens[0]), unpacked(tokens[1], np.uint32).astype(np.int32), unpacked(tokens[2], np.int64), unpacked(tokens[3], np.bool_))
    answers = sorted((r for r in rows if r["kind"] != _TOKENS), key=lambda r: (r["length"], r["kind"], r["part"]))

    def joined(kind: int, length: int, i: int, dtype: type) -> np.ndarray:
        parts = [unpacked(r["data"][i], dtype) for r in answers if (r["kind"], r["length"]) == (kind, length)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)

    for length in range(1, lengths + 1):
        runs = group.next_runs()
        runs.count, runs.owned = np.zeros(len(runs.keys), dtype=np.int64), np.zeros(len(runs.keys), dtype=bool)
        runs.count[runs.order], runs.owned[runs.order] = joined(_COUNTS, length, 0, np.int64), joined(_COUNTS, length, 1, np.bool_)
        group.runs.append(runs)
        if length == 1:
            group.p = ((runs.count + 1) / norm)[group.ids]
        elif length - 1 <= depths:
            group.learn(length - 1, joined(_STATES, length - 1, 0, np.int64))
    return group


def _tidy(f: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """f, after which the worker gives back what it no longer uses: it may idle beside others that Spark starts meanwhile."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        made = f(key, table)
        give_back()
        return made

    return run


def _groups(df: DataFrame, column: str, kept: list[str], training: Column, group_tokens: int) -> DataFrame:
    """One row for each group of texts: its words, tokens, sizes, training flags, and the texts' other columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    named = df.select(F.col(f"`{column}`").alias("text"), F.coalesce(training, F.lit(False)).alias("train"), row.alias("row"))
    schema = T.StructType([*T.StructType.fromDDL(f"{_ROWS}, tokens long").fields, T.StructField("rows", T.ArrayType(named.schema["row"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []

        def group() -> pa.RecordBatch:
            words, ids = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            sizes, flags = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            data = [packed_keys(words), packed(ids.astype(np.uint32)), packed(sizes.astype(np.int64)), packed(flags)]
            rows = pa.concat_arrays([h[3] for h in held])
            lists = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.RecordBatch.from_arrays([pa.array([g]), pa.array([_TOKENS], pa.int32()), pa.array([0], pa.int32()), pa.array([0]), pa.array([data], pa.list_(pa.binary())), pa.array([len(ids)]), lists], names=schema.names)

        size = 0
        for batch in batches:
            flags = batch["train"].to_numpy(zero_copy_only=False).astype(bool)
            for chunk in textvec.chunks(batch["text"]):
                tokens, edges = closed_words(chunk)
                mine = slice(chunk.first, chunk.first + len(chunk))
                held.append((tokens, np.diff(edges), flags[mine], batch["row"].slice(chunk.first, len(chunk))))
                size += len(tokens)
                if size >= group_tokens:
                    yield group()
                    g, size = g + 1, 0
                    held.clear()
        if held:
            yield group()

    return named.mapInArrow(run, schema)


def _asking(length: int | None, depth: int | None, lengths: int, depths: int, ranges: int, norm: float) -> Callable[[tuple, pa.Table], pa.Table]:
    """What a group asks: counts of its runs of a length, and whether its contexts of a depth are states."""

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        group, g = _read(table, lengths, depths, norm), key[0].as_py()
        out: list[tuple] = []

        def send(kind: int, keys: np.ndarray, columns: list[np.ndarray]) -> None:
            edges = _by_range(keys, ranges).tolist()
            out.extend((kind * ranges + r, kind, g, [packed_keys(keys[a:b]), *(packed(x[a:b]) for x in columns)]) for r, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a)

        if length:
            runs = group.next_runs()
            send(_COUNTS, runs.keys[runs.order], [group.trained(runs)[runs.order].astype(np.int64)])
        if depth:
            asked, sums = group.sums(depth)
            send(_STATES, group.runs[depth - 1].keys[asked], sums)
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.binary()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "kind", "g", "data"])

    return ask


def _states(n: np.ndarray, k: np.ndarray, listed: np.ndarray, expected: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """b of each context that the divergence test keeps, -1 of others."""
    left = n - listed
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gain + np.where(left > 0, left * np.log(left / n / np.maximum(1 - expected, 1e-12)), 0.0)
        return np.where(gain > k * np.log(n) / 2, left + 1, -1).astype(np.int64)


def _answering(length: int | None, depth: int | None) -> Callable[[pa.Table], pa.Table]:
    """The answers of one range of keys to all groups that asked."""

    def answer(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["g"])  # one order of adding, whichever group comes first
        kind, part = rows[0]["kind"], rows[0]["part"]
        sizes = []
        keys = []
        for r in rows:
            keys.append(unpacked_keys(r["data"][0]))
            sizes.append(len(keys[-1]))
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")  # of each key, the groups in order
        new = np.ones(len(keys), dtype=bool)
        new[1:] = np.diff(keys[order]) != 0
        starts = np.flatnonzero(new)
        of = np.empty(len(keys), dtype=np.int64)
        of[order] = np.cumsum(new) - 1
        column = lambda i, dtype: np.concatenate([unpacked(r["data"][i], dtype) for r in rows])[order]
        if kind == _COUNTS:
            own = column(1, np.int64)
            total = np.add.reduceat(own, starts)
            stats = (int(total.sum()), int((total > 0).sum()))
            having = np.flatnonzero(own)
            run = of[order[having]]
            owner = np.zeros(len(keys), dtype=bool)
            owner[order[having[np.flatnonzero(np.diff(run, prepend=-1))]]] = True
            told = total if length == 1 else np.where(total >= MIN_SUCCESSOR, total, 0)
            made = [told[of], owner]
        else:
            n = np.maximum.reduceat(column(1, np.int64), starts)  # owners know it, others send 0
            added = [np.add.reduceat(column(i, t), starts) for i, t in ((2, np.int32), (3, np.int64), (4, np.float64), (5, np.float64))]
            rest = _states(n, *added)
            stats = (len(starts), int((rest >= 0).sum()))
            made = [rest[of]]
        ends = np.cumsum(sizes).tolist()
        out = [(r["g"], kind, length if kind == _COUNTS else depth, part, [packed(x[end - size : end]) for x in made], None, None) for r, size, end in zip(rows, sizes, ends, strict=True)]
        out.append((-1, kind, 0, part, None, *stats))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["g", "kind", "length", "part", "data", "n", "v"])

    return answer


def _scoring(kept: list[str], schema: T.StructType, norm: float, n: int, lengths: int, depth: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def score(_: tuple, table: pa.Table) -> pa.Table:
        group = _read(table, lengths, depth, norm)
        (rows,) = (x for x in table["rows"].combine_chunks() if x.is_valid)
        rows = rows.values
        texts = len(group.sizes)
        owner = np.repeat(np.arange(texts), group.sizes)
        count = group.runs[0].count[group.ids]
        base = np.bincount(owner, np.log10((count + 1) / norm), texts)
        found = np.bincount(owner, np.log10(group.p), texts)
        known = np.bincount(owner[count > 0], minlength=texts)
        columns = [*rows.flatten()[: len(kept)], pa.array(group.sizes), pa.array(known.astype(np.int64)), pa.array(np.full(texts, n)), pa.array(base), pa.array(found)]
        return pa.Table.from_arrays(columns, names=schema.names)

    return score


def score_texts(df: DataFrame, training: Column, column: str = "text", max_depth: int | None = MAX_DEPTH, group_tokens: int = GROUP_TOKENS, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """df without its text, with n_tokens, n_known, train_tokens, base_score and score (log10).

    The rows where training holds train the tree; all rows are scored with it.
    """
    kept = [c for c in df.columns if c not in (column, *RESULT)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, T.DoubleType() if c.endswith("score") else T.LongType()) for c in RESULT])
    with Scratch(df.sparkSession) as scratch:
        groups = scratch.written(_groups(df, column, kept, training, group_tokens), "groups", **_PLAIN)
        many, tokens = groups.select(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        partitions = max(1, min(many, MAX_PARTITIONS))
        ranges = max(4, -(-tokens // range_tokens))
        answers: list[DataFrame] = []
        names = [f.name for f in T.StructType.fromDDL(_ROWS).fields]

        def together(extra: tuple[str, ...] = ()) -> DataFrame:
            every = groups.select(*names, *extra)
            for a in answers:
                every = every.unionByName(a.filter("g >= 0").select(*names), allowMissingColumns=True)
            return every.repartition(partitions, "g").groupBy("g")

        norm, n, lengths, depth, step = 1.0, 0, 0, 0, 1
        limit = float("inf") if max_depth is None else max_depth
        while True:
            # The runs of a length are asked one step before the contexts of which they are pairs.
            length = step if step <= limit + 1 else None
            tested = step - 2 if 0 < step - 2 <= limit else None
            if not length and not tested:
                break
            asks = together().applyInArrow(_tidy(_asking(length, tested, lengths, depth, ranges, norm)), _ASKS)
            ranged = asks.repartition(min(2 * ranges if tested else ranges, MAX_PARTITIONS), "part").groupBy("part")
            made = scratch.written(ranged.applyInArrow(_answering(length, tested), _ANSWERS), "answers", **_PLAIN)
            stats = {r["kind"]: r for r in made.filter("g < 0").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
            answers.append(made)
            lengths = length or lengths
            if step == 1:
                n, distinct = (stats[_COUNTS]["n"], stats[_COUNTS]["v"]) if stats else (0, 0)
                norm = float(n + 1 * (distinct + 1))
                if not n:
                    break
            # The context cleaner drops the shuffle files of what is written once nothing refers to it.
            del asks, ranged
            gc.collect()
            df.sparkSession._jvm.System.gc()
            if tested:
                if not stats.get(_STATES) or not stats[_STATES]["v"]:
                    break
                depth = tested
            step += 1
        return written(together(("rows",)).applyInArrow(_tidy(_scoring(kept, schema, norm, n, lengths, depth)), schema), "scored")
