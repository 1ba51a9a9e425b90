"""Best-fit packing of token sequences by the sum-of-squares rule.

Texts become pieces of at most `capacity` tokens, and pieces go one after the
other into sequences of that size, longest first. With N(g) open sequences that
have g tokens left, a piece goes to the open sequence that holds it for which
the sum over g of N(g)**2 becomes smallest, and to a new one where none holds it.
The rule keeps gaps of all sizes in stock, so that later, smaller pieces find
exact fits.

Pieces (without their ids) are written to the shared folder, counted, and dealt
to as many parts as keep each at PART_PIECES or fewer. A part is sorted by
length and then by all columns, so a lost task repeats itself exactly; it holds
one counter and one stack of open sequences per gap, never its rows. Where there
are several parts, the sequences that are left with room in any of them are packed
again, each as one piece of what it holds, so that parts don't each waste some.

Null texts count as empty (their closing token alone). Texts are taken whole,
and only those longer than a sequence are cut. Repeated rows are packed once
each. An empty table gives an empty result. Other columns of the texts pass
through; columns named like a result are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textvec, tokens
from tidemark.llm.shared import free_name, written
from tidemark.llm.workers import tidy

CAPACITY = 4096
CLOSING_ID = 1
PART_PIECES = 200_000


class SumOfSquares:
    """Online packing of lengths into bins of one capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        c, n = self.capacity, self.counts
        at = offset = 0
        rest = c - length
        fits = n[length:c] > 0
        if fits.any():
            # How the sum of squares changes when a bin moves from gap g to g - length.
            after = 2 * (n[: c - length] - n[length:c] + 1)
            after[0] = 1 - 2 * n[length]  # a full bin has no gap to count
            gap = length + int(np.argmin(np.where(fits, after, np.iinfo(np.int64).max)))
            at = self.open[gap].pop()
            n[gap] -= 1
            offset, rest = c - gap, gap - length
        else:
            at = self.bins
            self.bins += 1
        if rest:
            n[rest] += 1
            self.open[rest].append(at)
        return at, offset


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _parts(kept: DataFrame, length: str, capacity: int, part_pieces: int) -> tuple[DataFrame, int]:
    """kept packed in parts of at most part_pieces, and the number of parts."""
    parts = max(1, -(-kept.count() // part_pieces))
    rest = [F.col(f"`{f.name}`") if _orderable(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in kept.schema if f.name != length]
    dealt = kept.repartition(parts).sortWithinPartitions(F.col(f"`{length}`").desc(), *rest)
    schema = T.StructType(kept.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        bins = SumOfSquares(capacity)
        for batch in batches:
            placed = [bins.place(n) for n in batch[length].to_pylist()]
            found = np.array(placed, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found[:, 0] + base), pa.array(found[:, 1])], names=schema.names)

    return dealt.mapInArrow(tidy(run), schema), parts


def pack(df: DataFrame, length: str = "length", capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """df with sequence_id and offset (both long); every length is from 1 to capacity."""
    packed, parts = _parts(df.drop("sequence_id", "offset"), length, capacity, part_pieces)
    if parts == 1:
        return packed
    placed = written(packed, "packed")
    used = placed.groupBy("sequence_id").agg(F.sum(length).alias("used")).filter(F.col("used") < capacity)
    again, _ = _parts(written(used.select(F.col("sequence_id").alias("block"), "used"), "open"), "used", capacity, part_pieces)
    # Numbers of the second packing lie above those of the first.
    moved = again.select(F.col("block").alias("sequence_id"), (F.col("sequence_id") + (1 << 62)).alias("to"), F.col("offset").alias("by"))
    name, at = free_name(df, "sequence"), free_name(df, "offset")
    own = placed.withColumnsRenamed({"sequence_id": name, "offset": at})
    both = own.join(written(moved, "moved").withColumnRenamed("sequence_id", name), name, "left")
    return both.select(*[f"`{c}`" for c in placed.columns if c not in ("sequence_id", "offset")], F.coalesce("to", name).alias("sequence_id"), (F.col(at) + F.coalesce("by", F.lit(0))).alias("offset"))


def token_pieces(df: DataFrame, tokenizer: str, column: str = "text", capacity: int = CAPACITY, closing: int = CLOSING_ID) -> DataFrame:
    """For each text its pieces: df's columns without the text, piece, start, length, ids_crc32."""
    named = ("piece", "start", "length", "ids_crc32")
    kept = [c for c in df.columns if c not in (column, *named)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, T.IntegerType() if n == "piece" else T.LongType()) for n in named])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder(tokenizer)
        for batch in batches:
            for chunk in textvec.chunks(batch[column]):
                ids, edges = encoder.encode(chunk)
                n = len(chunk)
                # One closing id behind each text's ids.
                closed = np.full(len(ids) + n, closing, dtype="<u4")
                shift = edges + np.arange(n + 1)
                inside = np.ones(len(closed), dtype=bool)
                inside[shift[1:] - 1] = False
                closed[inside] = ids
                sizes = np.diff(shift)
                count = -(-sizes // capacity)
                owner = np.repeat(np.arange(n), count)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, sizes[owner] - start)
                at = shift[owner] + start
                sums = [zlib.crc32(closed[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                rows = pa.array(owner + chunk.first)
                yield pa.RecordBatch.from_arrays(
                    [batch[c].take(rows) for c in kept] + [pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, type=pa.int64())],
                    names=schema.names,
                )

    return df.select(*[f"`{c}`" for c in kept], f"`{column}`").mapInArrow(tidy(run), schema)


def pack_texts(df: DataFrame, tokenizer: str, column: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all texts of df with the sequence and offset of each."""
    return pack(written(token_pieces(df, tokenizer, column, capacity), "pieces"), "length", capacity)
