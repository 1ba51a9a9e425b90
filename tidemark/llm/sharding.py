"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: a start
and a stride, both from a digest of its name. Shards take turns claiming their
next free slot until the table is full, so that slots are dealt evenly, and
taking one shard away moves few rows besides its own. A row's slot is an MD5
digest of its key (60 bits) modulo the table size; the table has a fixed number of rows, is
broadcast, and placement is one probe.

Nulls: a null key counts as its own value and always lands in the same slot.
Repeated rows with one key go to one shard. An empty input gives an empty
result. Other columns pass through; columns named slot or shard are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots; a prime well above the number of shards keeps the shares within a percent.
TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The index of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct and not empty")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime no smaller than the number of shards")
    owner = [-1] * size
    digests = [hashlib.sha256(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8]) % size for d in digests]
    stride = [int.from_bytes(d[8:16]) % (size - 1) + 1 for d in digests]
    left = size
    while left:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + stride[i]) % size
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def assign_shards(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """df with slot (int) and shard (string) for each row."""
    owner = lookup_table(shards, size)
    spark = df.sparkSession
    slots = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, owner))), ",")).alias("slot", "n"))
    names = F.array(*[F.lit(s) for s in shards])
    slots = slots.select("slot", F.element_at(names, F.col("n").cast("int") + 1).alias("shard"))
    named = F.coalesce(F.concat(F.lit("k"), F.col(f"`{key}`").cast("string")), F.lit("none"))
    digest = F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")
    placed = df.drop("slot", "shard").withColumn("slot", F.pmod(digest, F.lit(size)).cast("int"))
    # The table has `size` rows whatever the input; that bound is what allows the broadcast.
    return placed.join(F.broadcast(slots), "slot").select(*[c for c in placed.columns if c != "slot"], "slot", "shard")
