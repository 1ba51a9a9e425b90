"""FNV-1a over length-prefixed fields, and the CRC seal of a segment, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 64-bit offset basis in halves; the prime is 2**40 + 435.
_HIGH, _LOW = 0xCBF29CE4, 0x84222325
_MASK = 0xFFFFFFFF


def fnv1a64(text: Column) -> Column:
    """The 64-bit FNV-1a hash of a text's UTF-8 bytes, as 16 hex digits.

    The state is kept in two halves of 32 bits, so no product leaves a long.
    """
    code = F.hex(F.encode(text, "UTF-8"))
    n = F.octet_length(text)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    byte = F.transform(at, lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    start = F.struct(F.lit(_HIGH).cast("long").alias("high"), F.lit(_LOW).cast("long").alias("low"))

    def step(state: Column, b: Column) -> Column:
        x = state["low"].bitwiseXOR(b)
        product = x * 435
        high = state["high"] * 435 + F.shiftrightunsigned(product, 32) + F.shiftleft(x.bitwiseAND(0xFFFFFF), 8)
        return F.struct(high.bitwiseAND(_MASK).alias("high"), product.bitwiseAND(_MASK).alias("low"))

    return F.aggregate(byte, start, step, lambda s: F.lower(F.concat(F.lpad(F.hex(s["high"]), 8, "0"), F.lpad(F.hex(s["low"]), 8, "0"))))


def fields_hash(*fields: Column) -> Column:
    """fnv1a64 over the fields, each as its byte length, a colon and itself."""
    parts = [F.concat(F.octet_length(f).cast("string"), F.lit(":"), f) for f in (F.coalesce(f, F.lit("")) for f in fields)]
    return fnv1a64(F.concat(*parts))
