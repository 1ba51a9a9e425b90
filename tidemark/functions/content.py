"""Message contents: JSON values as variants, and the texts inside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(v: Column) -> Column:
    """string, array, object, boolean, null, number, or SQL null for no value."""
    named = F.regexp_extract(F.lower(F.schema_of_variant(v)), "^(string|boolean|void|array|object)", 1)
    return F.when(v.isNotNull(), F.element_at(_kinds(), named))


def _kinds() -> Column:
    """Kinds by how a schema begins; all else are numbers (or dates, which JSON has not)."""
    names = {"string": "string", "boolean": "boolean", "void": "null", "array": "array", "object": "object", "": "number"}
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def text_at(v: Column, path: str) -> Column:
    """The string there, or null if there is another kind of value or none."""
    found = at(v, path)
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, path, "string"))


def compact(v: Column) -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(v)


def as_string(v: Column) -> Column:
    """A string as it is, any other value as JSON."""
    return F.when(kind(v) == "string", v.cast("string")).otherwise(compact(v))


def content_string(v: Column) -> Column:
    return F.coalesce(as_string(v), F.lit(""))


def items(v: Column) -> Column:
    """An array's elements; empty for all else."""
    return F.coalesce(F.when(kind(v) == "array", v.try_cast("array<variant>")), F.array().cast("array<variant>"))


def is_block(b: Column, name: str) -> Column:
    return F.coalesce(text_at(b, "$.type") == name, F.lit(False))


def block_texts(v: Column, bare_strings: bool = False) -> Column:
    """Texts of an array's text blocks, one a line."""
    texts = F.transform(items(v), lambda b: F.when(is_block(b, "text"), text_at(b, "$.text")).when(F.lit(bare_strings) & (kind(b) == "string"), b.cast("string")))
    return F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n")


def assistant_text(v: Column) -> Column:
    return F.coalesce(F.when(kind(v) == "array", block_texts(v, True)).otherwise(content_string(v)), F.lit(""))


def result_text(v: Column) -> Column:
    return F.coalesce(F.when(kind(v) == "string", v.cast("string")).when(kind(v) == "array", block_texts(v)), F.lit(""))


def has_block(v: Column, name: str) -> Column:
    return F.exists(items(v), lambda b: is_block(b, name))


def keys(v: Column) -> Column:
    """An object's keys, empty for all else."""
    return F.coalesce(F.when(kind(v) == "object", F.json_object_keys(compact(v))), F.array().cast("array<string>"))


def keys_within(v: Column, allowed: tuple[str, ...]) -> Column:
    return F.size(F.array_except(keys(v), F.array(*[F.lit(k) for k in allowed]))) == 0


def is_null(v: Column) -> Column:
    """Absent or a JSON null."""
    return v.isNull() | (kind(v) == "null")
