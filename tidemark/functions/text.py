"""Scalar functions on strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How control characters are written by quoted().
_ESCAPES = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
#: Entities of message envelopes; the ampersand comes last.
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}
TRUNCATED = " … [truncated]"
SUB_AGENT_PREFIX = "0" * 16


def trim_all(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def trim_start(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+", "")


def truncated(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def truncated_marked(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(TRUNCATED))).otherwise(x)


def quoted(x: Column) -> Column:
    """In single quotes, with quotes, backslashes and control characters escaped."""
    for raw, code in _ESCAPES.items():
        x = F.replace(x, F.lit(raw), F.lit(code))
    for n in range(0x20):
        if chr(n) not in _ESCAPES:
            x = F.replace(x, F.lit(chr(n)), F.lit(f"\\x{n:02x}"))
    return F.concat(F.lit("'"), x, F.lit("'"))


def display_safe(x: Column) -> Column:
    """Backticks as quotes and control characters as spaces."""
    return F.regexp_replace(F.translate(x, "`", "'"), r"\p{Cntrl}", " ")


def session_role(session_id: Column) -> Column:
    """What stands behind the first underscore; null if nothing does."""
    return F.nullif(F.regexp_extract(session_id, r"(?s)^[^_]*_(.+)$", 1), F.lit(""))


def is_sub_agent(session_id: Column) -> Column:
    return session_id.startswith(SUB_AGENT_PREFIX) | session_id.rlike("^agent-[0-9a-fA-F]+$")


def trailing_uuid(x: Column) -> Column:
    found = F.regexp_extract(x, r"^[\x00-\x7F]*?([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$", 1)
    return F.nullif(found, F.lit(""))


def without_agent(x: Column) -> Column:
    """What stands behind the first colon, or all of it if nothing does."""
    return F.coalesce(F.nullif(F.regexp_extract(x, r"(?s)^[^:]*:(.+)$", 1), F.lit("")), x)


def id_of_stem(x: Column) -> Column:
    """What stands behind the first underscore, or all of it if nothing does."""
    return F.coalesce(session_role(x), x)


def entities_decoded(x: Column) -> Column:
    for code, raw in _ENTITIES.items():
        x = F.replace(x, F.lit(code), F.lit(raw))
    return x


def envelope_text(x: Column) -> Column:
    """The texts of all message envelopes, one a line; the trimmed text if it has none."""
    inner = F.regexp_extract_all(x, F.lit(r"(?s)<message\b[^>]*>(.*?)</message>"), 1)
    texts = F.filter(F.transform(inner, lambda t: trim_all(entities_decoded(t))), lambda t: t != "")
    return F.when(F.size(inner) > 0, F.array_join(texts, "\n")).otherwise(trim_all(x))


def backticked(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, "`([^`]*)`", 1), F.lit(""))


def minute_range(low: Column, high: Column) -> Column:
    return F.concat(F.date_format(low, "HH:mm"), F.lit("-"), F.date_format(high, "HH:mm"))


def dollars(x: Column) -> Column:
    """A decimal's text with two places at least; further places only where they count."""
    plain = x.cast("string")
    point = F.when(F.instr(plain, ".") > 0, F.regexp_replace(plain, r"0+$", "")).otherwise(F.concat(plain, F.lit(".")))
    places = F.length(point) - F.instr(point, ".")
    return F.concat(F.lit("$"), F.when(places < 2, F.rpad(point, F.instr(point, ".") + 2, F.lit("0"))).otherwise(point))


def idempotency_key(x: Column) -> Column:
    return F.substring(F.regexp_replace(x, r"(?U)\s", "-"), 1, 240)


def glob_match(x: Column, pattern: str) -> Column:
    """Equal, or beginning so where the pattern ends in a star."""
    return x.startswith(pattern[:-1]) if pattern.endswith("*") else x == pattern


def segment_name(source: Column, seq: Column) -> Column:
    return F.format_string("%s-%06d.json", source, seq)


def valid_source(x: Column) -> Column:
    return x.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$")


def parsed_time(x: Column) -> Column:
    """An ISO 8601 time, UTC where it names no zone; null for all else, dates alone included."""
    shaped = F.when(x.rlike(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)?$"), F.regexp_replace(F.upper(x), r"(\.\d{1,6})\d*", "$1"))
    return F.try_to_timestamp(shaped)


def exact_decimal(x: Column) -> Column:
    """A JSON number or string as a decimal, never by way of a double."""
    return x.try_cast("decimal(28,12)")


def micro_dollars(x: Column) -> Column:
    return (x.cast("decimal(20,0)") * F.lit(1).cast("decimal(1,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(28,6)")


def slug(x: Column) -> Column:
    return F.regexp_replace(x, r"[^A-Za-z0-9._-]", "-")
