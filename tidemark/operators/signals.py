"""Signals: one wide table of five kinds, their titles, identities, and the split by what earlier runs knew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.functions import text as X
from tidemark.operators import windows

#: Kinds in their order; the cap of titles; days that the ledger keeps.
KINDS = ("correction", "error", "workaround", "deferral", "pattern")
TITLE_CHARS = 80
RETENTION_DAYS = 90
COLUMNS = (
    "kind string, kind_ord int, session_id string, scan_ord long, seq long, block int, context string, tool_name string, message string, call_level boolean, "
    "pattern string, item string, description string, pattern_kind string, evidence string"
)


def all_signals(corrections: DataFrame, errors: DataFrame, workarounds: DataFrame, deferrals: DataFrame, patterns: DataFrame) -> DataFrame:
    """The five kinds one under another, each with its place in the fixed order."""
    parts = (corrections, errors, workarounds, deferrals, patterns.withColumnsRenamed({"kind_order": "block", "at": "seq"}))
    out = None
    for i, (kind, part) in enumerate(zip(KINDS, parts, strict=True)):
        part = part.withColumns({"kind": F.lit(kind), "kind_ord": F.lit(i)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def title(prefix: str = "signal", by_session: Sequence[str] = ("codex_fallback_main",)) -> Column:
    """The title by which trackers know a signal of the wide table."""

    def made(kind: str, lead: str, text: str) -> Column:
        return F.concat(F.lit(f"[{prefix}/{kind}] "), F.col(lead), F.lit(": "), X.truncated(F.col(text), TITLE_CHARS))

    return (
        F.when(F.col("kind") == "correction", made("correction", "session_id", "context"))
        .when((F.col("kind") == "error") & F.col("tool_name").isin(*by_session), F.concat(F.lit(f"[{prefix}/error] "), F.col("tool_name"), F.lit(": "), F.col("session_id")))
        .when(F.col("kind") == "error", made("error", "tool_name", "message"))
        .when(F.col("kind") == "workaround", made("workaround", "pattern", "context"))
        .when(F.col("kind") == "pattern", made("pattern", "session_id", "description"))
        .otherwise(made("deferral", "session_id", "item"))
    )


def priority(kind: Column) -> Column:
    return F.when(kind.isin("correction", "pattern"), 2).otherwise(3)


def identity() -> Column:
    """kind:session:hash over the fields that make a signal of the wide table what it is.

    A pattern goes by its kind, a loop also by its tool: its counts grow while
    the session runs.
    """
    of = (
        F.when(F.col("kind") == "correction", hashing.fields_hash(F.col("context")))
        .when(F.col("kind") == "error", hashing.fields_hash(F.col("tool_name"), F.col("message")))
        .when(F.col("kind") == "workaround", hashing.fields_hash(F.col("pattern"), F.col("context")))
        .when(F.col("kind") == "deferral", hashing.fields_hash(F.col("item")))
        .when(F.col("pattern_kind") == "stuck_loop", hashing.fields_hash(F.col("pattern_kind"), X.backticked(F.col("description"))))
        .when(F.col("pattern_kind") != "", hashing.fields_hash(F.col("pattern_kind")))
        .otherwise(hashing.fields_hash(F.col("pattern_kind"), F.col("description")))
    )
    return F.concat_ws(":", "kind", "session_id", of)


def with_identity(signals: DataFrame, order: Sequence[str] = ("kind_ord", "scan_ord", "seq", "block")) -> DataFrame:
    """signals with id; the n-th repeat of one identity has "#n" behind it."""
    return windows.numbered_repeats(signals.withColumn("id", identity()), "id", order)


def split_by_ledger(signals: DataFrame, ledger: DataFrame) -> DataFrame:
    """signals with is_new (not counted before) and to_offer (not filed before)."""
    known = ledger.select("id", F.col("counted").alias("_c"), F.col("filed").alias("_f"))
    joined = signals.join(known, "id", "left")
    return joined.withColumns({"is_new": ~F.coalesce("_c", F.lit(False)), "to_offer": ~F.coalesce("_f", F.lit(False))}).drop("_c", "_f")


def merged_ledger(ledger: DataFrame, marks: DataFrame, run_date: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """The ledger after a run: flags add up, the first date and last session time stay, old and flagless rows go.

    Both: id, first_seen date, counted, filed, session_modified.
    """
    both = ledger.unionByName(marks)
    folded = both.groupBy("id").agg(F.min("first_seen").alias("first_seen"), F.bool_or("counted").alias("counted"), F.bool_or("filed").alias("filed"), F.max("session_modified").alias("session_modified"))
    return folded.filter((F.col("first_seen") >= F.date_sub(run_date, days)) & (F.col("counted") | F.col("filed")))


def kind_counts(signals: DataFrame, where: Column | None = None) -> DataFrame:
    """One row: how many of each kind, and in all."""
    chosen = F.lit(True) if where is None else where
    return signals.agg(*[F.count_if(chosen & (F.col("kind") == k)).alias(f"{k}s") for k in KINDS], F.count_if(chosen).alias("total"))


def counted_in_window(ledger: DataFrame, since: Column) -> DataFrame:
    """Counts by kind of counted entries whose session was last seen modified at or after since."""
    kinds = ledger.withColumn("kind", F.substring_index("id", ":", 1))
    return kind_counts(kinds, F.col("counted") & (F.col("session_modified") >= since))
