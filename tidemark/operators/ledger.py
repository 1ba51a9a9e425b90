"""The event ledger's projection: queries, gaps, ingestion outcomes, verification marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import windows

#: Event classes and tiers, as written in segments.
CLASSES = ("ingest", "route", "decision", "state_change", "claim", "delivery", "projection", "health", "approval", "note_meta")
TIERS = ("metadata_only", "structured", "confidential")
OVERFETCH = 5


def class_key(x: Column) -> Column:
    """One spelling for both that are in use: lower case, without underscores or hyphens."""
    return F.regexp_replace(F.lower(x), "[_-]", "")


def _as_written(x: Column, names: Sequence[str], default: str) -> Column:
    """A class or tier in either spelling as segments write it; the default for any other."""
    table = F.create_map(*[F.lit(v) for n in names for v in (n.replace("_", ""), n)])
    return F.coalesce(F.try_element_at(table, class_key(x)), F.lit(default))


def decoded(events: DataFrame, now: Column) -> DataFrame:
    """Stored rows (all strings but source_seq) as typed events, as well as can be.

    What can't be read gets a default rather than failing the query: a nil id, the
    time now, class health, tier metadata_only, a null payload or reference.
    """
    uuid = lambda c: F.when(F.col(c).rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lower(c))
    return events.withColumns(
        {
            "event_id": F.coalesce(uuid("event_id"), F.lit("00000000-0000-0000-0000-000000000000")),
            "timestamp": F.coalesce(X.parsed_time(F.col("timestamp")), now),
            "correlation_id": uuid("correlation_id"),
            "causation_id": uuid("causation_id"),
            "event_class": _as_written(F.col("event_class"), CLASSES, "health"),
            "payload_tier": _as_written(F.col("payload_tier"), TIERS, "metadata_only"),
            "payload": F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")),
        }
    )


def recent(events: DataFrame, limit: int, *where: Column, ts: str = "timestamp", tie: str = "event_id") -> DataFrame:
    """The newest events that meet all conditions; ids break ties."""
    for w in where:
        events = events.filter(w)
    return events.orderBy(F.col(ts).desc(), F.col(tie)).limit(limit)


def correlated(events: DataFrame, correlation_id: str) -> DataFrame:
    """All events of one correlation, oldest first."""
    return events.filter(F.col("correlation_id") == correlation_id).orderBy("timestamp", "event_id")


def subsystem(payload: Column, object_ref: Column) -> Column:
    """The payload's subsystem, else what the object reference names."""
    named = F.when(object_ref.startswith("subsystem:"), F.substring(object_ref, 11, 1 << 30))
    return F.coalesce(F.get_json_object(payload, "$.subsystem"), named)


def query(events: DataFrame, limit: int, cutoff: Column | None = None, event_class: str | None = None, subsystems: Sequence[str] = (), exact: bool = True, overfetch: int = OVERFETCH) -> DataFrame:
    """Newest events by cutoff, class and subsystem patterns.

    exact filters before the limit, so filters reach the scan; otherwise only the
    newest overfetch * limit events are looked at.
    """
    found = events if exact else recent(events, overfetch * limit)
    if cutoff is not None:
        found = found.filter(F.col("timestamp") >= cutoff)
    if event_class is not None:
        found = found.filter(class_key(F.col("event_class")) == class_key(F.lit(event_class)))
    if subsystems:
        name = subsystem(F.col("payload"), F.col("object_ref"))
        hit = F.lit(False)
        for p in subsystems:
            hit = hit | X.glob_match(name, p)
        found = found.filter(hit)
    return recent(found, limit)


def gaps(segments: DataFrame) -> DataFrame:
    return windows.missing_numbers(segments, "source", "source_seq")


def latest(segments: DataFrame) -> DataFrame:
    return segments.groupBy("source").agg(F.max("source_seq").alias("latest_seq"), F.count("*").alias("segments"))


def ingest_outcomes(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """Each incoming (source, source_seq, digest) as committed, skipped (there already) or failed (there, but different)."""
    have = store.select("source", "source_seq", F.col("digest").alias("_have"))
    joined = incoming.join(have, ["source", "source_seq"], "left")
    outcome = F.when(F.col("_have").isNull(), "committed").when(F.col("_have") == F.col("digest"), "skipped").otherwise("failed")
    return joined.withColumn("outcome", outcome).drop("_have")


def new_segments(listed: DataFrame, ingested: DataFrame) -> DataFrame:
    return listed.join(ingested.select("source", "source_seq"), ["source", "source_seq"], "left_anti")


def new_events(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Events whose id is not stored; of repeats within the batch the first by source and number."""
    fresh = events.join(stored.select("event_id"), "event_id", "left_anti")
    return windows.first_rows(fresh, ["event_id"], ["source", "source_seq"])


def to_verify(segments: DataFrame, marks: DataFrame, failures: DataFrame, missing: DataFrame) -> DataFrame:
    """Segments above their source's mark, and those below that failed or were missing before."""
    again = failures.select("source", "source_seq").union(missing.select("source", "source_seq")).distinct().withColumn("_again", F.lit(True))
    joined = segments.join(marks.select("source", "mark"), "source", "left").join(again, ["source", "source_seq"], "left")
    return joined.filter((F.col("source_seq") > F.coalesce("mark", F.lit(0))) | F.col("_again").isNotNull()).drop("mark", "_again")


def unseen(handles: DataFrame, processed: DataFrame) -> DataFrame:
    """Sessions whose id and key no earlier run has processed."""
    done = processed.select(F.col("id").alias("_done")).distinct()
    return handles.join(done, F.col("session_id") == F.col("_done"), "left_anti").join(done, F.col("dedupe_key") == F.col("_done"), "left_anti")


def first_reader_wins(handles: DataFrame) -> DataFrame:
    return windows.first_rows(handles, ["dedupe_key"], ["reader_rank", "path"])
