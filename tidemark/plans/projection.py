"""The ledger's queryable projection: Parquet tables of events and ingested segments.

Events are partitioned by day, so time cuts prune files; ids make replays harmless.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ledger
from tidemark.sources.segments import events_of, listed_segments, read_files

COLUMNS = ("event_id", "zone", "source", "source_seq", "timestamp", "correlation_id", "causation_id", "actor_ref", "object_ref", "event_class", "payload_tier", "payload")
SCHEMA = ", ".join(f"{c} {'long' if c == 'source_seq' else 'timestamp' if c == 'timestamp' else 'string'}" for c in COLUMNS) + ", day date"


def _table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


def _shaped(found: DataFrame) -> DataFrame:
    return found.select(*COLUMNS, F.to_date("timestamp").alias("day"))


@dataclass
class Refresh:
    """What one refresh did: segments and events added, (source, number, why) of bad segments, names that can't be parsed."""

    segments: int = 0
    events: int = 0
    failed: list[tuple[str, int | None, str]] = field(default_factory=list)
    unnamed: list[str] = field(default_factory=list)


def ingest(spark: SparkSession, checked: DataFrame, root: str, mode: str = "append") -> Refresh:
    """Adds the events of checked segment files that were not ingested yet.

    A segment is recorded once its events are stored, also one without any; a bad
    one is reported, not recorded, and so offered again after its repair.
    """
    checked = checked.persist()
    listed = checked.filter("fault IS NULL").select(F.col("segment_source").alias("source"), F.col("segment_seq").alias("source_seq")).distinct()
    done = _table(spark, f"{root}/segments", listed) if mode == "append" else listed.limit(0)
    new = ledger.new_segments(listed, done).persist()
    fresh = events_of(checked).join(new.select(F.col("source").alias("segment_source"), F.col("source_seq").alias("segment_seq")), ["segment_source", "segment_seq"], "left_semi")
    shaped = _shaped(fresh)
    stored = _table(spark, f"{root}/events", shaped) if mode == "append" else shaped.limit(0)
    added = ledger.new_events(shaped, stored).persist()
    out = Refresh(new.count(), added.count(), [tuple(r) for r in checked.filter("fault IS NOT NULL").select("segment_source", "segment_seq", "fault").orderBy("segment_source", "segment_seq").collect()])
    if out.segments or mode == "overwrite":
        added.repartition("day").sortWithinPartitions("day", "timestamp").write.mode(mode).partitionBy("day").parquet(f"{root}/events")
        new.write.mode(mode).parquet(f"{root}/segments")  # last: a failure before it only means that events are offered again
    for df in (added, new, checked):
        df.unpersist()
    return out


def refresh(spark: SparkSession, segments: str, root: str) -> Refresh:
    """Reads the segment files that are not in the projection yet, and no others."""
    listed = listed_segments(spark, segments)
    named = listed.filter("source IS NOT NULL")
    done = _table(spark, f"{root}/segments", named.select("source", "source_seq"))
    out = ingest(spark, read_files(spark, [r["file"] for r in ledger.new_segments(named, done).select("file").collect()]), root)
    out.unnamed = [r["name"] for r in listed.filter("source IS NULL").select("name").orderBy("name").collect()]
    return out


def rebuild(spark: SparkSession, segments: str, root: str) -> Refresh:
    """Both tables anew from the segments alone."""
    listed = listed_segments(spark, segments).filter("source IS NOT NULL")
    return ingest(spark, read_files(spark, [r["file"] for r in listed.select("file").collect()]), root, "overwrite")


def events(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{root}/events")
