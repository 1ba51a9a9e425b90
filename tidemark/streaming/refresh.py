"""Incremental forms: segments into the projection, events into per-window counts, signals once each."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans import projection
from tidemark.sources.segments import CONFLICT_MARK, checked_files

logger = logging.getLogger(__name__)


def refresh_stream(spark: SparkSession, folder: str, root: str, checkpoint: str) -> StreamingQuery:
    """New segment files into the projection, each batch once; a replayed batch adds nothing.

    A bad segment is logged and left to projection.refresh(), which offers it again after its repair.
    """
    texts = spark.readStream.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder).select("value", F.col("_metadata.file_name").alias("name")).filter(~F.col("name").contains(CONFLICT_MARK))

    def add(df: DataFrame, _: int) -> None:
        for source, seq, why in projection.ingest(df.sparkSession, checked_files(df), root).failed:
            logger.warning("segment %s-%s: %s", source, seq, why)

    return texts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def storm_counts(events: DataFrame, kind: str, span: str, slide: str, late: str = "1 hour") -> DataFrame:
    """Counts of one kind by session in sliding windows: an early notice of storms.

    The exact densest window is a batch operator; sliding windows see it to within one slide.
    """
    return events.filter(F.col("kind") == kind).withWatermark("ts", late).groupBy(F.window("ts", span, slide), "session_id").agg(F.count("*").alias("n"))


def once(signals: DataFrame, ts: str = "modified", keep: str = "90 days") -> DataFrame:
    """Each signal id once within the ledger's retention."""
    return signals.withWatermark(ts, keep).dropDuplicatesWithinWatermark(["id"])
