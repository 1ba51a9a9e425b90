"""Health patterns of a session's event series.

Events are (session_id, seq, kind, ts, tool_name, detail) with kind one of
compaction, resume, tool_call, llm_response, user_message. Storms go by time;
loops and stretches go by the order of the file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import windows


@dataclass(frozen=True)
class Limits:
    """Thresholds of each pattern."""

    compactions: int = 3
    compaction_span: str = "10 MINUTES"
    resumes: int = 3
    resume_span: str = "30 MINUTES"
    loop: int = 4
    runaway: int = 150


def _pattern(df: DataFrame, order: int, kind: str, description: Column, evidence: Column, at: Column | None = None) -> DataFrame:
    place = F.lit(0) if at is None else at
    return df.select("session_id", F.lit(order).alias("kind_order"), place.cast("long").alias("at"), F.lit(kind).alias("pattern_kind"), description.alias("description"), evidence.alias("evidence"))


def _said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _storms(events: DataFrame, order: int, kind: str, span: str, least: int) -> DataFrame:
    found = windows.densest_window(events.filter(F.col("kind") == kind), "session_id", "ts", span, least)
    n, when = F.col("n"), X.minute_range(F.col("start"), F.col("stop"))
    return _pattern(found, order, f"{kind}_storm", _said(f"{kind} storm: ", n, f" {kind}s within {span.split()[0]} minutes"), _said(n, f" {kind}s ", when))


def compaction_storms(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return _storms(events, 1, "compaction", limits.compaction_span, limits.compactions)


def stuck_loops(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    found = windows.islands(events.filter("kind = 'tool_call'"), "session_id", ["seq"], ["tool_name", "detail"], "ts", limits.loop)
    tool, n = F.coalesce("tool_name", F.lit("unknown")), F.col("n")
    when = X.minute_range(F.col("start"), F.col("stop"))
    return _pattern(found, 2, "stuck_loop", _said("stuck loop: `", tool, "` called ", n, " times with identical arguments"), _said("`", tool, "` x", n, " identical arguments ", when), F.col("at"))


def resume_storms(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return _storms(events, 3, "resume", limits.resume_span, limits.resumes)


def runaways(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The longest stretch of tool calls without a user message; sub-agents are exempt."""
    own = events.filter(~X.is_sub_agent(F.col("session_id")))
    found = windows.longest_stretch(own, "session_id", ["seq"], F.col("kind") == "user_message", F.col("kind") == "tool_call", "ts", limits.runaway)
    n, when = F.col("n"), X.minute_range(F.col("start"), F.col("stop"))
    return _pattern(found, 4, "iteration_runaway", _said("iteration runaway: ", n, " tool calls with no intervening user message"), _said(n, " tool calls without a user message ", when))


def health_patterns(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All patterns in order: compactions, loops, resumes, runaways."""
    return compaction_storms(events, limits).unionByName(stuck_loops(events, limits)).unionByName(resume_storms(events, limits)).unionByName(runaways(events, limits))
