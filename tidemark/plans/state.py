"""State that runs leave for the next: processed sessions, pending ones, the signal ledger.

Each is a small sorted text file beside the processed file, replaced in one step.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import signals
from tidemark.sources.segments import write_atomic

#: How far back pending sessions reach, and how long the ledger remembers.
LOOKBACK, RETENTION = timedelta(days=14), timedelta(days=signals.RETENTION_DAYS)
LEDGER = "id string, first_seen date, counted boolean, filed boolean, session_modified timestamp"


def load_processed(path: Path) -> set[str]:
    return {x.strip() for x in path.read_text(encoding="utf-8").splitlines() if x.strip()} if path.exists() else set()


def save_processed(path: Path, ids: set[str]) -> None:
    write_atomic(path, "".join(f"{x}\n" for x in sorted(ids)))


def parse_time(text: str) -> datetime | None:
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        return None
    return at if at.tzinfo else None


def shown_time(at: datetime) -> str:
    return (at if at.tzinfo else at.replace(tzinfo=UTC)).astimezone(UTC).isoformat().replace("+00:00", "Z")


def load_pending(path: Path, now: datetime) -> dict[str, datetime]:
    """Session ids with the time of their file; an unreadable time counts as just inside the lookback."""
    out: dict[str, datetime] = {}
    for line in path.read_text(encoding="utf-8").splitlines() if path.exists() else ():
        at, tab, sid = line.strip().partition("\t")
        if tab:
            out[sid] = parse_time(at) or now - LOOKBACK + timedelta(minutes=5)
    return out


def save_pending(path: Path, entries: Mapping[str, datetime]) -> None:
    write_atomic(path, "".join(sorted(f"{shown_time(at)}\t{sid}\n" for sid, at in entries.items())))


def widened(since: datetime, pending: list[datetime]) -> datetime:
    """The start of discovery: before the oldest pending session, but no further back than the lookback."""
    return max(min(since, min(pending) - timedelta(seconds=1)), since - LOOKBACK) if pending else since


@dataclass
class Entry:
    first_seen: date
    counted: bool = False
    filed: bool = False
    modified: datetime | None = None


class Ledger:
    """Which signals were counted and filed before, by identity."""

    def __init__(self, entries: dict[str, Entry] | None = None):
        self.entries = entries or {}

    @classmethod
    def load(cls, path: Path) -> Ledger:
        out: dict[str, Entry] = {}
        for line in path.read_text(encoding="utf-8").splitlines() if path.exists() else ():
            parts = line.split("\t", 3)
            try:
                day = date.fromisoformat(parts[0])
            except ValueError:
                continue
            if len(parts) == 4 and (parts[2] == "-" or parse_time(parts[2])):
                out[parts[3]] = Entry(day, "c" in parts[1], "f" in parts[1], parse_time(parts[2]))
            elif len(parts) == 3:  # an older form, without the session's time
                out[parts[2]] = Entry(day, "c" in parts[1], "f" in parts[1])
        return cls(out)

    def mark(self, sid: str, day: date, modified: datetime | None, counted: bool = False, filed: bool = False) -> None:
        e = self.entries.setdefault(sid, Entry(day))
        e.first_seen = min(e.first_seen, day)
        e.counted, e.filed = e.counted or counted, e.filed or filed
        self.note(sid, modified)

    def note(self, sid: str, modified: datetime | None) -> None:
        e = self.entries.get(sid)
        if e and modified and (e.modified is None or modified > e.modified):
            e.modified = modified

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(sid, e.first_seen, e.counted, e.filed, e.modified) for sid, e in self.entries.items()], LEDGER)

    def save(self, spark: SparkSession, path: Path, day: date) -> None:
        """The entries within the retention; the file is small, as one line stands for one signal of its days."""
        own = self.table(spark)
        kept = signals.merged_ledger(own, own.limit(0), F.lit(day), RETENTION.days).collect()
        line = lambda r: f"{r['first_seen']}\t{'c' * r['counted']}{'f' * r['filed']}\t{shown_time(r['session_modified']) if r['session_modified'] else '-'}\t{r['id']}\n"
        write_atomic(path, "".join(sorted(map(line, kept))))
