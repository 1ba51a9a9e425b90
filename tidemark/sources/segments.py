"""The segment store: append-only JSON files, sealed by a CRC, and their events as a DataFrame.

A segment file {source}-{seq:06}.json holds source, source_seq, checksum,
created_at and events. The checksum is the CRC32 of the events' compact JSON in
field order, with payload keys sorted. Files are the truth; every table made from
them can be made again.
"""

from __future__ import annotations

import glob
import json
import os
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions import content as C
from tidemark.functions import text as X

#: The fields of events and segments in the order of their JSON.
EVENT_FIELDS = ("event_id", "zone", "source", "source_seq", "timestamp", "correlation_id", "causation_id", "actor_ref", "object_ref", "event_class", "payload_tier", "payload")
SEGMENT_FIELDS = ("source", "source_seq", "checksum", "created_at", "events")
MAX_SEQ = 2**63 - 1
CONFLICT_MARK = ".sync-conflict-"
SOURCE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}")
NAME = re.compile(r"(.*)-(\d+)\.json", re.S)


class SegmentError(Exception):
    """A segment that can't be read, verified or written."""


def _sorted(x: object) -> object:
    if isinstance(x, dict):
        return {k: _sorted(x[k]) for k in sorted(x)}
    return [_sorted(v) for v in x] if isinstance(x, list) else x


def events_bytes(events: list[dict]) -> bytes:
    rows = [{f: _sorted(e.get(f)) if f == "payload" else e.get(f) for f in EVENT_FIELDS} for e in events]
    return json.dumps(rows, separators=(",", ":"), ensure_ascii=False).encode()


def seal(source: str, seq: int, events: list[dict], created_at: str | None = None) -> dict:
    made = created_at or datetime.now(UTC).isoformat().replace("+00:00", "Z")
    return {"source": source, "source_seq": seq, "checksum": zlib.crc32(events_bytes(events)), "created_at": made, "events": events}


def verified(segment: dict) -> bool:
    return segment["checksum"] == zlib.crc32(events_bytes(segment["events"]))


def same_content(a: dict, b: dict) -> bool:
    return all(a[f] == b[f] for f in SEGMENT_FIELDS)


def file_name(segment: dict) -> str:
    return f"{segment['source']}-{segment['source_seq']:06d}.json"


def read_segment(path: str | Path) -> dict:
    try:
        segment = json.loads(Path(path).read_text(encoding="utf-8"))
        if any(f not in segment for f in SEGMENT_FIELDS):
            raise ValueError("fields are missing")
    except (OSError, ValueError) as e:
        raise SegmentError(f"{path}: {e}") from e
    return segment


def write_atomic(path: str | Path, data: str, keep_mode: bool = True) -> None:
    """Replaces path in one step; readers see the old or the new file, whole."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    made = path.with_name(f".{path.name}.{uuid.uuid4().hex}.tmp")
    try:
        with open(made, "x", encoding="utf-8") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if keep_mode and path.exists():
            os.chmod(made, path.stat().st_mode & 0o777)
        os.replace(made, path)
    finally:
        made.unlink(missing_ok=True)


def publish(path: str | Path, segment: dict) -> bool:
    """Creates path if there is none: True. An identical file there already: False. A different one raises."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    made = path.with_name(f".{path.name}.{uuid.uuid4().hex}.tmp")
    try:
        with open(made, "x", encoding="utf-8") as f:
            json.dump(segment, f, ensure_ascii=False)
            f.flush()
            os.fsync(f.fileno())
        os.link(made, path)
        return True
    except FileExistsError:
        if same_content(read_segment(path), segment):
            return False
        raise SegmentError(f"{path} holds other content under this identity") from None
    finally:
        made.unlink(missing_ok=True)


def parse_name(name: str) -> tuple[str, int] | None:
    """source and number, split at the last hyphen."""
    m = NAME.fullmatch(name)
    return (m[1], int(m[2])) if m else None


@dataclass
class Verification:
    newly_verified: int = 0
    skipped: int = 0
    failures: list[tuple[str, int, str]] = field(default_factory=list)
    missing: list[tuple[str, int]] = field(default_factory=list)


class SegmentStore:
    """One zone's segments under a folder of their own."""

    def __init__(self, root: str | Path):
        self.folder = Path(root) / "segments"

    def path(self, source: str, seq: int) -> Path:
        return self.folder / f"{source}-{seq:06d}.json"

    def listed(self, source: str | None = None) -> tuple[list[tuple[str, int, Path]], list[str]]:
        """Segments (of one source, if one is named) by source and number, and names that can't be parsed."""
        found, bad = [], []
        for p in self.folder.glob(f"{glob.escape(source)}-*.json" if source else "*.json") if self.folder.is_dir() else ():
            if CONFLICT_MARK in p.name or p.name.startswith("."):
                continue
            at = parse_name(p.name)
            if at and source in (None, at[0]):
                found.append((*at, p))
            elif not at:
                bad.append(p.name)
        return sorted(found), sorted(bad)

    def write(self, segment: dict) -> list[int]:
        """Adds a sealed, new segment; returns the numbers that are missing before it."""
        if segment["events"] and not segment["checksum"]:
            raise SegmentError("an unsealed segment")
        path = self.path(segment["source"], segment["source_seq"])
        if path.exists():
            raise FileExistsError(path)
        publish(path, segment)
        have = {n for s, n, _ in self.listed(segment["source"])[0]}
        return [n for n in range(max(have - {segment["source_seq"]}, default=0) + 1, segment["source_seq"]) if n not in have]

    def read(self, source: str, seq: int) -> dict:
        return read_segment(self.path(source, seq))

    def latest(self, source: str) -> int:
        return max((n for _, n, _ in self.listed(source)[0]), default=0)

    def gaps(self) -> list[tuple[str, int]]:
        have: dict[str, set[int]] = {}
        for s, n, _ in self.listed()[0]:
            have.setdefault(s, set()).add(n)
        return [(s, n) for s, ns in sorted(have.items()) for n in range(1, max(ns)) if n not in ns]

    def verify(self, checkpoint: str | Path | None = None, full: bool = False) -> Verification:
        """Verifies what lies above each source's mark, failed before, or was missing before; all of it if full."""
        state = {"version": 1, "verified": {}, "failures": [], "missing": []}
        if checkpoint and Path(checkpoint).exists() and not full:
            state |= json.loads(Path(checkpoint).read_text(encoding="utf-8"))
        again = {(s, n) for s, n, *_ in state["failures"]} | {(s, n) for s, n in state["missing"]}
        out, marks = Verification(missing=self.gaps()), dict(state["verified"])
        for source, seq, path in self.listed()[0]:
            if seq <= state["verified"].get(source, 0) and (source, seq) not in again:
                out.skipped += 1
                continue
            try:
                segment = read_segment(path)
                if (segment["source"], segment["source_seq"]) != (source, seq):
                    raise SegmentError("the name and the content differ")
                if not verified(segment):
                    raise SegmentError("checksum mismatch")
                out.newly_verified += 1
            except SegmentError as e:
                out.failures.append((source, seq, str(e)))
            marks[source] = max(marks.get(source, 0), seq)
        if checkpoint:
            write_atomic(checkpoint, json.dumps({"version": 1, "verified": marks, "failures": out.failures, "missing": out.missing}))
        return out


def _fault(name: str, text: str) -> str | None:
    """What keeps a segment file out of the projection."""
    try:
        segment = json.loads(text)
        if not isinstance(segment, dict) or any(f not in segment for f in SEGMENT_FIELDS):
            return "fields are missing"
        if file_name(segment) != name:
            return f"the content is {file_name(segment)}"
        if not verified(segment):
            return "checksum mismatch"
        if any(not 0 <= e["source_seq"] <= MAX_SEQ for e in (segment, *segment["events"])):
            return "a number beyond the range of a long"
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        return f"not a segment: {type(e).__name__}"
    return None


@F.pandas_udf(StringType())
def fault(names: pd.Series, texts: pd.Series) -> pd.Series:
    """Null for a sealed, well-named segment, else what is wrong with it. The seal is over canonical JSON, which no column expression gives."""
    return pd.Series([_fault(n, t) for n, t in zip(names, texts, strict=True)], dtype=object)


def listed_segments(spark: SparkSession, folder: str) -> DataFrame:
    """file, name, source, source_seq of the segment files under a folder; none is opened. A name that can't be parsed has no source."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    named = found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name")).filter(~F.col("name").contains(CONFLICT_MARK) & ~F.startswith("name", F.lit(".")))
    part = lambda n: F.nullif(F.regexp_extract("name", r"(?s)^(.*)-(\d+)\.json$", n), F.lit(""))
    return named.select("file", "name", part(1).alias("source"), part(2).try_cast("long").alias("source_seq"))


def checked_files(texts: DataFrame) -> DataFrame:
    """segment_source, segment_seq, fault, v (the segment as a variant) of files given as name and value."""
    part = lambda n: F.regexp_extract("name", r"(?s)^(.*)-(\d+)\.json$", n)
    return texts.select(part(1).alias("segment_source"), part(2).try_cast("long").alias("segment_seq"), F.coalesce(fault("name", "value"), F.when(part(2).try_cast("long").isNull(), "a number beyond the range of a long")).alias("fault"), F.try_parse_json("value").alias("v"))


def read_files(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """checked_files() of these segment files, one file a row."""
    if not files:
        return checked_files(spark.createDataFrame([], "name string, value string"))
    texts = spark.read.option("wholetext", True).text([url_path(f) for f in files])
    return checked_files(texts.select(F.col("_metadata.file_name").alias("name"), "value"))


def url_path(file: str) -> str:
    """A file's path as a glob that fits only itself."""
    return re.sub(r"([\[\]{}*?\\,])", r"\\\1", urllib.parse.unquote(file))


def events_of(checked: DataFrame) -> DataFrame:
    """The events of good segments, numbers as longs, times as timestamps, and all columns of a ledger event."""
    e = F.col("e")
    each = checked.filter("fault IS NULL").select("segment_source", "segment_seq", F.explode(C.items(C.at(F.col("v"), "$.events"))).alias("e"))
    texts_of = [C.text_at(e, f"$.{f}").alias(f) for f in EVENT_FIELDS if f not in ("source_seq", "timestamp", "payload")]
    return each.select("segment_source", "segment_seq", *texts_of, F.try_variant_get(e, "$.source_seq", "long").alias("source_seq"), X.parsed_time(C.text_at(e, "$.timestamp")).alias("timestamp"), C.compact(C.at(e, "$.payload")).alias("payload"))


def segment_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events of all good segments under a folder."""
    return events_of(read_files(spark, [r["file"] for r in listed_segments(spark, folder).select("file").collect()]))


def iter_events(store: SegmentStore) -> Iterator[dict]:
    for _, _, path in store.listed()[0]:
        yield from read_segment(path)["events"]
