"""Replication of segments between hosts: emit to a spool, ingest from it, status.

The spool is a folder that a file-sync tool carries: `incoming` and `processed`.
Nothing is ever overwritten: an identity that is there already must have the same
content, or it counts as failed and stays where it is.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from tidemark.sources.segments import CONFLICT_MARK, SOURCE, SegmentError, SegmentStore, file_name, publish, read_segment, same_content, verified, write_atomic


@dataclass
class Report:
    committed: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    failed: list[tuple[str, str]] = field(default_factory=list)
    cursor: int = 0

    @property
    def ok(self) -> bool:
        return not self.failed


def emit(store: SegmentStore, spool: str | Path, source: str, cursor_dir: str | Path, zone: str = "default") -> Report:
    """Publishes a source's own segments; the cursor stops before the first failure."""
    spool, out = Path(spool), Report()
    if not SOURCE.fullmatch(source):
        raise ValueError(f"not a source name: {source}")
    path = Path(cursor_dir) / zone / f"{source}.json"
    out.cursor = json.loads(path.read_text(encoding="utf-8"))["last_emitted_seq"] if path.exists() else 0
    advance = True
    for own, seq, file in store.listed()[0]:
        if own != source:
            continue
        try:
            segment = read_segment(file)
            if file.name != file_name(segment):
                raise SegmentError(f"{file.name}: the name and the content differ")
            if not verified(segment):
                raise SegmentError(f"{file.name}: checksum mismatch")
            copies = [p for p in (spool / "processed" / file.name, spool / "incoming" / file.name) if p.exists()]
            for p in copies:
                if not same_content(read_segment(p), segment):
                    raise SegmentError(f"{p} holds other content under this identity")
            new = not copies and publish(spool / "incoming" / file.name, segment)
            (out.committed if new else out.skipped).append(file.name)
        except (SegmentError, OSError) as e:
            out.failed.append((file.name, str(e)))
            advance = False
            continue
        if advance:
            out.cursor = max(out.cursor, seq)
    write_atomic(path, json.dumps({"last_emitted_seq": out.cursor}))
    return out


def _move(path: Path, to: Path, segment: dict) -> None:
    """Moves without overwriting; an identical file at the goal is as good."""
    to.parent.mkdir(parents=True, exist_ok=True)
    try:
        os.link(path, to)
    except FileExistsError:
        if not same_content(read_segment(to), segment):
            raise SegmentError(f"{to} holds other content under this identity") from None
    path.unlink()


def incoming(spool: str | Path) -> list[Path]:
    return sorted(p for p in (Path(spool) / "incoming").glob("*.json") if CONFLICT_MARK not in p.name and not p.name.startswith("."))


def ingest(spool: str | Path, store: SegmentStore) -> Report:
    """Commits each incoming segment once: absent is written, identical skipped, anything else fails and stays."""
    spool, out = Path(spool), Report()
    for path in incoming(spool):
        try:
            segment = read_segment(path)
            if not SOURCE.fullmatch(segment["source"]):
                raise SegmentError(f"not a source name: {segment['source']!r}")
            if path.name != file_name(segment):
                raise SegmentError(f"the content is {file_name(segment)}")
            if not verified(segment):
                raise SegmentError("checksum mismatch")
            try:
                store.write(segment)
                kept = out.committed
            except FileExistsError:
                held = store.read(segment["source"], segment["source_seq"])
                if not verified(held):
                    raise SegmentError("the store's copy of this identity is corrupt") from None
                if not same_content(held, segment):
                    raise SegmentError("the store has other content under this identity") from None
                kept = out.skipped
            _move(path, spool / "processed" / path.name, segment)
            kept.append(path.name)
        except (SegmentError, OSError) as e:
            out.failed.append((path.name, str(e)))
    return out


def status(spool: str | Path) -> dict[str, int | list[str]]:
    """Counts of waiting and processed segments, and sync conflicts, which need a hand."""
    spool = Path(spool)
    conflicts = sorted(p.name for d in ("incoming", "processed") for p in (spool / d).glob(f"*{CONFLICT_MARK}*"))
    return {"incoming": len(incoming(spool)), "processed": len(list((spool / "processed").glob("*.json"))), "conflicts": conflicts}
