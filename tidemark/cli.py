"""Command line: review nightly, query, spool emit/ingest/status, config check, rebuild."""

from __future__ import annotations

import argparse
import json
import os
import socket
import sys
from datetime import UTC, date, datetime, timedelta
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ledger
from tidemark.plans import config as cfg
from tidemark.plans import nightly, projection
from tidemark.sinks import digest, spool
from tidemark.sources import archive, registers
from tidemark.sources.segments import SegmentStore


def session() -> SparkSession:
    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _archive_spend(spark: SparkSession, c: cfg.Config, day: date, zone: str) -> digest.ArchiveSpend | None:
    """Spend by the archive's own count, where an archive is configured; any failure only hides it."""
    reader = next((r for r in c.readers if r["type"] == "agentsview"), None)
    if reader is None:
        return None
    try:
        found = archive.fetch_daily(*archive.week_before(day), zone, reader.get("bin", "agentsview"), reader.get("timeout_secs", archive.TIMEOUT_S))
        return nightly.archive_spend(archive.daily_usage(spark, found), day, zone)
    except Exception as e:  # advisory: the review goes on without it
        print(f"archive spend: {e}", file=sys.stderr)
        return None


def _bad_segments(found: projection.Refresh) -> list[str]:
    return [f"{source}-{seq}: {why}" for source, seq, why in found.failed] + [f"{name}: not a segment's name" for name in found.unnamed]


def _review(a: argparse.Namespace, c: cfg.Config) -> int:
    now = datetime.now(UTC)
    since = cfg.parse_since(a.since, now) if a.since else now - timedelta(days=a.days)
    zone = cfg.resolve_zone(os.environ.get("TIDEMARK_TZ"), c.timezone, os.environ.get("TZ"), cfg.system_zone())
    day = datetime.strptime(a.date, "%Y-%m-%d").date() if a.date else now.astimezone(zone).date()
    check = registers.check(c.workaround_registers, day) if c.workaround_registers else None
    spark = session()
    args = nightly.Args(since, day, Path(a.digest_dir).expanduser(), a.processed_file and Path(a.processed_file).expanduser(), a.dry_run, a.create_issues, _archive_spend(spark, c, day, str(zone)), check)
    report = nightly.review(spark, cfg.make_readers(spark, c, since), args, cfg.make_tracker(c, str(day)), now)
    print(digest.report_json(report, a.dry_run) if a.json else digest.summary(report))
    if check and not a.json:
        print(digest.register_summary(check))
    return 0


def query_events(spark: SparkSession, c: cfg.Config, since: str, subsystems: list[str], event_class: str | None, zone: str | None, ledger_path: str | None, limit: int, now: datetime) -> tuple[list[tuple[str, dict]], list[str]]:
    """(zone, event) rows and the zones that failed."""
    if zone and ledger_path:
        raise ValueError("a zone or a ledger path, not both")
    targets = [("ledger", ledger_path, f"{ledger_path}/index")] if ledger_path else [(z.id, z.fleet_store_path or z.ledger_path, z.index) for z in c.zones if zone in (None, z.id)]
    if zone and not targets:
        raise ValueError(f"no zone {zone}")
    if event_class and ledger.CLASSES and event_class.lower().replace("-", "").replace("_", "") not in {x.replace("_", "") for x in ledger.CLASSES}:
        raise ValueError(f"unknown class: {event_class}")
    found, failed = [], []
    for name, root, index in targets:
        try:
            if Path(root, "segments").is_dir():
                for line in _bad_segments(projection.refresh(spark, f"{root}/segments", index)):
                    print(f"{name}: {line}", file=sys.stderr)
            elif not Path(index).exists():
                continue
            rows = ledger.query(projection.events(spark, index), limit, F.lit(cfg.parse_since(since, now)), event_class, subsystems)
            found += [(name, r.asDict()) for r in rows.collect()]
        except Exception as e:  # one zone must not hide the others; the exit code tells
            failed.append(f"{name}: {e}")
    return found, failed


def _query(a: argparse.Namespace, c: cfg.Config) -> int:
    found, failed = query_events(session(), c, a.since, a.subsystem, a.event_class, a.zone, a.ledger_path, a.limit, datetime.now(UTC))
    if a.format == "json":
        print(json.dumps([{"zone": z, "event": e | {"payload": e["payload"] and json.loads(e["payload"])}} for z, e in found], indent=2, default=str, ensure_ascii=False))
    elif not found:
        print(f"No events found since {a.since}." if not a.subsystem else f"No events found since {a.since} matching {a.subsystem}.")
    else:
        print(f"Found {len(found)} event(s) since {a.since}\n")
        for z in dict.fromkeys(z for z, _ in found):
            rows = [e for name, e in found if name == z]
            print(f"Zone: {z} ({len(rows)} events)")
            for e in rows:
                p = json.loads(e["payload"]) if e["payload"] else {}
                p = p if isinstance(p, dict) else {}
                name = p.get("subsystem") or (e["object_ref"] or "").removeprefix("subsystem:") or "?"
                print(f"  [{e['timestamp']:%Y-%m-%d %H:%M:%S}] {e['event_class'].replace('_', ''):14} {name:30} {p.get('summary', '')}")
            print()
    for f in failed:
        print(f, file=sys.stderr)
    return int(bool(failed))


def _spool(a: argparse.Namespace, c: cfg.Config) -> int:
    bad = False
    for z in c.zones:
        if not z.spool or not z.spool_path or a.zone not in (None, z.id):
            continue
        if a.action == "status":
            s = spool.status(z.spool_path)
            print(f"spool status [{z.id}]: incoming={s['incoming']} processed={s['processed']} conflicts={len(s['conflicts'])}")
            bad |= bool(s["conflicts"])
            continue
        if a.action == "emit":
            r = spool.emit(SegmentStore(z.ledger_path), z.spool_path, a.source or socket.gethostname().split(".")[0], Path(a.cursor_dir).expanduser(), z.id)
            print(f"spool emit [{z.id}]: emitted={len(r.committed)} skipped={len(r.skipped)} cursor={r.cursor}")
        else:
            root = z.fleet_store_path or z.ledger_path
            r = spool.ingest(z.spool_path, SegmentStore(root))
            print(f"spool ingest [{z.id}]: committed={len(r.committed)} skipped={len(r.skipped)} failed={len(r.failed)}")
            # A fleet store is carried by a file sync; its index lives with the zone that mirrors it here, if one does.
            mirror = next((m for m in c.zones if not m.spool and m.ledger_path == root), None if z.fleet_store_path else z)
            if r.committed and mirror:
                for line in _bad_segments(projection.refresh(session(), f"{root}/segments", mirror.index)):
                    print(line, file=sys.stderr)
                    bad = True
        for name, why in r.failed:
            print(f"{name}: {why}", file=sys.stderr)
        bad |= not r.ok
    return int(bad)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("review").add_subparsers(dest="what", required=True).add_parser("nightly")
    r.add_argument("--days", type=int, default=1)
    r.add_argument("--since")
    r.add_argument("--json", action="store_true")
    r.add_argument("--digest-dir", default="~/.tidemark/digests")
    r.add_argument("--dry-run", action="store_true")
    r.add_argument("--create-issues", action="store_true")
    r.add_argument("--date")
    r.add_argument("--processed-file")
    q = sub.add_parser("query")
    q.add_argument("--since", default="7d")
    q.add_argument("--subsystem", action="append", default=[])
    q.add_argument("--class", dest="event_class")
    q.add_argument("--zone")
    q.add_argument("--ledger-path")
    q.add_argument("--limit", type=int, default=100)
    q.add_argument("--format", choices=("text", "json"), default="text")
    s = sub.add_parser("spool")
    s.add_argument("action", choices=("emit", "ingest", "status"))
    s.add_argument("--zone")
    s.add_argument("--source")
    s.add_argument("--cursor-dir", default="~/.tidemark/cursors")
    sub.add_parser("config").add_argument("what", choices=("check",))
    b = sub.add_parser("rebuild")
    b.add_argument("--ledger-path", required=True)
    a = p.parse_args(argv)
    c = cfg.load(a.config)
    if a.command == "review":
        return _review(a, c)
    if a.command == "query":
        return _query(a, c)
    if a.command == "spool":
        return _spool(a, c)
    if a.command == "rebuild":
        found = projection.rebuild(session(), f"{a.ledger_path}/segments", f"{a.ledger_path}/index")
        print(f"rebuilt: segments={found.segments} events={found.events}")
        for line in _bad_segments(found):
            print(line, file=sys.stderr)
        return int(bool(found.failed))
    lines, warnings = cfg.check(c)
    print("\n".join(lines + [f"warning: {w}" for w in warnings]))
    return int(bool(warnings))


if __name__ == "__main__":
    sys.exit(main())
