"""The nightly review: sessions to signals to a digest, each signal counted and filed once.

From sessions to signals all is one lazy plan. What reaches the driver are the
rows of the report: new signals, alerts, rollups, and the ids of scanned sessions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, date, datetime
from decimal import Decimal
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import detectors, health, rollup, signals, windows
from tidemark.plans import state
from tidemark.sinks import digest
from tidemark.sinks.tracker import Issue, NoTracker, Tracker
from tidemark.sources.archive import week_before
from tidemark.sources.base import EVENTS, MESSAGES, MODEL_COSTS, SESSIONS, USAGE, Reader, fitted
from tidemark.sources.registers import Check


@dataclass
class Args:
    since: datetime
    day: date
    digest_dir: Path
    processed: Path | None = None
    dry_run: bool = False
    create_issues: bool = False
    archive: digest.ArchiveSpend | None = None
    register: Check | None = None
    limits: health.Limits = health.Limits()


@dataclass
class Scan:
    """The tables of one run, before any state is touched."""

    held: list[DataFrame]
    sessions: DataFrame
    signals: DataFrame
    alerts: DataFrame
    stats: DataFrame
    model_costs: DataFrame


def _union(parts: Sequence[DataFrame], schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [fitted(p, schema) for p in parts])


def scan(spark: SparkSession, readers: Sequence[Reader], since: datetime, pending: set[str], processed: set[str], effective: datetime, limits: health.Limits = health.Limits()) -> Scan:
    """Sessions to review and everything found in them.

    A session is in if it was modified since the cutoff or is pending, and no run
    has processed it or its key. Where readers share a key, the first one with
    anything to show has it.
    """
    listed = [r.sessions().withColumn("reader_rank", F.lit(i)) for i, r in enumerate(readers)]
    found = reduce(DataFrame.unionByName, [fitted(p, f"{SESSIONS}, reader_rank int") for p in listed])
    ids = lambda xs: spark.createDataFrame([(x,) for x in sorted(xs)], "id string")
    wanted = ids(pending).withColumn("pending", F.lit(True))
    open_ = found.join(wanted, F.col("session_id") == F.col("id"), "left").filter((F.col("modified") >= since) | ((F.col("modified") >= effective) & F.col("pending"))).drop("id", "pending")
    done = ids(processed)
    fresh = open_.join(done, F.col("session_id") == F.col("id"), "left_anti").join(done, F.col("dedupe_key") == F.col("id"), "left_anti")
    fresh = fresh.persist()
    # The ids and paths of the window reach the driver anyway; with them, only their folders are read.
    paths = [(r["reader_rank"], r["path"]) for r in fresh.select("reader_rank", "path").collect()]
    for i, r in enumerate(readers):
        r.only([p for rank, p in paths if rank == i])
    messages = _union([r.messages() for r in readers], MESSAGES)
    events = _union([r.events() for r in readers], EVENTS)
    usage = _union([r.usage() for r in readers], USAGE)
    split = _union([r.model_costs() for r in readers], MODEL_COSTS)
    shown = messages.select("path").union(events.select("path")).union(usage.select("path")).distinct()
    sessions = windows.first_rows(windows.first_rows(fresh.join(shown, "path", "left_semi"), ["dedupe_key"], ["reader_rank", "path"]), ["session_id"], ["reader_rank", "path"]).persist()

    own = sessions.select("path", "session_id")
    # Five detectors read the messages and four the events: each is made once.
    m, e, u = (x.join(own, "path").persist() for x in (messages, events, usage))
    every = signals.all_signals(detectors.corrections(m), detectors.errors(m), detectors.workarounds(m), detectors.deferrals(m), health.health_patterns(e, limits))
    dims = sessions.select("session_id", "seat", "agent", "machine", "persona", F.when(F.col("persona").isNotNull(), F.col("channel")).alias("channel"), "modified", "reader_rank", "path")
    stamped = every.join(dims, "session_id").withColumn("title", signals.title()).withColumn("scan_ord", F.struct("reader_rank", "path")).persist()
    role = F.when(F.col("reader") != "pi", F.nullif(F.regexp_extract("session_id", r"(?s)^[^_]*_(.+)$", 1), F.lit("")))
    sums = rollup.usage_sums(u).join(sessions.select("session_id", role.alias("role")), "session_id")
    costs = u.filter("model IS NOT NULL AND cost IS NOT NULL").select("session_id", "model", "cost").union(split.filter("cost IS NOT NULL").join(own, "path").select("session_id", "model", "cost"))
    return Scan([fresh, sessions, stamped, m, e, u], sessions, stamped, detectors.priority_alerts(stamped.filter("kind = 'error'")), sums, costs)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def _plain(x: Decimal | None) -> Decimal | None:
    """A decimal without the zeros that only its column's scale gave it."""
    if x is None:
        return None
    n = x.normalize()
    return n.quantize(Decimal(1)) if n.as_tuple().exponent > 0 else n


def _spend(s: Scan) -> digest.Spend | None:
    sums = _rows(rollup.spend(s.stats))
    total = next((r for r in sums if r["role"] is None), None)
    if not total or not total["sessions"]:
        return None
    roles = {r["role"]: _plain(r["cost"]) for r in sums if r["role"] is not None and r["cost"] is not None}
    models = {r["model"]: _plain(r["cost"]) for r in _rows(rollup.spend_by_model(s.model_costs))}
    return digest.Spend(_plain(total["cost"]), total["sessions"], total["sessions_with_cost"], total["input_tokens"], total["output_tokens"], roles, models)


def archive_spend(daily: DataFrame, day: date, zone: str) -> digest.ArchiveSpend | None:
    """The week before a day and its last day, of daily_usage(); None where the week has no row."""
    low, high = week_before(day)

    def period(first: date) -> digest.Period | None:
        rows = rollup.archive_period(daily, F.lit(first), F.lit(high)).collect()  # one row for each agent and model
        total = next((r for r in rows if r["dim"] == "total"), None)
        of = lambda dim: {r["name"]: _plain(r["cost"]) for r in rows if r["dim"] == dim}
        return digest.Period(_plain(total["cost"]), total["days"], of("agent"), of("model")) if total else None

    week = period(low)
    return digest.ArchiveSpend(low, high, zone, week, period(high)) if week else None


def _personas(s: Scan) -> dict[str, dict]:
    rows = rollup.with_display_key(rollup.personas(s.sessions, s.signals, s.stats))
    return {r["key"]: r | {"cost": _plain(r["cost"])} for r in _rows(rows)}


def _utc(at: datetime) -> datetime:
    return at.astimezone(UTC) if at.tzinfo else at.replace(tzinfo=UTC)


def _sums(counted: DataFrame) -> dict[str, int]:
    row = counted.first().asDict()
    return {f"{k}s": row[f"{k}s"] for k in signals.KINDS}


def _counts(kinds: Counter | list[str]) -> dict[str, int]:
    c = Counter(kinds)
    return {f"{k}s": c[k] for k in signals.KINDS}


def review(spark: SparkSession, readers: Sequence[Reader], args: Args, tracker: Tracker | None = None, now: datetime | None = None) -> digest.Report:
    """One run. State is committed in an order that makes a run that dies repeat work, never lose it:
    retries, renders, ledger (filed), digest, ledger (counted), renders, processed."""
    now, tracker = now or datetime.now(UTC), tracker or NoTracker()
    base = args.processed
    beside = lambda suffix: base.with_name(base.name + suffix)
    processed = state.load_processed(base) if base else set()
    retry = state.load_pending(beside(".retry"), now) if base else {}
    render = state.load_pending(beside(".render"), now) if base else {}
    ledger = state.Ledger.load(beside(".signals")) if base else None
    pending = set(retry) | set(render)
    found = scan(spark, readers, args.since, pending, processed, state.widened(args.since, [*retry.values(), *render.values()]), args.limits)

    scanned = {r["session_id"]: r for r in _rows(found.sessions.select("session_id", "dedupe_key", "modified"))}
    modified = {sid: _utc(r["modified"]) for sid, r in scanned.items()}
    report = digest.Report(str(args.day), sessions_scanned=len(scanned), archive=args.archive, register=args.register)
    known = ledger.table(spark) if ledger is not None else spark.createDataFrame([], state.LEDGER)
    every = signals.split_by_ledger(signals.with_identity(found.signals), known).persist()
    # What earlier runs counted and filed stays on the executors, but for the times that the ledger takes note of.
    rows = _rows(every.filter("is_new OR to_offer").orderBy("kind_ord", "scan_ord", "seq", "block").drop("scan_ord"))
    new, offered = [r for r in rows if r["is_new"]], [r for r in rows if r["to_offer"]]
    if ledger is not None:
        again = every.join(known.select("id", "session_modified"), "id").filter("session_modified IS NULL OR modified > session_modified").groupBy("id").agg(F.max("modified").alias("modified"))
        for r in again.collect():  # at most one row for each entry of the ledger
            ledger.note(r["id"], _utc(r["modified"]))
        report.detected = _sums(signals.kind_counts(every))
        old = _sums(signals.counted_in_window(ledger.table(spark), F.lit(args.since)))
        recent = _counts([r["kind"] for r in new if modified[r["session_id"]] >= args.since])
        report.in_window = {k: n + recent[k] for k, n in old.items()}
    for k in signals.KINDS:
        setattr(report, f"{k}s", [r for r in new if r["kind"] == k])
    report.alerts = {r["tool_name"]: r["sessions"] for r in _rows(found.alerts)}
    report.spend, report.personas = _spend(found), _personas(found)

    if not args.dry_run and report.spend:
        titles = [(i.title,) for i in tracker.list_open()]
        if titles:
            new_ids = spark.createDataFrame([(r["kind"], r["title"], r["session_id"]) for r in new], "kind string, title string, session_id string")
            again = rollup.recurrence_costs(new_ids, spark.createDataFrame(titles, "title string"), found.stats)
            report.recurrence = {r["title"]: digest.dollars(_plain(r["cost"])) for r in _rows(again)}

    failed: set[str] = set()
    filed: list[dict] = []
    issues: dict[str, Issue] = {}
    if args.create_issues and not args.dry_run:
        for r in offered:
            try:
                issue = tracker.create(r["kind"], r)
            except Exception:  # one signal that can't be filed must not lose the rest; its session is tried again
                failed.add(r["session_id"])
                report.tracker_failures += 1
                continue
            filed.append(r)
            issues[r["title"]] = issue
    report.issues = issues

    path = digest.digest_path(args.digest_dir, str(args.day))
    only_pending = bool(scanned) and set(scanned) <= pending
    write = not args.dry_run and not (path.exists() and (not scanned or only_pending))
    report.path = str(path) if write or path.exists() else None
    unresolved: set[str] = set()
    waiting: dict[str, datetime] = {}
    floor = args.since - state.LOOKBACK
    new_sessions = {r["session_id"] for r in new} if ledger is not None else set()
    if not args.dry_run and base:
        kept = {}
        for sid, at in retry.items():
            if at < floor or (sid in scanned and args.create_issues and sid not in failed):
                continue
            kept[sid] = at
            if sid in scanned:
                unresolved.add(sid)
        state.save_pending(beside(".retry"), kept | {sid: modified[sid] for sid in failed})
        waiting = {sid: at for sid, at in render.items() if at >= floor and sid not in scanned} | {sid: modified[sid] for sid in new_sessions}
        state.save_pending(beside(".render"), waiting)
        for r in filed:
            ledger.mark(r["id"], args.day, modified[r["session_id"]], filed=True)
        ledger.save(spark, beside(".signals"), args.day)
    if write:
        digest.write(args.digest_dir, report)
        if base:
            for r in new:
                ledger.mark(r["id"], args.day, modified[r["session_id"]], counted=True)
            ledger.save(spark, beside(".signals"), args.day)
            waiting = {sid: at for sid, at in waiting.items() if sid not in new_sessions}
            state.save_pending(beside(".render"), waiting)
    elif not args.dry_run and path.exists() and args.register:
        old = path.read_text(encoding="utf-8")
        if (made := digest.refresh_register(old, args.register)) != old:
            digest.write_atomic(path, made)
    if not args.dry_run and base:
        back = failed | unresolved | set(waiting)
        done = processed | set(scanned) | {r["dedupe_key"] for r in scanned.values()}
        done -= back | {scanned[s]["dedupe_key"] for s in back if s in scanned}
        state.save_processed(base, done)
    for df in [every, *found.held]:
        df.unpersist()
    return report
