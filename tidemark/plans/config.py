"""Configuration: readers, tracker, zones, timezone and registers, from TOML."""

from __future__ import annotations

import os
import re
import socket
import tomllib
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta, tzinfo
from pathlib import Path
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import SparkSession

from tidemark.sinks.tracker import CommandTracker, NoTracker, RepositoryTracker, Tracker, run_json
from tidemark.sources import transcripts as R
from tidemark.sources.archive import Archive, http_fetch
from tidemark.sources.base import Reader
from tidemark.sources.segments import SOURCE
from tidemark.sources.workers import WorkerSignals, short_host

#: Kinds of readers by what they can feed, and where each looks by default.
FEEDS = {
    "errors": ("amplifier", "context-intelligence", "pi", "nanoclaw", "worker-signals", "claude-code"),
    "errors, depending on the files": ("generic",),
    "patterns": ("amplifier", "context-intelligence", "pi", "nanoclaw"),
    "usage": ("amplifier", "context-intelligence", "pi", "nanoclaw", "agentsview"),
}
DEFAULT_PATHS = {
    "amplifier": "~/.amplifier/projects",
    "context-intelligence": "~/.amplifier/projects",
    "claude-code": "~/.claude/projects",
    "codex": "~/.codex/sessions",
    "copilot": "~/.copilot/session-state",
    "pi": "~/.pi/agent/sessions",
    "nanoclaw": "~/nanoclaw/data",
}
POOL = "~/.codex-pool"
KINDS = (*DEFAULT_PATHS, "agentsview", "worker-signals", "generic")
TRACKERS = ("none", "kata", "github")


@dataclass(frozen=True)
class Zone:
    id: str
    ledger_path: str
    spool: bool = True
    spool_path: str | None = None
    fleet_store_path: str | None = None
    index_path: str | None = None

    @property
    def index(self) -> str:
        return self.index_path or f"{self.ledger_path}/index"


@dataclass
class Config:
    readers: list[dict] = field(default_factory=list)
    tracker: dict = field(default_factory=lambda: {"type": "none"})
    zones: list[Zone] = field(default_factory=list)
    timezone: str | None = None
    workaround_registers: list[str] = field(default_factory=list)


def _home(path: str) -> str:
    return os.path.normpath(os.path.expanduser(path))


def parse(text: str) -> Config:
    doc = tomllib.loads(text)
    unknown = set(doc) - {"reader", "tracker", "zone", "timezone", "workaround_registers"}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    for r in doc.get("reader", []):
        if r.get("type") not in KINDS:
            raise ValueError(f"unknown reader type: {r.get('type')}")
        if r["type"] == "generic" and not (r.get("name") and r.get("path")):
            raise ValueError("a generic reader needs a name and a path")
    tracker = doc.get("tracker", {"type": "none"})
    if tracker.get("type") not in TRACKERS:
        raise ValueError(f"unknown tracker type: {tracker.get('type')}")
    zones = [Zone(**{k: _home(v) if k.endswith("path") and isinstance(v, str) else v for k, v in z.items()}) for z in doc.get("zone", [])]
    ids = [z.id for z in zones]
    if len(set(ids)) < len(ids) or not all(SOURCE.fullmatch(i) for i in ids):
        raise ValueError("zone ids must be distinct plain names")
    if doc.get("timezone"):
        ZoneInfo(doc["timezone"])
    return Config(doc.get("reader", []), tracker, zones, doc.get("timezone"), [_home(p) for p in doc.get("workaround_registers", [])])


def load(path: str | Path | None) -> Config:
    return parse(Path(path).read_text(encoding="utf-8")) if path else Config()


def make_reader(spark: SparkSession, r: dict, since: datetime) -> Reader:
    kind = r["type"]
    paths = r["paths"] if r.get("paths") is not None else [r.get("path") or DEFAULT_PATHS.get(kind, "")]
    roots = [_home(p) for p in paths if p]
    if kind == "claude-code":
        pool = _home("~/.claude-pool/profiles") if r.get("discover_profiles") else None
        return R.WrappedLines(spark, roots, pool, r.get("default_seat"))
    if kind == "nanoclaw":
        return R.ChatCells(spark, roots, r.get("db") and _home(r["db"]), r.get("include", ()), r.get("exclude", ()))
    if kind == "generic":
        root, pattern = split_glob(roots[0])
        return R.GenericFiles(spark, [root], pattern, "*", "stem" if r.get("session_id_from") == "file_stem" else "parent", r.get("header_key", "_session"), r["name"])
    if kind == "codex":
        # Roots that are named replace the defaults, the pool with them.
        return R.Rollouts(spark, roots, None if r.get("path") or r.get("paths") else _home(POOL + "/profiles"))
    if kind == "worker-signals":
        states = os.environ.get("TIDEMARK_DISPATCH_STATE_DIR") or _home("~/.local/state/dispatch/hooks")
        review = r.get("review_command", "roborev")
        return WorkerSignals(spark, since, run_json, _home(r.get("home", "~/.codex")), _home(r.get("pool", POOL)), _home(r.get("state_dir", states)), short_host(socket.gethostname()), review, r.get("timezone", "UTC"))
    if kind == "agentsview":
        token = Path(_home(r["token_file"])).read_text(encoding="utf-8").strip() if r.get("token_file") else None
        return Archive(spark, http_fetch(r.get("url", "http://127.0.0.1:8080"), token, r.get("timeout_secs", 30)), since, days=r.get("since_days", 7))
    made = {"amplifier": R.SessionFolders, "context-intelligence": R.IndexedEvents, "copilot": R.TypedEvents, "pi": R.BranchFiles}[kind]
    return made(spark, roots)


def make_readers(spark: SparkSession, config: Config, since: datetime) -> list[Reader]:
    return [make_reader(spark, r, since) for r in config.readers or [{"type": "amplifier"}]]


def make_tracker(config: Config, day: str) -> Tracker:
    t = config.tracker
    if t["type"] == "kata":
        return CommandTracker(day)
    return RepositoryTracker(t["repo"], day) if t["type"] == "github" else NoTracker()


def system_zone(link: str = "/etc/localtime") -> str | None:
    """The name of the zone that the system's clock is set to."""
    _, found, name = os.path.realpath(link).partition("/zoneinfo/")
    return name if found else None


def resolve_zone(override: str | None, configured: str | None, env: str | None = None, system: str | None = None) -> tzinfo:
    """The override, else the configured zone, else TZ, else the system's, else UTC.

    The first two must name a zone; the others are passed over where they don't.
    """
    for name in (override, configured):
        if name and name.strip():
            return ZoneInfo(name.strip())
    for name in (env, system):
        try:
            if name and name.strip():
                return ZoneInfo(name.strip().removeprefix(":"))
        except (ZoneInfoNotFoundError, ValueError):
            continue
    return UTC


def split_glob(path: str) -> tuple[str, str]:
    """The folder above a glob's first wildcard, and the glob as a pattern over whole paths."""
    parts = path.split("/")
    wild = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts) - 1)
    out, i = "", 0
    while i < len(path):
        if path.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif path[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif path[i] == "?":
            out, i = out + "[^/]", i + 1
        elif path[i] == "[" and "]" in path[i + 2 :]:
            end = path.index("]", i + 2)
            inside = path[i + 1 : end]
            out, i = out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(path[i]), i + 1
    return "/".join(parts[:wild]) or "/", out + "$"


def parse_since(text: str, now: datetime) -> datetime:
    """Nh, Nd, Nw before now, or a date."""
    units = {"h": "hours", "d": "days", "w": "weeks"}
    if text[-1:] in units and text[:-1].isdigit():
        return now - timedelta(**{units[text[-1]]: int(text[:-1])})
    return datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=UTC)


def check(config: Config) -> tuple[list[str], list[str]]:
    """Lines that say which reader feeds what, and warnings about what nothing feeds."""
    kinds = list(dict.fromkeys(r["type"] for r in config.readers or [{"type": "amplifier"}]))
    lines = [f"{what}: {', '.join(k for k in kinds if k in able) or 'none'}" for what, able in FEEDS.items()]
    warnings = [f"no reader feeds {what}" for what in ("errors", "patterns") if not any(k in FEEDS[what] for k in kinds)]
    return lines, warnings
