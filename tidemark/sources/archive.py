"""Sessions of a REST archive: paged listings, messages and usage, fetched on the driver.

Pages are bounded (500 rows, 40 pages), so what reaches the driver is too. The
fetch function is a parameter; tests and replays give saved pages.
"""

from __future__ import annotations

import ipaddress
import json
import subprocess
import urllib.parse
import urllib.request
from collections.abc import Callable, Sequence
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.sources import base
from tidemark.sources.base import Reader, fitted

#: Limits and defaults of the archive.
PAGE_ROWS, MAX_PAGES, TIMEOUT_S, DEFAULT_DAYS = 500, 40, 30, 7
USAGE_SCHEMA_VERSION = 6


def encoded(x: str) -> str:
    return urllib.parse.quote(x, safe="-._~")


def checked_url(url: str) -> str:
    """A plain http origin whose host is an IP literal; anything else is refused."""
    parts = urllib.parse.urlsplit(url)
    if parts.scheme != "http" or parts.username or parts.password or parts.query or parts.fragment or parts.path not in ("", "/"):
        raise ValueError(f"not an http origin: {url}")
    ipaddress.ip_address(parts.hostname or "")
    return url.rstrip("/")


def http_fetch(url: str, token: str | None = None, timeout: int = TIMEOUT_S) -> Callable[[str], dict | None]:
    origin = checked_url(url)

    def fetch(path: str) -> dict | None:
        request = urllib.request.Request(origin + path, headers={"Authorization": f"Bearer {token}"} if token else {})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            raise

    return fetch


class Archive(Reader):
    name = "agentsview"

    def __init__(self, spark: SparkSession, fetch: Callable[[str], dict | None], since: datetime, now: datetime | None = None, days: int = DEFAULT_DAYS):
        super().__init__(spark, [])
        self.fetch, self.now = fetch, now or datetime.now(UTC)
        self.cutoff = max(since, self.now - timedelta(days=days))
        self._sessions: list[dict] | None = None

    def _ended(self, s: dict) -> datetime:
        return datetime.fromisoformat(s["ended_at"]) if s.get("ended_at") else self.now

    def _open(self) -> list[dict]:
        """The sessions of the window, listed once."""
        if self._sessions is None:
            self._sessions = [s for s in self._all() if self._ended(s) >= self.cutoff]
        if self.chosen is None:
            return self._sessions
        return [s for s in self._sessions if f"archive:{s['id']}" in self.chosen]

    def only(self, paths: Sequence[str]) -> None:
        self.chosen = list(paths)

    def _all(self) -> list[dict]:
        out: list[dict] = []
        cursor = None
        for _ in range(MAX_PAGES):
            page = self.fetch(f"/sessions?limit={PAGE_ROWS}" + (f"&cursor={encoded(cursor)}" if cursor else "")) or {}
            if not isinstance(page.get("sessions"), list):
                raise ValueError("an archive page without sessions")
            out += page["sessions"]
            cursor = page.get("next_cursor")
            if not cursor:
                return out
        raise ValueError("the archive lists more sessions than its page limit allows")

    def sessions(self) -> DataFrame:
        labels = (self.fetch("/machines") or {}).get("machine_labels") or {}
        rows = [(s["id"], f"archive:{s['id']}", self._ended(s), s.get("agent"), labels.get(s.get("machine"), s.get("machine"))) for s in self._open()]
        found = self.spark.createDataFrame(rows, "session_id string, path string, modified timestamp, agent string, machine string")
        return fitted(found.withColumns({"reader": F.lit(self.name), "dedupe_key": X.without_agent(F.col("session_id"))}), base.SESSIONS)

    def _all_messages(self, session_id: str) -> list[dict]:
        out: list[dict] = []
        start = 0
        for _ in range(MAX_PAGES):
            page = self.fetch(f"/sessions/{encoded(session_id)}/messages?limit={PAGE_ROWS}&from={start}") or {}
            if not isinstance(page.get("messages"), list):
                raise ValueError("an archive page without messages")
            out += page["messages"]
            if len(page["messages"]) < PAGE_ROWS:
                return out
            after = page.get("last_ordinal", -1) + 1
            if after <= start:
                raise ValueError("an archive page that does not advance")
            start = after
        raise ValueError(f"session {session_id} has more messages than the page limit allows")

    def messages(self) -> DataFrame:
        rows = [(f"archive:{s['id']}", n, m.get("role"), m.get("content")) for s in self._open() for n, m in enumerate(self._all_messages(s["id"]))]
        found = self.spark.createDataFrame(rows, "path string, seq long, role string, said string").filter("role IN ('user', 'assistant')")
        return fitted(found.withColumn("content", F.col("said").cast("variant")), base.MESSAGES)

    def _priced(self) -> list[tuple[str, dict]]:
        found = [(f"archive:{s['id']}", self.fetch(f"/sessions/{encoded(s['id'])}/usage")) for s in self._open()]
        return [(path, u) for path, u in found if u and (u.get("has_token_data") or u.get("has_cost"))]

    def usage(self) -> DataFrame:
        """One row a session, with its whole cost; model_costs() splits the same cost by model."""
        rows = []
        for path, u in self._priced():
            tokens = sum(b.get("input_tokens") or 0 for b in u.get("breakdown") or [])
            rows.append((path, 0, (u.get("cost") or {}).get("microdollars") if u.get("has_cost") else None, tokens, u.get("total_output_tokens") or 0))
        found = self.spark.createDataFrame(rows, "path string, seq long, micro long, input_tokens long, output_tokens long")
        return fitted(found.withColumn("cost", X.micro_dollars(F.col("micro"))), base.USAGE)

    def model_costs(self) -> DataFrame:
        rows = [(path, b.get("model"), (b.get("cost") or {}).get("microdollars")) for path, u in self._priced() for b in u.get("breakdown") or [] if b.get("has_cost")]
        found = self.spark.createDataFrame(rows, "path string, model string, micro long")
        return fitted(found.withColumn("cost", X.micro_dollars(F.col("micro"))), base.MODEL_COSTS)


def daily_usage(spark: SparkSession, document: dict) -> DataFrame:
    """date, dim (total, agent, model), name and cost of a daily usage report; strict in its schema."""
    if document.get("schema_version") != USAGE_SCHEMA_VERSION:
        raise ValueError(f"daily usage must have schema version {USAGE_SCHEMA_VERSION}")
    rows = []
    for day in document["daily"]:
        micro = day["totalCost"]["microdollars"]
        listed = [("total", "all", micro)] + [("agent", a["agent"], a["cost"]["microdollars"]) for a in day["agentBreakdowns"]] + [("model", m["modelName"], m["cost"]["microdollars"]) for m in day["modelBreakdowns"]]
        for dim, name, cost in listed:
            if not isinstance(cost, int) or isinstance(cost, bool):
                raise ValueError("a cost that is no whole number of microdollars")
            rows.append((datetime.strptime(day["date"], "%Y-%m-%d").date(), dim, name, cost))
    found = spark.createDataFrame(rows, "date date, dim string, name string, micro long")
    return found.groupBy("date", "dim", "name").agg(F.sum(X.micro_dollars(F.col("micro"))).alias("cost"))


def week_before(day: date) -> tuple[date, date]:
    """The seven days that end with the day before."""
    return day - timedelta(days=7), day - timedelta(days=1)


def fetch_daily(low: date, high: date, zone: str, command: str = "agentsview", timeout: int = TIMEOUT_S, run: Callable[..., subprocess.CompletedProcess] = subprocess.run) -> dict:
    """The daily usage report of the archive's command line, days as of the zone."""
    args = [command, "usage", "daily", "--json", "--breakdown", "--since", str(low), "--until", str(high), "--timezone", zone, "--no-sync"]
    done = run(args, capture_output=True, text=True, timeout=timeout)
    if done.returncode:
        said = [x.strip() for x in done.stderr.splitlines() if x.strip()]
        told = [x for x in said if x.lower().startswith(("error:", "fatal:"))] or said or [""]
        raise RuntimeError(f"daily usage, exit {done.returncode}: {told[-1]}")
    return json.loads(done.stdout)
