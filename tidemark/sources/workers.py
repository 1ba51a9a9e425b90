"""Evidence about dispatched workers: three producers of tool errors, from tables and logs.

Issues are JSON documents (one row each, as variant v); pane owners, hook states
and live panes are tables, so what only a live host can tell is an input.
"""

from __future__ import annotations

import json
import logging
import re
import subprocess
import tomllib
from collections.abc import Callable, Sequence
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import content as C
from tidemark.functions import text as X
from tidemark.operators.detectors import where_once
from tidemark.sources import base
from tidemark.sources.base import Reader, fitted
from tidemark.sources.transcripts import Rollouts

logger = logging.getLogger(__name__)

RECORDS = ("session_id", "kind", "detail", "at", "path", "seat")


def _records(df: DataFrame, kind: str, detail: Column) -> DataFrame:
    return df.select(F.concat_ws(":", "id", F.lit(kind)).alias("session_id"), F.lit(kind).alias("kind"), F.concat(F.col("id"), F.lit(": "), detail).alias("detail"), "at", "path", "seat")


def dispatches(issues: DataFrame) -> DataFrame:
    """The dispatch, kickoff and comments of each issue document {issue, comments}."""
    v = F.col("v")
    d, k = "$.issue.metadata.dispatch", "$.issue.metadata.kickoff"
    named = {
        "id": f"{d}.id", "harness": f"{d}.harness", "seat": f"{d}.seat", "host": f"{d}.host", "pane": f"{d}.pane", "socket": f"{d}.tmux_socket", "worktree": f"{d}.worktree",
        "kickoff_id": f"{k}.id", "kickoff_state": f"{k}.state", "kickoff_detail": f"{k}.detail", "bound": f"{k}.session_observed", "status": "$.issue.status", "reference": "$.issue.qualified_id",
    }
    out = issues.select(
        *[C.text_at(v, p).alias(n) for n, p in named.items()],
        X.parsed_time(C.text_at(v, f"{d}.dispatched_at")).alias("start"),
        X.parsed_time(C.text_at(v, f"{k}.at")).alias("kickoff_at"),
        F.concat(F.lit("issue:"), F.coalesce(C.text_at(v, "$.issue.uid"), C.text_at(v, f"{d}.id"))).alias("path"),
        C.items(C.at(v, "$.comments")).alias("comments"),
    )
    return where_once(out, F.expr("id IS NOT NULL AND start IS NOT NULL"))


def candidates(listed: DataFrame, since: Column) -> DataFrame:
    """Listed issues (as variant v) that can hold evidence: open ones of one harness always, others if one of three times is since then.

    A missing time of the last change keeps an issue; missing times of dispatch and kickoff don't.
    """
    v = F.col("v")
    at = lambda path: X.parsed_time(C.text_at(v, path))
    harness = C.text_at(v, "$.metadata.dispatch.harness")
    live = F.coalesce((C.text_at(v, "$.status") == "open") & (harness == "codex"), F.lit(False))
    recent = F.coalesce(at("$.updated_at") >= since, F.lit(True)) | F.coalesce(at("$.metadata.dispatch.dispatched_at") >= since, F.lit(False)) | F.coalesce(at("$.metadata.kickoff.at") >= since, F.lit(False))
    return listed.filter((live | recent) & harness.isin("codex", "claude") & C.text_at(v, "$.qualified_id").isNotNull())


def pane_owners(listed: DataFrame) -> DataFrame:
    """host, socket, pane, id and at of every dispatch that is listed."""
    v, d = F.col("v"), "$.metadata.dispatch"
    of = lambda name: C.text_at(v, f"{d}.{name}")
    made = listed.select(of("host").alias("host"), F.coalesce(of("tmux_socket"), F.lit("default")).alias("socket"), pane_number(of("pane")).alias("pane"), of("id").alias("id"), X.parsed_time(of("dispatched_at")).alias("at"))
    return where_once(made, F.expr("host IS NOT NULL AND pane IS NOT NULL AND id IS NOT NULL AND at IS NOT NULL"))


def trust_prompts(found: DataFrame, since: Column) -> DataFrame:
    stopped = found.filter("harness = 'codex' AND kickoff_id = id AND kickoff_state = 'failed' AND kickoff_detail LIKE 'dialog:dir-trust:%'")
    timed = stopped.withColumn("at", F.col("kickoff_at")).filter((F.col("at") >= since) & (F.col("at") >= F.col("start")))
    return _records(timed, "codex_trust_prompt", F.lit("kickoff stopped at directory-trust prompt"))


def same_model(body: Column, harness: Column, command: str) -> Column:
    """Whether a review comment's first line runs the builder's own model family."""
    first = F.regexp_replace(F.substring_index(body, "\n", 1), "\r$", "")
    words = F.split(F.trim(F.regexp_replace(F.substring(first, 9, 1 << 20), r"(?U)\s+", " ")), " ")
    gpt, claude = F.array_contains(words, "--gpt"), F.array_contains(words, "--claude")
    return first.startswith("review: ") & (F.element_at(words, 1) == command) & (((harness == "codex") & gpt & ~claude) | ((harness == "claude") & claude & ~gpt))


def same_model_reviews(found: DataFrame, since: Column, command: str) -> DataFrame:
    """The first comment of each dispatch that is such a review by the given command."""
    each = found.select("id", "harness", "seat", "path", "start", F.posexplode("comments").alias("n", "c"))
    timed = each.withColumn("at", X.parsed_time(C.text_at(F.col("c"), "$.created_at"))).filter((F.col("at") >= since) & (F.col("at") >= F.col("start")))
    hits = timed.filter(same_model(F.coalesce(C.text_at(F.col("c"), "$.body"), F.lit("")), F.coalesce("harness", F.lit("")), command))
    first = F.row_number().over(Window.partitionBy("path", "id").orderBy("n"))
    return _records(hits.withColumn("_n", first).filter("_n = 1"), "same_model_review", F.lit("review used builder model family"))


def allocations(lines: DataFrame, since: Column, profiles_exist: bool, zone: str = "UTC") -> DataFrame:
    """One record for each host and day of a tab-separated log (path, line) on which the main seat was chosen."""
    f = F.split("line", "\t")
    rows = lines.select("path", F.get(f, 0).alias("ts"), F.get(f, 1).alias("host"), F.get(f, 2).alias("action"), F.get(f, 3).alias("choice")).filter("action = 'exec' AND choice = 'main'").filter(F.lit(profiles_exist))
    zoned = F.col("ts").rlike(r"([Zz]|[+-]\d\d:\d\d)$")
    at = F.when(zoned, X.parsed_time(F.col("ts"))).otherwise(F.to_utc_timestamp(X.parsed_time(F.col("ts")), zone))
    timed = rows.withColumn("at", at).filter(F.col("at") >= since)
    days = timed.groupBy("host", F.substring("ts", 1, 10).alias("day")).agg(F.max("at").alias("at"), F.count("*").alias("n"), F.min("path").alias("path"))
    told = days.withColumns({"id": F.concat_ws(":", F.lit("allocation"), "host", "day"), "seat": F.lit("main")})
    detail = F.concat(F.lit("main selected while pool profiles exist; "), F.col("n"), F.lit(" exec row(s); last timestamp "), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("; source "), F.col("path"), F.lit("; allocation log has no dispatch id"))
    return _records(told, "codex_fallback_main", detail)


def pane_number(pane: Column) -> Column:
    return F.nullif(F.regexp_extract(pane, r"^%(\d+)$", 1), F.lit(""))


def hook_state_names(reference: Column, socket: Column, pane: Column) -> Column:
    """The one or two names under which a pane's hook state may stand."""
    own = F.concat_ws("-", X.slug(reference), X.slug(socket), pane)
    return F.when(socket == "default", F.array(own, F.concat_ws("-", X.slug(reference), pane))).otherwise(F.array(own))


def missing_hook_states(found: DataFrame, owners: DataFrame, states: DataFrame, rollouts: DataFrame, live: DataFrame, since: Column, host: str, trusted: bool) -> DataFrame:
    """Open dispatches whose live pane ran but left no hook state.

    owners: host, socket, pane, id, at; states: name; rollouts: cwd, session,
    started, originator, first_turn, path; live: socket, pane, cwd. Any condition
    that is not confirmed drops the row.

    Broadcast are rows of one host only, at most one dispatch for each of its panes:
    the other tables are as long as the history and stay where they are.
    """
    newest = owners.groupBy("host", "socket", "pane").agg(F.max_by("id", F.struct("at", "id")).alias("newest"))
    mine = found.filter(F.lit(trusted) & (F.col("harness") == "codex") & (F.col("status") == "open") & (F.col("host") == host) & F.col("worktree").isNotNull())
    mine = mine.withColumns({"socket": F.coalesce("socket", F.lit("default")), "pane": pane_number(F.col("pane"))}).filter("pane IS NOT NULL")
    owned = mine.join(F.broadcast(newest.filter(F.col("host") == host)), ["host", "socket", "pane"]).filter("newest = id").withColumn("names", hook_state_names(F.col("reference"), F.col("socket"), F.col("pane")))
    # One of the names under which a state stands is enough to drop an id, all its rows included.
    there = states.select(F.regexp_replace("name", r"\.ended\..*$", "").alias("name"), F.lit(True).alias("there")).distinct()
    each = owned.select("*", F.posexplode("names").alias("n", "name")).join(there, "name", "left")
    absent = each.withColumn("there", F.max("there").over(Window.partitionBy("id"))).filter("there IS NULL AND n = 0")
    bound = F.when((F.col("kickoff_id") == F.col("id")) & (F.col("bound") != "-"), F.col("bound"))
    ran = F.broadcast(absent.withColumn("session_bound", bound)).join(rollouts.withColumnRenamed("path", "rollout"), F.col("worktree") == F.col("cwd"))
    fits = F.when(F.col("session_bound").isNotNull(), F.col("session") == F.col("session_bound")).otherwise((F.col("started") >= F.col("start")) & (F.coalesce("originator", F.lit("")) != "codex_exec"))
    first = ran.filter(fits & (F.col("first_turn") >= F.col("start"))).groupBy("id", "seat", "path", "worktree", "socket", "pane", "names", "session_bound", "host").agg(F.min("first_turn").alias("at"), F.min_by("rollout", "first_turn").alias("rollout"))
    seated = live.select("socket", "pane", F.col("cwd").alias("worktree")).join(F.broadcast(first.filter(F.col("at") >= since)), ["socket", "pane", "worktree"])
    sitting = seated.dropDuplicates(["id", "seat", "path", "worktree", "socket", "pane", "names", "session_bound", "host"])
    detail = F.concat(
        F.lit("no dispatch hook state for live pane %"), F.col("pane"), F.lit(" on "), F.col("host"), F.lit(" (socket "), F.col("socket"), F.lit(") after the first assistant turn at "), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ssXXX"),
        F.lit("; expected "), F.array_join("names", " or "), F.lit("; session "), F.coalesce("session_bound", F.lit("unbound")), F.lit("; rollout "), F.col("rollout"),
    )
    return _records(sitting, "codex_missing_hook_state", detail)


def evidence(*parts: DataFrame) -> DataFrame:
    """All records, once for each session id."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = F.row_number().over(Window.partitionBy("session_id").orderBy("at", "path"))
    return out.withColumn("_n", first).filter("_n = 1").drop("_n")


def as_messages(records: DataFrame) -> DataFrame:
    """One failed tool message for each record."""
    body = F.parse_json(F.to_json(F.struct(F.lit(False).alias("success"), F.col("detail").alias("error"), "seat")))
    return records.select("path", "session_id", F.lit(1).cast("long").alias("seq"), F.lit("tool").alias("role"), body.alias("content"), F.col("kind").alias("name"))


def hook_key(hooks_json: str | Path, action: str = "dispatch-state") -> str | None:
    """Under which key a seat's trust in the session-start hook for an action is kept.

    Only a command of just an interpreter, a script and the action counts.
    """
    path = Path(hooks_json)
    try:
        groups = json.loads(path.read_text(encoding="utf-8"))["hooks"]["SessionStart"]
    except (OSError, ValueError, KeyError, TypeError):
        return None
    for g, group in enumerate(groups):
        for h, hook in enumerate(group.get("hooks", ())):
            words = str(hook.get("command", "")).split()
            if hook.get("type") == "command" and len(words) == 3 and words[2] == action and Path(words[0]).name.startswith("python"):
                return f"{path.resolve()}:session_start:{g}:{h}"
    return None


def hook_trusted(config: str, key: str) -> bool:
    """Whether a seat's configuration holds a trust hash for exactly this hook."""
    try:
        entry = tomllib.loads(config)["hooks"]["state"][key]["trusted_hash"]
    except (tomllib.TOMLDecodeError, KeyError, TypeError):
        return False
    return isinstance(entry, str) and entry != ""


def tmux_directory(socket: str, pane: str, timeout: int = 15) -> str | None:
    """The directory of a live pane; None where its server does not answer."""
    try:
        done = subprocess.run(["tmux", "-L", socket, "display-message", "-p", "-t", f"%{pane}", "#{pane_current_path}"], capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None


class WorkerSignals(Reader):
    """Evidence about dispatched workers as sessions of one failed tool call each.

    What only the host can tell comes by three functions: run (the tracker's command
    line, in JSON), probe (socket and pane to directory) and, through Rollouts, files.
    Evidence that can't be had is left out, with a warning.
    """

    name = "worker-signals"

    def __init__(self, spark: SparkSession, since: datetime, run: Callable[[Sequence[str]], object], home: str, pool: str, state_dir: str, host: str | None, review: str, zone: str = "UTC", command: str = "kata", probe: Callable[[str, str], str | None] = tmux_directory):
        super().__init__(spark, [])
        self.cutoff, self.run, self.home, self.pool, self.state_dir, self.host = since, run, home, Path(pool), Path(state_dir), host
        self.review, self.zone, self.command, self.probe = review, zone, command, probe
        self._records: DataFrame | None = None

    def _documents(self, rows: Sequence[object]) -> DataFrame:
        return self.spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.parse_json("j").alias("v"))

    def _told(self, *args: str) -> dict:
        try:
            found = self.run([self.command, *args, "--json"])
        except Exception as e:  # the tracker being away must not cost the other evidence
            logger.warning("worker-signals: %s", e)
            return {}
        return found if isinstance(found, dict) else {}

    def _trusts(self, seat: str | None) -> bool:
        home = Path(self.home) if seat in (None, "main", "-") else self.pool / "profiles" / seat
        key = hook_key(home / "hooks.json")
        try:
            return bool(key) and hook_trusted((home / "config.toml").read_text(encoding="utf-8"), key)
        except OSError:
            return False

    def _hooks(self, found: DataFrame, listed: DataFrame, since: Column) -> DataFrame | None:
        if not self.host or not self.state_dir.is_dir():
            return None
        # Open dispatches of this host: as many as it has panes.
        mine = found.filter((F.col("status") == "open") & (F.col("harness") == "codex") & (F.col("host") == self.host)).select("seat", F.coalesce("socket", F.lit("default")).alias("socket"), pane_number(F.col("pane")).alias("pane")).distinct().collect()
        trusted = [s for s in {r["seat"] for r in mine} if self._trusts(s)]
        held = found.filter(F.coalesce(F.col("seat").isin([s for s in trusted if s]), F.lit(False)) | (F.col("seat").isNull() & F.lit(None in trusted)))
        states = self.spark.createDataFrame([(p.name,) for p in self.state_dir.iterdir()], "name string")
        panes = [(r["socket"], r["pane"], self.probe(r["socket"], r["pane"])) for r in mine if r["pane"]]
        live = self.spark.createDataFrame([p for p in panes if p[2]], "socket string, pane string, cwd string")
        rollouts = Rollouts(self.spark, [f"{self.home}/sessions"], str(self.pool / "profiles")).index()
        return missing_hook_states(held, pane_owners(listed), states, rollouts, live, since, self.host, True)

    def records(self) -> DataFrame:
        if self._records is None:
            since = F.lit(self.cutoff)
            listed = self._documents(self._told("list", "--all", "--status", "all", "--meta", "dispatch", "--limit", "0").get("issues") or [])
            names = [r["name"] for r in candidates(listed, since).select(C.text_at(F.col("v"), "$.qualified_id").alias("name")).collect()]
            found = dispatches(self._documents([d for d in (self._told("show", n) for n in names) if d])).persist()
            log = self.pool / "log" / "allocation.log"
            lines = self.spark.createDataFrame([(str(log), x) for x in log.read_text(encoding="utf-8").splitlines()] if log.is_file() else [], "path string, line string")
            profiles = (self.pool / "profiles").is_dir() and any(p.is_dir() for p in (self.pool / "profiles").iterdir())
            parts = [trust_prompts(found, since), same_model_reviews(found, since, self.review), allocations(lines, since, profiles, self.zone)]
            hooks = self._hooks(found, listed, since)
            every = evidence(*parts, *([hooks] if hooks is not None else []))
            # Records of one issue share its path; a session needs one of its own.
            self._records = every.withColumn("path", F.concat_ws("#", "path", "session_id")).persist()
        return self._records

    def only(self, paths: Sequence[str]) -> None:
        """Nothing to limit: the records are few and held."""

    def sessions(self) -> DataFrame:
        return fitted(self.records().withColumns({"reader": F.lit(self.name), "modified": F.col("at"), "dedupe_key": F.col("session_id")}), base.SESSIONS)

    def messages(self) -> DataFrame:
        return fitted(as_messages(self.records()), base.MESSAGES)


def short_host(name: str) -> str | None:
    """A host's name up to its first dot; None where there is none."""
    return re.split(r"\.", name.strip(), maxsplit=1)[0] or None
