"""Issue trackers behind one protocol: open issues are found again, closed ones reopened, others created."""

from __future__ import annotations

import json
import re
import subprocess
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

TITLE_CHARS, KEY_CHARS, PREFIX = 80, 240, "signal"
BY_SESSION = ("codex_fallback_main",)
WORKER_TOOLS = ("codex_trust_prompt", "same_model_review", "codex_fallback_main", "codex_missing_hook_state")


@dataclass(frozen=True)
class Issue:
    id: str
    backend: str
    title: str
    url: str | None = None


def title(kind: str, row: Mapping[str, object], prefix: str = PREFIX) -> str:
    """The title of a signal, the same as the column expression in operators.signals."""
    lead, text = {
        "correction": ("session_id", "context"),
        "error": ("tool_name", "message"),
        "workaround": ("pattern", "context"),
        "pattern": ("session_id", "description"),
        "deferral": ("session_id", "item"),
    }[kind]
    said = row["session_id"] if kind == "error" and row["tool_name"] in BY_SESSION else str(row[text])[:TITLE_CHARS]
    return f"[{prefix}/{kind}] {row[lead]}: {said}"


def idempotency_key(text: str) -> str:
    return re.sub(r"\s", "-", text)[:KEY_CHARS]


def priority(kind: str) -> int:
    return 2 if kind in ("correction", "pattern") else 3


def body(kind: str, row: Mapping[str, object], day: str, digest: str | None = None) -> str:
    shown = {
        "correction": [("Context", "context")],
        "error": [("Tool", "tool_name"), ("Message", "message")],
        "workaround": [("Pattern", "pattern"), ("Context", "context")],
        "pattern": [("Kind", "pattern_kind"), ("Description", "description"), ("Evidence", "evidence")],
        "deferral": [("Item", "item")],
    }[kind]
    lines = [f"**Kind**: {kind}", f"**Session**: `{row['session_id']}`", f"**Date**: {day}", *(f"**{n}**: {row[c]}" for n, c in shown)]
    return "\n".join(lines + ([f"**Digest**: `{digest}`"] if digest else []))


class Tracker(Protocol):
    def create(self, kind: str, row: Mapping[str, object]) -> Issue: ...

    def list_open(self) -> Sequence[Issue]: ...

    def is_resolved(self, issue: Issue) -> bool: ...


class NoTracker:
    """Gives every signal a reference of its own and keeps nothing."""

    def create(self, kind: str, row: Mapping[str, object]) -> Issue:
        return Issue(f"digest-{int(time.time())}", "none", title(kind, row))

    def list_open(self) -> Sequence[Issue]:
        return []

    def is_resolved(self, issue: Issue) -> bool:
        return False


def run_text(command: Sequence[str], timeout: int = 30) -> str:
    return subprocess.run(command, capture_output=True, text=True, timeout=timeout, check=True).stdout


def run_json(command: Sequence[str], timeout: int = 30) -> object:
    return json.loads(run_text(command, timeout) or "null")


@dataclass
class CommandTracker:
    """A tracker with a command line that lists, creates, reopens and comments in JSON.

    Listings are read once a run and kept true to what this run changes. Only an
    issue that was closed as done is reopened; any other close is a decision.
    """

    day: str
    command: str = "kata"
    digest: str | None = None
    run: Callable[[Sequence[str]], object] = run_json
    _open: list[Issue] | None = field(default=None, repr=False)
    _closed: list[tuple[Issue, str | None]] | None = field(default=None, repr=False)

    def _listed(self, status: str) -> list[dict]:
        doc = self.run([self.command, "list", "--status", status, "--json"])
        if not isinstance(doc, dict) or not isinstance(doc.get("issues"), list):
            raise ValueError("a listing without issues")
        return [i for i in doc["issues"] if i["status"] == status]

    def _issue(self, i: dict) -> Issue:
        return Issue(f"#{i.get('short_id') or i.get('uid') or i['number']}", self.command, i["title"])

    def list_open(self) -> list[Issue]:
        if self._open is None:
            self._open = [self._issue(i) for i in self._listed("open")]
        return self._open

    def list_closed(self) -> list[tuple[Issue, str | None]]:
        if self._closed is None:
            self._closed = [(self._issue(i), i.get("closed_reason")) for i in self._listed("closed")]
        return self._closed

    def create(self, kind: str, row: Mapping[str, object]) -> Issue:
        name = title(kind, row)
        for issue in self.list_open():
            if issue.title == name:
                return issue
        for issue, reason in self.list_closed():
            if issue.title != name:
                continue
            if reason == "done":
                ref = issue.id.lstrip("#")
                self.run([self.command, "reopen", ref, "--json"])
                self.run([self.command, "comment", ref, "--body", f"Recurred on {self.day} — closure may have been premature.", "--json"])
                self.list_open().append(issue)
                self._closed = [c for c in self.list_closed() if c[0].id != issue.id]
            return issue
        args = [self.command, "create", name, "--body", body(kind, row, self.day, self.digest), "--label", PREFIX, "--label", f"{PREFIX}:{kind}", "--idempotency-key", idempotency_key(name), "--priority", str(priority(kind)), "--json"]
        tool = row.get("tool_name")
        if kind == "error" and tool in WORKER_TOOLS and str(row["session_id"]).removesuffix(f":{tool}") not in ("", row["session_id"]):
            args.append("--force-new")
        made = self.run(args)
        found = made.get("issue", made)
        issue = Issue(f"#{found.get('short_id') or found.get('uid') or found['number']}", self.command, name)
        self.list_open().append(issue)
        return issue

    def is_resolved(self, issue: Issue) -> bool:
        return any(c.id == issue.id for c, _ in self.list_closed())


@dataclass
class RepositoryTracker:
    """Issues of a hosted repository, by its command line; titles are compared exactly.

    Listings are JSON; creating prints the new issue's address and nothing else.
    """

    repository: str
    day: str
    run: Callable[[Sequence[str]], str] = run_text
    limit: int = 10_000
    _open: list[Issue] | None = field(default=None, repr=False)

    def list_open(self) -> list[Issue]:
        if self._open is None:
            listed = self.run(["gh", "issue", "list", "--repo", self.repository, "--state", "open", "--label", PREFIX, "--limit", str(self.limit), "--json", "number,title,url"])
            self._open = [Issue(f"#{i['number']}", "github", i["title"], i["url"]) for i in json.loads(listed)]
        return self._open

    def create(self, kind: str, row: Mapping[str, object]) -> Issue:
        name = title(kind, row)
        for issue in self.list_open():
            if issue.title == name:
                return issue
        url = self.run(["gh", "issue", "create", "--repo", self.repository, "--title", name, "--body", body(kind, row, self.day), "--label", f"{PREFIX},{PREFIX}/{kind}"]).strip()
        issue = Issue(f"#{url.rsplit('/', 1)[-1]}", "github", name, url)
        self.list_open().append(issue)
        return issue

    def is_resolved(self, issue: Issue) -> bool:
        """Whether it is closed; an issue that can't be shown counts as open."""
        try:
            shown = json.loads(self.run(["gh", "issue", "view", issue.id.lstrip("#"), "--repo", self.repository, "--json", "state"]))
        except (subprocess.CalledProcessError, ValueError):
            return False
        return shown.get("state") == "CLOSED"
