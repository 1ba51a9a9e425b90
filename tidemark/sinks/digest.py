"""The digest: a byte-stable markdown report, its JSON twin, and its one-line summary.

Input is the ordered rows that the plans collect: bounded by what one report
shows, not by the corpus.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal
from pathlib import Path

from tidemark.sinks.tracker import Issue, title
from tidemark.sources.registers import Check
from tidemark.sources.segments import write_atomic

KINDS = ("corrections", "errors", "workarounds", "deferrals", "patterns")
ERROR_CHARS, TOP_MODELS = 500, 5
TRUNCATED = " … [truncated]"
SCHEMA_VERSION = 2

Row = Mapping[str, object]


def quoted(x: str) -> str:
    table = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return "'" + "".join(table.get(c) or (f"\\x{ord(c):02x}" if ord(c) < 0x20 else c) for c in x) + "'"


def display_safe(x: str) -> str:
    return "".join("'" if c == "`" else " " if ord(c) < 0x20 or 0x7F <= ord(c) <= 0x9F else c for c in x)


def dollars(x: Decimal) -> str:
    """Two decimal places at least; none are rounded away."""
    places = -x.as_tuple().exponent
    return f"${x.quantize(Decimal('0.01')) if places < 2 else x}"


def shortened(x: str, n: int) -> str:
    return x[:n] + TRUNCATED if len(x) > n else x


@dataclass
class Period:
    total: Decimal
    days: int
    agents: dict[str, Decimal] = field(default_factory=dict)
    models: dict[str, Decimal] = field(default_factory=dict)


@dataclass
class ArchiveSpend:
    week_from: date
    week_to: date
    timezone: str
    week: Period
    yesterday: Period | None = None


@dataclass
class Spend:
    total: Decimal | None
    sessions: int
    sessions_with_cost: int
    input_tokens: int
    output_tokens: int
    roles: dict[str, Decimal] = field(default_factory=dict)
    models: dict[str, Decimal] = field(default_factory=dict)


@dataclass
class Report:
    day: str
    corrections: Sequence[Row] = ()
    errors: Sequence[Row] = ()
    workarounds: Sequence[Row] = ()
    deferrals: Sequence[Row] = ()
    patterns: Sequence[Row] = ()
    alerts: Mapping[str, Sequence[str]] = field(default_factory=dict)
    spend: Spend | None = None
    archive: ArchiveSpend | None = None
    recurrence: Mapping[str, str] = field(default_factory=dict)
    issues: Mapping[str, Issue] = field(default_factory=dict)
    personas: Mapping[str, Row] = field(default_factory=dict)
    detected: Mapping[str, int] | None = None
    in_window: Mapping[str, int] | None = None
    register: Check | None = None
    sessions_scanned: int = 0
    tracker_failures: int = 0
    path: str | None = None

    def count(self) -> int:
        return sum(len(getattr(self, k)) for k in KINDS)

    def alert_count(self) -> int:
        return len(self.alerts) + (self.register.alerts if self.register else 0)


def _prefix(row: Row) -> str:
    out = ""
    if row.get("persona"):
        channel = row.get("channel")
        out = f"`{display_safe(row['persona'])}{'@' + display_safe(channel) if channel is not None else ''}` "
    for dim in ("seat", "agent", "machine"):
        if row.get(dim) is not None:
            out += f"`{dim}:{display_safe(row[dim])}` "
    return out


def _notes(report: Report, kind: str, row: Row) -> str:
    key = title(kind, row)
    issue = report.issues.get(key)
    out = f" (→ {issue.backend}#{issue.id.lstrip('#')})" if issue else ""
    return out + (f" (recurred in sessions totaling {report.recurrence[key]})" if key in report.recurrence else "")


def _front(report: Report) -> list[str]:
    lines = ["---", f"date: {report.day}", f"signals_captured: {report.count()}", f"p0_count: {report.alert_count()}"]
    lines += [f"{k}: {len(getattr(report, k))}" for k in KINDS]
    for counts, suffix in ((report.detected, "detected"), (report.in_window, "in_window")):
        if counts is not None:
            lines += [f"signals_{suffix}: {sum(counts[k] for k in KINDS)}"] + [f"{k}_{suffix}: {counts[k]}" for k in KINDS]
    if report.register:
        lines += register_lines(report.register)
    return [*lines, "---", ""]


def register_lines(c: Check) -> list[str]:
    return [f"workarounds_standing: {c.standing}", f"workarounds_expired: {len(c.expired)}", f"workaround_register_problems: {len(c.problems)}"]


def register_alerts(c: Check) -> list[str]:
    out = [f"- **P0 CANDIDATE**: workaround `{display_safe(r.tracking)}` expired {r.expires} (owner {display_safe(r.owner)}): {display_safe(r.workaround)}" for _, r in c.expired]
    home = str(Path.home())
    short = lambda p: "~" + p[len(home) :] if p.startswith(home + "/") else p
    return out + [f"- **P0 CANDIDATE**: workaround register `{display_safe(short(p))}` was not checked: {display_safe(m)}" for p, m in c.problems]


def _section(name: str, lines: list[str], none: str | None) -> list[str]:
    return [f"## {name}", "", *(lines or [none]), ""]


def _agents(p: Period) -> str:
    listed = sorted(p.agents.items(), key=lambda x: (-x[1], x[0]))
    return " — " + ", ".join(f"{display_safe(a)} {dollars(c)}" for a, c in listed) if listed else ""


def _archive(a: ArchiveSpend) -> list[str]:
    out = ["### Archive spend", ""]
    out.append(f"- **Yesterday ({a.week_to})**: " + (f"{dollars(a.yesterday.total)}{_agents(a.yesterday)}" if a.yesterday else "no archive rows"))
    out.append(f"- **Trailing 7d ({a.week_from} – {a.week_to}, days in {display_safe(a.timezone)})**: {dollars(a.week.total)} across {a.week.days} day(s){_agents(a.week)}")
    top = sorted(a.week.models.items(), key=lambda x: (-x[1], x[0]))[:TOP_MODELS]
    if top:
        out.append("- **Top models (7d)**: " + ", ".join(f"`{display_safe(m)}` {dollars(c)}" for m, c in top))
    return [*out, ""]


def _spend(report: Report) -> list[str]:
    if not report.spend and not report.archive:
        return []
    out = ["## Spend", ""]
    if s := report.spend:
        out.append(f"- **Total**: {dollars(s.total)} across {s.sessions_with_cost} of {s.sessions} session(s) with usage data" if s.total is not None else f"- **Total**: no cost data ({s.sessions} session(s) with usage; unpriced models)")
        out += [f"- **Tokens**: {s.input_tokens} in / {s.output_tokens} out", ""]
        for name, costs in (("role", s.roles), ("model", s.models)):
            if costs:
                out += [f"### Spend by {name}", "", *(f"- `{k}`: {dollars(costs[k])}" for k in sorted(costs)), ""]
    return out + (_archive(report.archive) if report.archive else [])


def _persona(key: str, p: Row) -> str:
    usage = ""
    if p["input_tokens"] or p["output_tokens"] or p.get("cost") is not None:
        usage = f" — {p['input_tokens']} in / {p['output_tokens']} out tokens" + (f", {dollars(p['cost'])}" if p.get("cost") is not None else "")
    if not any(p[k] for k in KINDS):
        return f"- `{key}`: no signals ({p['sessions']} session(s)){usage}"
    return f"- `{key}`: " + ", ".join(f"{p[k]} {k}" for k in KINDS) + f" ({p['sessions']} session(s)){usage}"


def render(r: Report) -> str:
    out = _front(r)
    out += [f"# Learning Digest — {r.day}", ""]
    alerts = [f"- **P0 ALERT**: `{t}` failed in {len(r.alerts[t])} distinct sessions: {', '.join(sorted(r.alerts[t]))}" for t in sorted(r.alerts)]
    out += _section("P0 Alerts", alerts + (register_alerts(r.register) if r.register else []), "_No P0 alerts._")
    lines = {
        "corrections": lambda x: f"`{x['session_id']}` — {quoted(x['context'])}",
        "errors": lambda x: f"`{x['session_id']}` / `{x['tool_name']}`: {shortened(x['message'], ERROR_CHARS)}",
        "workarounds": lambda x: f"`{x['session_id']}` pattern=`{x['pattern']}`: {quoted(x['context'])}",
        "deferrals": lambda x: f"`{x['session_id']}` pattern=`{x['item']}`",
        "patterns": lambda x: f"`{x['session_id']}` kind=`{x['pattern_kind']}`: {x['evidence']}",
    }
    for k, line in lines.items():
        notes = (lambda x, k=k: "") if k == "deferrals" else (lambda x, k=k: _notes(r, k[:-1], x))
        out += _section(k.capitalize(), [f"- {_prefix(x)}{line(x)}{notes(x)}" for x in getattr(r, k)], f"_No {k} detected._")
    if r.personas:
        out += _section("Personas (detected)" if r.detected is not None else "Personas", [_persona(k, r.personas[k]) for k in sorted(r.personas)], None)
    return "\n".join(out + _spend(r)) + "\n"


def refresh_register(text: str, c: Check) -> str:
    """A digest that stays, with its register lines made anew."""
    old = ("workarounds_standing: ", "workarounds_expired: ", "workaround_register_problems: ")
    lines = [x for x in text.split("\n") if not x.startswith(old) and not x.startswith("- **P0 CANDIDATE**: workaround ")]
    end = lines.index("---", 1)
    lines[end:end] = register_lines(c)
    at = lines.index("## P0 Alerts") + 2
    stop = next(i for i in range(at, len(lines)) if lines[i].startswith("## "))
    body = [x for x in lines[at:stop] if x and x != "_No P0 alerts._"] + register_alerts(c)
    lines[at:stop] = [*(body or ["_No P0 alerts._"]), ""]
    tools = sum(x.startswith("- **P0 ALERT**") for x in body)
    return "\n".join(f"p0_count: {tools + c.alerts}" if x.startswith("p0_count: ") else x for x in lines)


def digest_path(folder: str | Path, day: str) -> Path:
    return Path(folder) / f"learning-digest-{day}.md"


def write(folder: str | Path, report: Report) -> Path:
    path = digest_path(folder, report.day)
    write_atomic(path, render(report))
    return path


def _money(x: Decimal | None) -> str | None:
    return None if x is None else str(x)


def report_json(r: Report, dry_run: bool = False) -> str:
    spend = r.spend and {
        "total_cost_usd": _money(r.spend.total), "sessions_with_stats": r.spend.sessions, "sessions_with_cost": r.spend.sessions_with_cost,
        "input_tokens": r.spend.input_tokens, "output_tokens": r.spend.output_tokens,
        "role_costs": {k: str(v) for k, v in r.spend.roles.items()}, "model_costs": {k: str(v) for k, v in r.spend.models.items()},
    }
    personas = {k: {"persona": p["persona"], "channel": p.get("channel"), "sessions": p["sessions"], "input_tokens": p["input_tokens"], "output_tokens": p["output_tokens"], "cost_usd": _money(p.get("cost"))} | {n: p[n] for n in KINDS} for k, p in r.personas.items()}
    doc: dict[str, object] = {k: len(getattr(r, k)) for k in KINDS} | {
        "schema_version": SCHEMA_VERSION,
        "sessions_scanned": r.sessions_scanned,
        "tracker_failures": r.tracker_failures,
        "digest_path": None if dry_run else r.path,
        "created_issues": [{"id": i.id, "backend": i.backend, "url": i.url, "title": i.title} for i in r.issues.values()],
        "p0_alerts": {k: sorted(v) for k, v in r.alerts.items()},
        "detected": r.detected,
        "in_window": r.in_window,
        "spend": spend,
        "personas": personas,
    }
    if r.register:
        doc["workaround_register"] = {"standing": r.register.standing, "expired": len(r.register.expired), "problems": len(r.register.problems), "registers": r.register.registers}
    return json.dumps(doc, sort_keys=True, indent=2, ensure_ascii=False)


def summary(r: Report) -> str:
    line = ", ".join(f"{len(getattr(r, k))} {k}" for k in KINDS) + f", {r.alert_count()} P0 alert(s), {r.sessions_scanned} session(s) scanned"
    if r.detected is not None:
        line += f" ({sum(r.detected[k] for k in KINDS)} detected" + (f", {sum(r.in_window[k] for k in KINDS)} in window" if r.in_window is not None else "") + ")"
    return line


def register_summary(c: Check) -> str:
    line = f"Workarounds: {c.standing} standing, {len(c.expired)} expired across {c.registers} register(s)"
    return line + (f", {len(c.problems)} not checked" if c.problems else "")
