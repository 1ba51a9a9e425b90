import json
import os
from datetime import UTC, date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import signals
from tidemark.plans import nightly, state
from tidemark.sinks import digest, tracker
from tidemark.sources.registers import Check, Standing
from tidemark.sources.transcripts import SessionFolders

DAY = date(2026, 7, 6)


def write(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")


def event(name, minute, **data):
    return {"event": name, "timestamp": f"2026-07-05T09:{minute:02d}:00Z", "data": data}


def storm(tmp_path, name="storm"):
    rows = [event("prompt:submit", 0, prompt="go"), event("llm:response", 0, model="m1", raw={"content": [{"type": "text", "text": "done"}]}, usage={"cost_usd": "0.42", "input_tokens": 1000, "output_tokens": 100})]
    rows += [event("context:compaction", m) for m in (1, 4, 8)] + [event("tool:pre", 10 + i, tool_name="bash", tool_input={"c": 1}) for i in range(4)]
    write(tmp_path / f"t/p/sessions/{name}/events.jsonl", *rows)


def args(tmp_path, **more):
    return nightly.Args(datetime.now(UTC) - timedelta(days=1), DAY, tmp_path / "out", tmp_path / "state/processed", **more)


def test_storm_session(spark, tmp_path):
    storm(tmp_path)
    r = nightly.review(spark, [SessionFolders(spark, [str(tmp_path / "t")])], args(tmp_path))
    assert [p["evidence"] for p in r.patterns] == ["3 compactions 09:01-09:08", "`bash` x4 identical arguments 09:10-09:13"]
    assert (r.sessions_scanned, r.spend.total, r.spend.sessions_with_cost) == (1, Decimal("0.42"), 1)
    text = (tmp_path / "out/learning-digest-2026-07-06.md").read_text()
    assert "- **Total**: $0.42 across 1 of 1 session(s) with usage data\n- **Tokens**: 1000 in / 100 out" in text
    assert "signals_detected: 2" in text and "- `m1`: $0.42" in text
    assert (tmp_path / "state/processed").read_text() == "storm\n"


def test_signals_count_once_over_runs(spark, tmp_path):
    storm(tmp_path)
    readers = [SessionFolders(spark, [str(tmp_path / "t")])]
    nightly.review(spark, readers, args(tmp_path))
    again = nightly.review(spark, readers, args(tmp_path))
    assert again.sessions_scanned == 0 and again.count() == 0
    (tmp_path / "state/processed").unlink()  # the session is seen anew: its signals are known
    more = nightly.review(spark, readers, args(tmp_path))
    assert (more.sessions_scanned, more.count(), sum(more.detected.values())) == (1, 0, 2)
    assert sum(more.in_window.values()) == 2


class Failing:
    def __init__(self):
        self.left, self.made = 1, []

    def list_open(self):
        return self.made

    def create(self, kind, row):
        if self.left:
            self.left -= 1
            raise RuntimeError("down")
        issue = tracker.Issue(f"#{len(self.made) + 1}", "x", tracker.title(kind, row))
        self.made.append(issue)
        return issue


def test_failed_creates_are_tried_again(spark, tmp_path):
    storm(tmp_path)
    readers, t = [SessionFolders(spark, [str(tmp_path / "t")])], Failing()
    first = nightly.review(spark, readers, args(tmp_path, create_issues=True), t)
    assert (first.tracker_failures, len(t.made)) == (1, 1)
    assert (tmp_path / "state/processed").read_text() == "" and "storm" in (tmp_path / "state/processed.retry").read_text()
    second = nightly.review(spark, readers, args(tmp_path, create_issues=True), t)
    assert (second.tracker_failures, len(t.made), second.count()) == (0, 2, 0)
    assert (tmp_path / "state/processed.retry").read_text() == "" and "storm" in (tmp_path / "state/processed").read_text()
    assert "storm" in (tmp_path / "out/learning-digest-2026-07-06.md").read_text()  # a retry-only run keeps the day's digest


def test_unwritten_digest_keeps_its_sessions_pending(spark, tmp_path, monkeypatch):
    storm(tmp_path)
    readers = [SessionFolders(spark, [str(tmp_path / "t")])]

    def broken(*_):
        raise OSError("disk full")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(digest, "write", broken)
        nightly.review(spark, readers, args(tmp_path))
    assert "storm" in (tmp_path / "state/processed.render").read_text()
    assert nightly.review(spark, readers, args(tmp_path)).count() == 2
    assert (tmp_path / "state/processed.render").read_text() == ""


def test_first_reader_with_content_wins(spark, tmp_path):
    storm(tmp_path, "one")
    write(tmp_path / "u/p/sessions/one/transcript.jsonl", {"role": "user", "content": "x"})
    (tmp_path / "e/p/sessions/one").mkdir(parents=True)
    (tmp_path / "e/p/sessions/one/transcript.jsonl").write_text("")
    r = nightly.review(spark, [SessionFolders(spark, [str(tmp_path / d)]) for d in "etu"], args(tmp_path, dry_run=True))
    assert r.sessions_scanned == 1 and len(r.patterns) == 2
    assert not (tmp_path / "out").exists()


def test_ledger_file(spark, tmp_path):
    p = tmp_path / "l"
    p.write_text("2026-07-01\tcf\t2026-07-01T00:00:00Z\terror:s:1\n2026-07-01\tc\terror:s:2\nbad\n2020-01-01\tc\t-\terror:s:3\n")
    led = state.Ledger.load(p)
    assert len(led.entries) == 3
    led.mark("error:s:2", DAY, datetime(2026, 7, 5, tzinfo=UTC), filed=True)
    led.save(spark, p, DAY)
    assert p.read_text() == "2026-07-01\tcf\t2026-07-01T00:00:00Z\terror:s:1\n2026-07-01\tcf\t2026-07-05T00:00:00Z\terror:s:2\n"
    assert signals.counted_in_window(led.table(spark), F.lit(datetime(2026, 7, 2, tzinfo=UTC))).first()["errors"] == 1


def test_pending_file(tmp_path):
    now = datetime(2026, 7, 6, tzinfo=UTC)
    p = tmp_path / "r"
    p.write_text("2026-07-01T00:00:00Z\ta\nbad\tb\nno tab\n")
    found = state.load_pending(p, now)
    assert found == {"a": datetime(2026, 7, 1, tzinfo=UTC), "b": now - timedelta(days=14) + timedelta(minutes=5)}
    assert state.widened(now, list(found.values())) == now - timedelta(days=14) + timedelta(minutes=5) - timedelta(seconds=1)
    assert state.widened(now, []) == now


GOLDEN = """---
date: 2031-03-08
signals_captured: 8
p0_count: 2
corrections: 3
errors: 2
workarounds: 1
deferrals: 1
patterns: 1
workarounds_standing: 4
workarounds_expired: 1
workaround_register_problems: 0
---

# Learning Digest — 2031-03-08

## P0 Alerts

- **P0 ALERT**: `sql` failed in 4 distinct sessions: k-21, k-22, k-23, k-24
- **P0 CANDIDATE**: workaround `q#cd34` expired 2031-02-20 (owner ben): skip checks

## Corrections

- `ana@Lab 3` `seat:window` `k-11` — 'it\\'s upside down'
- `k-10` — 'no, sort by weight' (recurred in sessions totaling $0.75)
- `k-12` — 'undo'

## Errors

- `k-20` / `fetch`: gone
- `k-21` / `sql`: no table

## Workarounds

- `k-30` pattern=`FIXME`: 'FIXME: rounding' (→ kata#t4)

## Deferrals

- `k-40` pattern=`circle back`

## Patterns

- `k-50` kind=`resume_storm`: 7 resumes 22:10-22:31

## Personas

- `ana@Lab 3`: 1 corrections, 2 errors, 0 workarounds, 0 deferrals, 0 patterns (1 session(s)) — 300 in / 40 out tokens, $0.75

## Spend

- **Total**: $7.25 across 4 of 5 session(s) with usage data
- **Tokens**: 90210 in / 1234 out

### Spend by role

- `(root)`: $7.00
- `plan`: $0.25

### Spend by model

- `m-1`: $6.75
- `m-2`: $0.50

### Archive spend

- **Yesterday (2031-03-07)**: no archive rows
- **Trailing 7d (2031-03-01 – 2031-03-07, days in Asia/Tokyo)**: $9.50 across 3 day(s) — x $9.50
- **Top models (7d)**: `m-1` $9.00, `m-2` $0.50

"""


def golden_report():
    c = {"session_id": "k-10", "context": "no, sort by weight"}
    w = {"session_id": "k-30", "pattern": "FIXME", "context": "FIXME: rounding"}
    zero = dict.fromkeys(digest.KINDS, 0)
    return digest.Report(
        "2031-03-08",
        corrections=[{"session_id": "k-11", "seat": "window", "persona": "ana", "channel": "Lab 3", "context": "it's upside down"}, c, {"session_id": "k-12", "context": "undo"}],
        errors=[{"session_id": "k-20", "tool_name": "fetch", "message": "gone"}, {"session_id": "k-21", "tool_name": "sql", "message": "no table"}],
        workarounds=[w],
        deferrals=[{"session_id": "k-40", "item": "circle back"}],
        patterns=[{"session_id": "k-50", "pattern_kind": "resume_storm", "description": "resume storm", "evidence": "7 resumes 22:10-22:31"}],
        alerts={"sql": ["k-23", "k-21", "k-22", "k-24"]},
        spend=digest.Spend(Decimal("7.25"), 5, 4, 90210, 1234, {"(root)": Decimal("7"), "plan": Decimal("0.25")}, {"m-1": Decimal("6.75"), "m-2": Decimal("0.5")}),
        archive=digest.ArchiveSpend(date(2031, 3, 1), date(2031, 3, 7), "Asia/Tokyo", digest.Period(Decimal("9.5"), 3, {"x": Decimal("9.5")}, {"m-1": Decimal(9), "m-2": Decimal("0.5")})),
        recurrence={tracker.title("correction", c): "$0.75"},
        issues={tracker.title("workaround", w): tracker.Issue("#t4", "kata", "t")},
        personas={"ana@Lab 3": zero | {"persona": "ana", "channel": "Lab 3", "sessions": 1, "corrections": 1, "errors": 2, "input_tokens": 300, "output_tokens": 40, "cost": Decimal("0.75")}},
        register=Check(1, 4, [("r.md", Standing("skip checks", "h", "q#cd34", "ben", date(2031, 2, 1), date(2031, 2, 20)))], []),
        sessions_scanned=5,
    )


def test_golden_digest():
    assert digest.render(golden_report()) == GOLDEN


def test_register_block_is_refreshed_in_place():
    r = golden_report()
    r.register = None
    assert digest.refresh_register(digest.render(r), golden_report().register) == GOLDEN


def test_json_and_summary():
    doc = json.loads(digest.report_json(golden_report()))
    assert doc["schema_version"] == 2 and doc["personas"]["ana@Lab 3"]["cost_usd"] == "0.75" and doc["p0_alerts"] == {"sql": ["k-21", "k-22", "k-23", "k-24"]}
    assert digest.summary(golden_report()) == "3 corrections, 2 errors, 1 workarounds, 1 deferrals, 1 patterns, 2 P0 alert(s), 5 session(s) scanned"


def test_command_tracker():
    calls = []

    def run(command):
        calls.append(command[1])
        if command[1] == "list":
            closed = [{"number": 5, "title": "[signal/deferral] s: b", "status": "closed", "closed_reason": "done"}, {"number": 6, "title": "[signal/deferral] s: c", "status": "closed", "closed_reason": "wontfix"}]
            return {"issues": [{"short_id": "a1", "title": "[signal/deferral] s: a", "status": "open"}, *closed]}
        return {"issue": {"short_id": "new"}}

    t = tracker.CommandTracker("2026-07-06", run=run)
    make = lambda item: t.create("deferral", {"session_id": "s", "item": item}).id
    assert [make(x) for x in ("a", "b", "c", "d", "d")] == ["#a1", "#5", "#6", "#new", "#new"]
    assert calls == ["list", "list", "reopen", "comment", "create"]
    assert tracker.priority("pattern") == 2 and tracker.idempotency_key("a b\n" + "c" * 300)[:4] == "a-b-"


def test_repository_tracker():
    calls = []

    def run(command):
        calls.append(command[2])
        return {"list": "[]", "create": "https://example.org/a/b/issues/17\n", "view": '{"state": "CLOSED"}'}[command[2]]

    t = tracker.RepositoryTracker("a/b", "2031-03-08", run)
    row = {"session_id": "s", "item": "x"}
    issue = t.create("deferral", row)
    assert (issue.id, issue.url) == ("#17", "https://example.org/a/b/issues/17") and t.create("deferral", row) is issue
    assert calls == ["list", "create"] and t.is_resolved(issue)


def test_only_chosen_folders_are_read(spark, tmp_path):
    storm(tmp_path, "new")
    storm(tmp_path, "old")
    old = tmp_path / "t/p/sessions/old/events.jsonl"
    os.utime(old, (1_000_000_000, 1_000_000_000))
    reader = SessionFolders(spark, [str(tmp_path / "t")])
    r = nightly.review(spark, [reader], args(tmp_path, dry_run=True))
    assert r.sessions_scanned == 1 and [p.rsplit("/", 1)[1] for p in reader.chosen] == ["new"]
    assert {x.path.rsplit("/", 2)[1] for x in reader.events().collect()} == {"new"}
