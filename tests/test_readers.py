import json
import sqlite3
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import health
from tidemark.sources import archive, registers, workers
from tidemark.sources import transcripts as R


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")


def said(reader):
    rows = reader.messages().withColumn("content", F.to_json("content")).orderBy("path", "seq").collect()
    return [(r["role"], json.loads(r["content"]) if r["content"] else None, r["name"]) for r in rows]


def kinds(reader):
    return [(r["kind"], r["tool_name"], r["detail"]) for r in reader.events().orderBy("path", "seq").collect()]


def event(name, minute, **data):
    return {"event": name, "timestamp": f"2026-07-05T09:{minute:02d}:00Z", "data": data}


def test_session_folders(spark, tmp_path):
    both, log = tmp_path / "p/sessions/both", tmp_path / "p/sessions/log"
    write(both / "transcript.jsonl", {"role": "user", "content": "hi"}, "{broken", {"role": "tool", "content": {"success": False}, "name": "bash"})
    write(both / "events.jsonl", event("context:compaction", 1), event("tool:pre", 2, tool_name="bash", tool_input={"b": 1, "a": 2}))
    write(
        log / "events.jsonl",
        event("prompt:submit", 1, prompt="go"),
        event("llm:response", 2, model="m1", raw={"content": [{"type": "text", "text": "a"}, {"type": "x"}, {"type": "text", "text": "b"}]}, usage={"cost_usd": "0.42", "input_tokens": 1000, "output_tokens": 100}),
        event("llm:response", 3, raw={"content": [], "model": "m2"}, usage={"cost_usd": 0.1, "input_tokens": 1, "output_tokens": 2}),
        event("tool:post", 4, tool_name="", result={"success": True}),
        {"event": "session:resume", "ts": "bad"},
    )
    write(tmp_path / "single/transcript.jsonl", {"role": "user", "content": "x"})
    r = R.SessionFolders(spark, [str(tmp_path)])
    assert sorted(x["session_id"] for x in r.sessions().collect()) == ["both", "log", "single"]
    assert said(r) == [("user", "hi", None), ("tool", {"success": False}, "bash"), ("user", "go", None), ("assistant", "a\nb", None), ("tool", {"success": True}, None), ("user", "x", None)]
    assert kinds(r) == [("compaction", None, None), ("tool_call", "bash", '{"a":2,"b":1}'), ("user_message", None, None), ("llm_response", None, None), ("llm_response", None, None)]
    assert sorted((x["model"], str(x["cost"]), x["input_tokens"]) for x in r.usage().collect()) == [("m1", "0.420000000000", 1000), ("m2", "0.100000000000", 1)]


def test_indexed_events(spark, tmp_path):
    for name, meta in (("good", {"format": "context-intelligence", "version": "1.2", "last_event_at": "2026-07-01T00:00:00Z"}), ("old", {"format": "context-intelligence", "version": "2.0"}), ("none", None)):
        d = tmp_path / "p/sessions" / name / "context-intelligence"
        write(d / "events.jsonl", event("prompt:submit", 1, prompt=name))
        if meta:
            (d / "metadata.json").write_text(json.dumps(meta, indent=1))
    r = R.IndexedEvents(spark, [str(tmp_path)])
    assert [(x["session_id"], str(x["modified"])) for x in r.sessions().collect()] == [("good", "2026-07-01 00:00:00")]
    assert said(r) == [("user", "good", None)]


def test_wrapped_lines(spark, tmp_path):
    write(
        tmp_path / "main/-x/a.jsonl",
        {"type": "user", "message": {"role": "user", "content": "hi"}},
        {"type": "api-request-blob", "message": {"role": "user", "content": "copy"}},
        {"type": "progress", "message": {"role": "assistant", "content": "x"}},
        {"role": "assistant", "content": "flat"},
        {"type": "summary"},
    )
    write(tmp_path / "pool/seat-03/projects/-x/b.jsonl", {"type": "user", "message": {"role": "user", "content": "b"}})
    r = R.WrappedLines(spark, [str(tmp_path / "main")], str(tmp_path / "pool"), "main")
    assert said(r) == [("user", "hi", None), ("assistant", "x", "progress"), ("assistant", "flat", None), ("user", "b", None)]
    assert sorted((x["session_id"], x["seat"]) for x in r.sessions().collect()) == [("a", "main"), ("b", "seat-03")]


def test_rollouts(spark, tmp_path):
    uid = "5c6d7e8f-1234-4abc-8def-90a1b2c3d4e5"
    write(
        tmp_path / f".codex/sessions/2026/07/rollout-2026-{uid}.jsonl",
        {"type": "session_meta", "timestamp": "2026-07-05T09:00:00Z", "payload": {"id": uid, "cwd": "/w", "originator": "cli"}},
        {"type": "response_item", "timestamp": "2026-07-05T09:01:00Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "q"}]}},
        {"type": "response_item", "timestamp": "2026-07-05T09:02:00Z", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "a"}, {"type": "output_text", "text": "b"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "developer", "content": [{"type": "input_text", "text": "no"}]}},
    )
    r = R.Rollouts(spark, [str(tmp_path / ".codex/sessions")])
    assert said(r) == [("user", "q", None), ("assistant", "a\nb", None)]
    s = r.sessions().first()
    assert (s["seat"], s["dedupe_key"]) == ("main", uid)
    i = r.index().first()
    assert (i["cwd"], i["session"], str(i["first_turn"])) == ("/w", uid, "2026-07-05 09:02:00")


def test_typed_events(spark, tmp_path):
    write(tmp_path / "s1/events.jsonl", {"type": "user.message", "data": {"role": "user", "content": "q"}}, {"type": "tool.x", "data": {"content": "no"}}, {"type": "assistant.message", "data": {"content": ""}}, {"type": "assistant.message", "data": {"content": "a"}})
    assert said(R.TypedEvents(spark, [str(tmp_path)])) == [("user", "q", None), ("assistant", "a", None)]


def test_branch_files(spark, tmp_path):
    at = "2026-07-05T09:00:00Z"
    write(
        tmp_path / "x/2026_abc.jsonl",
        {"type": "session"},
        {"type": "message", "timestamp": at, "message": {"role": "user", "content": "q"}},
        {"type": "message", "timestamp": at, "message": {"role": "assistant", "model": "m", "content": [{"type": "text", "text": "a"}, {"type": "toolCall", "name": "bash", "arguments": {"z": 1, "a": 2}}], "usage": {"input": 1, "cacheRead": 2, "cacheWrite": 3, "output": 4, "cost": {"total": 0.5}}}},
        {"type": "message", "timestamp": at, "message": {"role": "toolResult", "toolName": "bash", "isError": True, "content": [{"type": "text", "text": "bad"}]}},
        {"type": "compaction", "timestamp": at},
    )
    r = R.BranchFiles(spark, [str(tmp_path)])
    assert r.sessions().first()["session_id"] == "abc"
    assert said(r) == [("user", "q", None), ("assistant", "a", None), ("tool", {"success": False, "error": "bad"}, "bash")]
    assert kinds(r) == [("user_message", None, None), ("llm_response", None, None), ("tool_call", "bash", '{"a":2,"z":1}'), ("compaction", None, None)]
    u = r.usage().first()
    assert (u["input_tokens"], u["output_tokens"], float(u["cost"])) == (6, 4, 0.5)


def routing(path):
    with sqlite3.connect(path) as db:
        db.executescript(
            "CREATE TABLE agent_groups(id, name, folder); CREATE TABLE messaging_groups(id, name); CREATE TABLE messaging_group_agents(id, messaging_group_id, agent_group_id, session_mode, priority, created_at);"
            "INSERT INTO agent_groups VALUES('ag1','jo','f1'),('ag2','kim','f2'); INSERT INTO messaging_groups VALUES('m1','The room'),('m2','Second');"
            "INSERT INTO messaging_group_agents VALUES('1','m2','ag1','x',1,'b'),('2','m1','ag1','x',5,'a');"
        )


def test_chat_cells(spark, tmp_path):
    routing(tmp_path / "v2.db")
    at = "2026-07-05T09:00:00Z"
    line = lambda kind, content, **more: {"type": kind, "timestamp": at, "message": {"role": kind, "content": content} | more.pop("message", {})} | more
    write(
        tmp_path / "v2-sessions/ag1/x/s1.jsonl",
        line("user", '<message from="a">no, that is wrong &amp; bad</message>'),
        line("assistant", [{"type": "text", "text": "t"}], message={"id": "r1", "model": "m", "usage": {"input_tokens": 10, "output_tokens": 5}}),
        line("assistant", [{"type": "tool_use", "id": "u1", "name": "Bash", "input": {"a": 1}}], message={"id": "r1", "usage": {"input_tokens": 10, "output_tokens": 5}}),
        line("user", [{"type": "tool_result", "tool_use_id": "u1", "is_error": True, "content": "bad"}]),
        line("user", "summary", isCompactSummary=True),
        line("user", "meta", isMeta=True),
    )
    write(tmp_path / "v2-sessions/ag9/x/s2.jsonl", line("user", "x"))
    r = R.ChatCells(spark, [str(tmp_path)], str(tmp_path / "v2.db"))
    assert sorted((x["session_id"], x["persona"], x["channel"]) for x in r.sessions().collect()) == [("s1", "jo", "The room, Second"), ("s2", "ag9", None)]
    assert said(r)[:3] == [("user", "no, that is wrong & bad", None), ("assistant", "t", None), ("tool", {"success": False, "error": "bad"}, "Bash")]
    assert kinds(r)[:4] == [("user_message", None, None), ("llm_response", None, None), ("tool_call", "Bash", '{"a":1}'), ("compaction", None, None)]
    assert [(x["input_tokens"], x["output_tokens"], x["cost"]) for x in r.usage().collect()] == [(10, 5, None)]
    assert [x["session_id"] for x in R.ChatCells(spark, [str(tmp_path)], str(tmp_path / "v2.db"), include=["jo"]).sessions().collect()] == ["s1"]
    assert R.ChatCells(spark, [str(tmp_path)], str(tmp_path / "v2.db"), exclude=["jo"]).sessions().count() == 0


def test_generic_files(spark, tmp_path):
    write(tmp_path / "a/log.jsonl", {"_session": {"persona": "p", "channel": "c"}}, {"role": "user", "content": "x"}, {"other": 1})
    r = R.GenericFiles(spark, [str(tmp_path)], id_from="parent", reader="mine")
    s = r.sessions().first()
    assert (s["reader"], s["session_id"], s["persona"], s["channel"]) == ("mine", "a", "p", "c")
    assert said(r) == [("user", "x", None)]


def test_missing_folder(spark, tmp_path):
    r = R.SessionFolders(spark, [str(tmp_path / "none")])
    assert r.sessions().count() == r.messages().count() == r.events().count() == 0


def test_archive(spark):
    pages = {
        "/machines": {"machine_labels": {"m1": "Laptop"}},
        "/sessions?limit=500": {"sessions": [{"id": "codex:abc", "agent": "codex", "machine": "m1", "ended_at": "2026-07-05T09:00:00+00:00"}], "next_cursor": "n 1"},
        "/sessions?limit=500&cursor=n%201": {"sessions": [{"id": "x:old", "agent": "x", "machine": "m2", "ended_at": "2020-01-01T00:00:00+00:00"}]},
        "/sessions/codex%3Aabc/messages?limit=500&from=0": {"messages": [{"role": "user", "content": "q"}, {"role": "system", "content": "s"}], "count": 2, "last_ordinal": 1},
        "/sessions/x%3Aold/messages?limit=500&from=0": {"messages": []},
        "/sessions/codex%3Aabc/usage": {"has_token_data": True, "has_cost": True, "cost": {"microdollars": 2500000}, "total_output_tokens": 7, "breakdown": [{"model": "m", "input_tokens": 5, "has_cost": True, "cost": {"microdollars": 2500000}}]},
    }
    r = archive.Archive(spark, pages.get, datetime(2026, 7, 1, tzinfo=UTC), datetime(2026, 7, 6, tzinfo=UTC))
    s = r.sessions().collect()
    assert [(x["session_id"], x["machine"], x["dedupe_key"]) for x in s] == [("codex:abc", "Laptop", "abc")]
    assert said(r) == [("user", "q", None)]
    assert [(str(x["cost"]), x["input_tokens"]) for x in r.usage().collect()] == [("2.500000000000", 5)]  # the session's cost, once
    assert [str(x["cost"]) for x in r.model_costs().collect()] == ["2.500000000000"]
    with pytest.raises(ValueError):
        archive.checked_url("https://example.com/")
    assert archive.checked_url("http://127.0.0.1:8080/") == "http://127.0.0.1:8080"


def test_daily_usage(spark):
    doc = {"schema_version": 6, "daily": [{"date": "2026-07-01", "totalCost": {"microdollars": 3}, "agentBreakdowns": [{"agent": "a", "cost": {"microdollars": 1}}, {"agent": "a", "cost": {"microdollars": 2}}], "modelBreakdowns": []}]}
    assert sorted((r["dim"], r["name"], str(r["cost"])) for r in archive.daily_usage(spark, doc).collect()) == [("agent", "a", "0.000003"), ("total", "all", "0.000003")]
    with pytest.raises(ValueError):
        archive.daily_usage(spark, {"schema_version": 5, "daily": []})


def test_worker_evidence(spark):
    d = {"id": "d1", "harness": "codex", "seat": "s", "host": "h", "pane": "%4", "worktree": "/w", "dispatched_at": "2026-07-05T09:00:00Z"}
    doc = {
        "issue": {"uid": "u1", "qualified_id": "p#1", "status": "open", "metadata": {"dispatch": d, "kickoff": {"id": "d1", "state": "failed", "detail": "dialog:dir-trust:/w", "at": "2026-07-05T09:01:00Z"}}},
        "comments": [{"created_at": "2026-07-05T09:02:00Z", "body": "quote: review: reviewer --gpt"}, {"created_at": "2026-07-05T09:03:00Z", "body": "review: reviewer x --gpt\nmore"}, {"created_at": "2026-07-05T09:04:00Z", "body": "review: reviewer --gpt"}],
    }
    found = workers.dispatches(spark.createDataFrame([(json.dumps(doc),)], "t string").select(F.parse_json("t").alias("v")))
    since = F.lit("2026-07-01").cast("timestamp")
    log = spark.createDataFrame([("log", "2026-07-05T10:00:00\thost1\texec\tmain\tx"), ("log", "2026-07-05T11:00:00\thost1\texec\tmain"), ("log", "bad\thost1\texec\tmain"), ("log", "2026-07-05T11:00:00\thost1\texec\tseat-1")], "path string, line string")
    empty = lambda schema: spark.createDataFrame([], schema)
    owners = spark.createDataFrame([("h", "default", "4", "d1", "2026-07-05")], "host string, socket string, pane string, id string, at string")
    rollouts = spark.createDataFrame([("/w", "se", "2026-07-05 09:01:00", "cli", "2026-07-05 09:02:00", "r.jsonl")], "cwd string, session string, started string, originator string, first_turn string, path string").withColumns({"started": F.col("started").cast("timestamp"), "first_turn": F.col("first_turn").cast("timestamp")})
    live = spark.createDataFrame([("default", "4", "/w")], "socket string, pane string, cwd string")
    states = empty("name string")
    parts = [workers.trust_prompts(found, since), workers.same_model_reviews(found, since, "reviewer"), workers.allocations(log, since, True), workers.missing_hook_states(found, owners, states, rollouts, live, since, "h", True)]
    rows = workers.evidence(*parts, parts[0]).orderBy("session_id").collect()
    assert [r["session_id"] for r in rows] == ["allocation:host1:2026-07-05:codex_fallback_main", "d1:codex_missing_hook_state", "d1:codex_trust_prompt", "d1:same_model_review"]
    assert "2 exec row(s)" in rows[0]["detail"] and str(rows[3]["at"]) == "2026-07-05 09:03:00"
    held = spark.createDataFrame([("p-1-default-4.ended.1",)], "name string")
    assert workers.missing_hook_states(found, owners, held, rollouts, live, since, "h", True).count() == 0
    # The older name counts, too, and a state of one row drops all rows of its id; what repeats in other tables gives no more rows.
    older = spark.createDataFrame([("p-1-4",)], "name string")
    again = found.union(found.withColumn("reference", F.lit("p#2")))
    assert workers.missing_hook_states(again, owners, older, rollouts, live, since, "h", True).count() == 0
    assert workers.missing_hook_states(found, owners, older.withColumn("name", F.lit("p-2-4")), rollouts.union(rollouts), live.union(live), since, "h", True).count() == 1
    assert workers.as_messages(workers.evidence(*parts)).count() == 4


REGISTER = """# Register
## Standing

| Workaround | Hosts | Tracking | Owner | Added | Expires |
|---|---|---|---|---|---|
| pin x | h1 | proj#ab12 | jo | 2026-07-01 | 2026-07-20 |
"""


def test_register(tmp_path):
    p = tmp_path / "r.md"
    p.write_text(REGISTER)
    day = lambda d: datetime(2026, 7, d).date()
    assert registers.check([str(p)], day(20)).alerts == 0
    c = registers.check([str(p), str(tmp_path / "none.md")], day(21))
    assert (c.standing, len(c.expired), len(c.problems)) == (1, 1, 1)
    for bad in (REGISTER.replace("proj#ab12", "ab12"), REGISTER.replace("2026-07-20", "2026-09-20"), REGISTER.replace("Owner", "Who"), REGISTER.replace("## Standing", "## Other")):
        with pytest.raises(ValueError):
            registers.parse(bad)


def test_storms_from_files(spark, tmp_path):
    rows = [event("context:compaction", m) for m in (1, 4, 8)] + [event("tool:pre", 10 + i, tool_name="bash", tool_input={"c": 1}) for i in range(4)]
    write(tmp_path / "p/sessions/s1/events.jsonl", *rows)
    found = health.health_patterns(R.SessionFolders(spark, [str(tmp_path)]).events().withColumn("session_id", F.lit("s1")))
    assert sorted(r["evidence"] for r in found.collect()) == ["3 compactions 09:01-09:08", "`bash` x4 identical arguments 09:10-09:13"]


def test_hook_trust(tmp_path):
    p = tmp_path / "hooks.json"
    p.write_text(json.dumps({"hooks": {"SessionStart": [{"hooks": [{"type": "command", "command": "/usr/bin/python3 run startup"}, {"type": "command", "command": "/usr/bin/python3 run dispatch-state"}]}]}}))
    key = workers.hook_key(p)
    assert key == f"{p.resolve()}:session_start:0:1"
    assert workers.hook_trusted(f'[hooks.state."{key}"]\ntrusted_hash = "x"', key) and not workers.hook_trusted("", key)
    assert workers.hook_key(tmp_path / "none.json") is None
