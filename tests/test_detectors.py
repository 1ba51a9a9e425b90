import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import detectors

SCHEMA = "session_id string, seq long, role string, c string, name string"


def messages(spark, *rows, session="s1"):
    """Rows are (role, content) or (role, content, name); content is any JSON value."""
    data = [(session, i, r[0], None if r[1] is None else json.dumps(r[1]), r[2] if len(r) > 2 else None) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).withColumn("content", F.parse_json("c")).drop("c")


def turns(spark, *said):
    rows = []
    for i, text in enumerate(said):
        rows += [(f"s{i}", 0, "assistant", '"working"', None), (f"s{i}", 1, "user", json.dumps(text), None), (f"s{i}", 2, "assistant", '"ok"', None)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("content", F.parse_json("c")).drop("c")


POSITIVE = [
    "no, keep last week's layout",
    "please stop renaming columns",
    "row nine has an incorrect total",
    "and do not format empty cells",
    "upload broken once again, sorry",
    "actually put it in a footer instead",
    "by margin I meant the outer one",
    "labels shouldn’t overlap an axis",
    "undo the last two merges",
    "you missed three of my notes",
]
NEGATIVE = [
    "this chart reads well, keep going",
    "is the right column the wrong one?",
    "export it again when ready",
    "incorrect",
    "<system-reminder> the total is wrong </system-reminder>",
    "put a legend beneath the plot",
    "actually the blue one looks fine",
    "y" * 190 + " is incorrect here",
    "we could publish tomorrow",
]


def test_corrections_are_exactly_the_corrective_turns(spark):
    found = detectors.corrections(turns(spark, *POSITIVE, *NEGATIVE))
    assert {r["context"] for r in found.collect()} == set(POSITIVE)


def test_correction_needs_both_neighbours_and_no_tool_result(spark):
    text = "row nine has an incorrect total"
    alone = messages(spark, ("user", text), ("assistant", "ok"))
    block = messages(spark, ("assistant", "x"), ("user", [{"type": "tool_result", "content": text}]), ("assistant", "y"))
    assert detectors.corrections(alone).count() == 0
    assert detectors.corrections(block).count() == 0


def test_workarounds_first_match_whole_words(spark):
    found = detectors.workarounds(
        messages(
            spark,
            ("assistant", "A temporary fix for now"),
            ("assistant", "The hackathon TODOs.md file"),
            ("assistant", [{"type": "text", "text": "one"}, {"type": "text", "text": "quick fix here"}]),
            ("assistant", "## Files Examined\nTODO"),
            ("assistant", "**INDEPENDENT CODE REVIEW PASSED**\nhack"),
            ("assistant", "---\nname: a\ndescription: b\n---\nTODO"),
            ("assistant", "---\nname: a\n---\nTODO later"),
            ("user", "for now"),
        )
    )
    assert [(r["seq"], r["pattern"]) for r in found.orderBy("seq").collect()] == [(0, "for now"), (2, "quick fix"), (6, "TODO")]


def test_deferrals(spark):
    found = detectors.deferrals(messages(spark, ("assistant", "I'll come back to this"), ("assistant", "deferring it until later"), ("assistant", "let's circle back on it"), ("assistant", "done")))
    assert [r["item"] for r in found.orderBy("seq").collect()] == ["come back later", "deferring", "circle back"]


def result(**fields):
    return ("tool", fields, "bash")


EMITTED = [
    ({"success": False, "error": ["boom", "x"]}, "boom"),
    ({"success": False, "error": {"message": "no"}}, '{"message":"no"}'),
    ({"success": False, "error": None, "output": {"returncode": 1, "stdout": "", "stderr": "trace"}}, None),
    ({"success": False, "error": None, "output": {"returncode": "1"}}, None),
    ({"success": False, "output": {"returncode": 2, "note": "x"}}, None),
    ({"success": False, "error": "Command timed out after 30 seconds", "output": "half a log"}, "Command timed out after 30 seconds"),
    ({"success": False, "error": [], "output": None}, None),
]
SUPPRESSED = [
    {"success": False, "error": None, "output": {"returncode": 1, "stdout": "", "stderr": " "}},
    {"success": False, "error": {"message": "Command timed out after 30 seconds"}, "output": "Command timed out after 30 seconds"},
    {"success": False, "message": "command timed out after 1 second."},
    {"success": "false", "error": "not a boolean"},
    {"success": 0, "error": "not a boolean"},
    {"error": "no success field"},
]


@pytest.mark.parametrize("as_text", [False, True])
def test_tool_errors(spark, as_text):
    rows = [("tool", json.dumps(d) if as_text else d, "bash") for d, _ in EMITTED] + [("tool", json.dumps(d) if as_text else d, "bash") for d in SUPPRESSED]
    found = detectors.errors(messages(spark, *rows)).orderBy("seq").collect()
    assert [r["seq"] for r in found] == list(range(len(EMITTED)))
    for row, (_, message) in zip(found, EMITTED):
        assert message is None or row["message"] == message
        assert row["tool_name"] == "bash" and not row["call_level"]


def test_mode_denials_are_expected(spark):
    denied = [{"success": False, "output": {"status": "denied"}}, {"success": False, "output": {"denied_mode": None}}, {"success": False, "error": {"code": "switch_denied"}}, {"success": False, "code": "clear_denied"}]
    rows = [("tool", d, "mode") for d in denied] + [("tool", {"success": False, "error": "bad transition"}, "mode"), ("tool", denied[0], "other")]
    found = detectors.errors(messages(spark, *rows)).orderBy("seq").collect()
    assert [r["seq"] for r in found] == [4, 5]


def use(i, name):
    return ("assistant", [{"type": "tool_use", "id": i, "name": name, "input": {}}])


def answer(i, text, error=True):
    return ("user", [{"type": "tool_result", "tool_use_id": i, "is_error": error, "content": text}])


def test_block_errors(spark):
    found = detectors.errors(
        messages(
            spark,
            use("a", "Edit"),
            answer("a", "old text not in file"),
            answer("a", "old text not in file"),  # a copy
            answer("zz", "unknown call"),
            use("b", "Bash"),
            answer("b", "Exit code 1"),
            use("c", "Bash"),
            answer("c", "Exit code 2\ntraceback"),
            use("d", "WebFetch"),
            answer("d", [{"type": "text", "text": "The server returned HTTP 403 Forbidden."}], None),
            use("e", "WebFetch"),
            answer("e", "a page that says HTTP 500", None),
            ("user", [{"type": "tool_result", "is_error": True, "content": "x"}, {"type": "tool_result", "is_error": True, "content": "x"}]),
        )
    ).orderBy("seq", "block")
    assert [(r["tool_name"], r["message"], r["call_level"]) for r in found.collect()] == [
        ("Edit", "old text not in file", False),
        ("unknown", "unknown call", False),
        ("Bash", "Exit code 2\ntraceback", True),
        ("WebFetch", "The server returned HTTP 403 Forbidden.", True),
        ("unknown", "x", False),
        ("unknown", "x", False),
    ]


def test_name_is_the_latest_before_the_result(spark):
    found = detectors.errors(messages(spark, answer("a", "early"), use("a", "Late")))
    assert [r["tool_name"] for r in found.collect()] == ["unknown"]


def test_priority_alerts(spark):
    rows = [(s, "t", False) for s in ("a", "b", "b", "c")] + [(s, "two", False) for s in ("a", "b")]
    rows += [(s, "sub", False) for s in ("a", "b", "agent-0f", "0" * 16 + "-x_y")] + [(s, "call", True) for s in "abc"] + [(s, "same_model_review", False) for s in "abc"]
    found = detectors.priority_alerts(spark.createDataFrame(rows, "session_id string, tool_name string, call_level boolean"))
    assert [(r["tool_name"], r["sessions"]) for r in found.collect()] == [("t", ["a", "b", "c"])]


def test_empty_tables(spark):
    none = messages(spark, ("user", "x")).filter("false")
    for f in (detectors.corrections, detectors.errors, detectors.workarounds, detectors.deferrals):
        assert f(none).count() == 0
