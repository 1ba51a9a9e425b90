from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import health, windows

T0 = datetime(2026, 7, 5, 9, 0)
SCHEMA = "session_id string, seq long, kind string, ts timestamp, tool_name string, detail string"


def series(spark, *rows, session="s"):
    """Rows are (minute, kind[, tool, detail])."""
    return spark.createDataFrame([(session, i, r[1], T0 + timedelta(minutes=r[0]), *(r[2:] or (None, None))) for i, r in enumerate(rows)], SCHEMA)


def evidence(df):
    return [r["evidence"] for r in df.orderBy("kind_order", "at").collect()]


def test_compaction_storm_edges(spark):
    storm = lambda *m: evidence(health.compaction_storms(series(spark, *[(x, "compaction") for x in m])))
    assert storm(1, 4, 8) == ["3 compactions 09:01-09:08"]
    assert storm(0, 5, 10) == ["3 compactions 09:00-09:10"]
    assert storm(0, 5, 10.5) == []
    assert storm(0, 1) == []
    assert storm(0, 1, 2, 30, 31, 33, 36) == ["4 compactions 09:30-09:36"]
    assert storm(0, 1, 2, 30, 31, 32) == ["3 compactions 09:00-09:02"]
    assert storm(0, 0, 0) == ["3 compactions 09:00-09:00"]


def test_resume_storm(spark):
    assert evidence(health.resume_storms(series(spark, (0, "resume"), (10, "resume"), (25, "resume")))) == ["3 resumes 09:00-09:25"]
    assert evidence(health.resume_storms(series(spark, (0, "resume"), (10, "resume"), (31, "resume")))) == []


def test_stuck_loops(spark):
    call = lambda m, tool="bash", d="{}": (m, "tool_call", tool, d)
    rows = [call(0), (0.5, "llm_response"), call(1), call(2), call(3), call(4, "grep"), call(5, "bash", "x"), *[call(6 + i, None, None) for i in range(5)]]
    assert evidence(health.stuck_loops(series(spark, *rows))) == ["`bash` x4 identical arguments 09:00-09:03", "`unknown` x5 identical arguments 09:06-09:10"]
    assert evidence(health.stuck_loops(series(spark, call(0), call(1), call(2)))) == []


def test_runaway(spark):
    calls = lambda n, start=0: [(start + i / 60, "tool_call", "t", str(i)) for i in range(n)]
    assert evidence(health.runaways(series(spark, *calls(149)))) == []
    assert evidence(health.runaways(series(spark, *calls(150)))) == ["150 tool calls without a user message 09:00-09:02"]
    split = [*calls(100), (3, "user_message"), *calls(100, 4)]
    assert evidence(health.runaways(series(spark, *split))) == []
    assert evidence(health.runaways(series(spark, *calls(200), session="agent-ab12"))) == []


def test_patterns_in_order(spark):
    rows = [(1, "compaction"), (4, "compaction"), (8, "compaction")] + [(10 + i, "tool_call", "bash", "{}") for i in range(4)]
    found = health.health_patterns(series(spark, *rows)).orderBy("kind_order").collect()
    assert [r["pattern_kind"] for r in found] == ["compaction_storm", "stuck_loop"]
    assert found[0]["description"] == "compaction storm: 3 compactions within 10 minutes"
    assert found[1]["description"] == "stuck loop: `bash` called 4 times with identical arguments"


def test_gaps_and_marks(spark):
    df = spark.createDataFrame([("a", 2), ("a", 5), ("b", 1), ("b", 2)], "source string, n long")
    assert sorted(tuple(r) for r in windows.missing_numbers(df, "source", "n").collect()) == [("a", 1), ("a", 3), ("a", 4)]
    marks = windows.contiguous_mark(df, "source", "n", F.col("n") == 5)
    assert sorted(tuple(r) for r in marks.collect()) == [("a", 2), ("b", 2)]
