from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.plans import catalog
from tidemark.functions import hashing
from tidemark.functions import text as X


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_fnv(spark):
    assert one(spark, hashing.fnv1a64, "", "a", "foobar") == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]


def test_quoting(spark):
    assert one(spark, X.quoted, "it's", "a\\b\n\t\x07") == ["'it\\'s'", "'a\\\\b\\n\\t\\x07'"]


def test_text(spark):
    assert one(spark, X.trim_all, "\n  x ", "") == ["x", ""]
    assert one(spark, X.session_role, "abc_explore", "abc", "abc_") == ["explore", None, None]
    assert one(spark, X.trailing_uuid, "rollout-5c6d7e8f-1234-4abc-8def-90a1b2c3d4e5", "x", "é5c6d7e8f-1234-4abc-8def-90a1b2c3d4e5") == ["5c6d7e8f-1234-4abc-8def-90a1b2c3d4e5", None, None]
    assert one(spark, X.without_agent, "codex:1", "plain", "x:") == ["1", "plain", "x:"]
    assert one(spark, X.envelope_text, '<context/><message id="1"> a &lt;b&gt; </message><message>c &amp;lt;</message>', " bare ", "<message> </message>") == ["a <b>\nc &lt;", "bare", ""]
    assert one(spark, X.backticked, "x `bash` y `z`", "none") == ["bash", None]
    assert one(spark, X.display_safe, "a`b\nc") == ["a'b c"]
    assert one(spark, lambda x: X.truncated_marked(x, 3), "abc", "abcd") == ["abc", "abc … [truncated]"]
    assert one(spark, lambda x: X.glob_match(x, "hook-*"), "hook-a", "hook") == [True, False]


def test_times(spark):
    f = lambda x: X.parsed_time(x).cast("string")
    assert one(spark, f, "2026-07-05T09:01:02Z", "2026-07-05T09:01:02.123456789+02:00", "2026-07-05T09:01:02", "2026-07-05", "2026-07-05 09:00:00", "x") == [
        "2026-07-05 09:01:02", "2026-07-05 07:01:02.123456", "2026-07-05 09:01:02", None, None, None
    ]


def test_money(spark):
    df = spark.createDataFrame([(Decimal("4.2"),), (Decimal("0.0003"),), (Decimal("68.89777650"),), (Decimal(3),)], "x decimal(28,12)")
    assert [r[0] for r in df.select(X.dollars(F.col("x"))).collect()] == ["$4.20", "$0.0003", "$68.8977765", "$3.00"]
    assert one(spark, lambda x: X.micro_dollars(x.cast("long")).cast("string"), "441835983") == ["441.835983"]


def test_every_document_has_a_key(spark, tmp_path):
    """Texts with white space beyond ASCII, wherever it stands, and null texts keep their row."""
    signs = "\x0b\x1c\x1f\x85       　"
    texts = [f"a{s}b" for s in signs] + ["x" * 300 + " ", None, "a b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.k for r in catalog.QUERIES["idempotency_keys"](spark, str(tmp_path)).collect()}
    assert sorted(found) == list(range(len(texts)))
    for i, t in enumerate(texts[: len(signs)]):
        expected = t if t[1] in "\x1c\x1f" else "a-b"  # separators U+001C-1F are not Unicode white space
        assert found[i] == expected, (i, t, found[i])
    assert found[len(signs)] == "x" * 240 and found[len(signs) + 1] is None and found[len(signs) + 2] == "a-b"
