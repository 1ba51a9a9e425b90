"""More operators as queries with SQL twins: detectors with their own patterns, readers, signals, worker evidence.

Inputs are made from the driver's tables. Texts with planted phrases take turns over
`conversations`, so that every pattern and exception is met; readers get lines built
from the tables instead of files, and run all they do behind the reading.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import content as C
from tidemark.functions import hashing
from tidemark.functions import text as X
from tidemark.operators import detectors, health, ledger, rollup, signals
from tidemark.plans.catalog import TEST_LIMITS, _storm_sql, query, read, session_events, sql_stamp, stamp
from tidemark.sources import base, segments, transcripts, workers

#: Phrases that take turns in front of texts: what detectors find, and what they must pass over.
PHRASES = (
    "no, take the first one", "please stop here", "that is incorrect", "keep going", "you missed a step", "for now this is hardcoded", "a quick fix", "TODO: tidy up",
    "I'll come back to that", "deferring it until Monday", "in the next session", "undo that <system-reminder>", "Sounds good!", "is it wrong?", "revert it", "a hacky workaround",
    "## Files Examined\nTODO", "**INDEPENDENT CODE REVIEW PASSED**\nfor now", "# Memory Index\nhack", "---\nname: a\ndescription: b\n---\nTODO", "---\nname: a\n---\nFIXME", "leave it for later", "circle back to it", "same error again",
)
#: How much of the text follows the phrase.
TAILS = (0, 40, 400)


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_PHRASE_SQL = "[" + ", ".join(_quote(p).replace("\n", "' || chr(10) || '") for p in PHRASES) + "]"
PLANTED = f"""planted AS (SELECT conv_id, turn, role, CASE (conv_id + turn) % 3 WHEN 0 THEN p WHEN 1 THEN p || ' ' || substr(t, 1, 40) ELSE p || ' ' || substr(t, 1, 400) END AS said
FROM (SELECT *, {_PHRASE_SQL}[CAST((conv_id * 5 + turn) % {len(PHRASES)} AS INT) + 1] AS p, coalesce(text, '') AS t FROM conversations))"""


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), ((F.col("conv_id") * 5 + F.col("turn")) % len(PHRASES)).cast("int") + 1)
    text, third = F.coalesce("text", F.lit("")), (F.col("conv_id") + F.col("turn")) % 3
    said = F.when(third == 0, phrase).when(third == 1, F.concat(phrase, F.lit(" "), F.substring(text, 1, 40))).otherwise(F.concat(phrase, F.lit(" "), F.substring(text, 1, 400)))
    return c.select("conv_id", "turn", "role", said.alias("said"))


def planted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("said").cast("variant").alias("content"), F.lit(None).cast("string").alias("name"))


def _sql_pattern(p: str) -> str:
    return _quote(p.replace("(?i)", "").replace("(?is)", "").replace("(?im)", ""))


def _matches(x: str, p: str) -> str:
    flags = "i" + ("s" if p.startswith("(?is)") else "") + ("m" if p.startswith("(?im)") else "") if p.startswith("(?i") else "c"
    return f"regexp_matches({x}, {_quote('(?' + flags + ')') if flags != 'c' else _quote('')} || {_sql_pattern(p)})"


def _any(x: str, patterns: Sequence[str]) -> str:
    return "(" + " OR ".join(_matches(x, p) for p in patterns) + ")"


def _label(x: str, patterns: Sequence[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {_matches(x, p)} THEN {_quote(n)}" for n, p in patterns) + " END"


_MARKED = "(" + " OR ".join(f"contains(said, {_quote(m)})" for m in detectors.SYSTEM_MARKS) + ")"
_TRIM = r"regexp_replace(said, '^\s+|\s+$', '', 'g')"
_CONFIRMS = f"(lower(regexp_replace({_TRIM}, '[.!]+$', '')) IN ({', '.join(map(_quote, detectors.CONFIRMATIONS))}))"
_REVIEW = f"(starts_with(ltrim(said), {_quote(detectors.REVIEW_HEADING)}) OR {_matches('said', detectors.REVIEW_VERDICT)})"
_MEMORY = f"""(starts_with(said, {_quote(detectors.MEMORY_HEADING)}) OR (starts_with(said, '---' || chr(10)) AND list_position(string_split(said, chr(10))[2:], '---') > 0
  AND len(list_filter(string_split(said, chr(10))[2:list_position(string_split(said, chr(10))[2:], '---')], lambda x: starts_with(x, 'name:'))) > 0
  AND len(list_filter(string_split(said, chr(10))[2:list_position(string_split(said, chr(10))[2:], '---')], lambda x: starts_with(x, 'description:'))) > 0))"""


@query(f"WITH {PLANTED} SELECT conv_id, turn, {_MARKED} AS marked, {_REVIEW} AS review, coalesce({_MEMORY}, false) AS memory, {_CONFIRMS} AS confirms FROM planted")
def text_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.col("said")
    return planted(spark, sf_dir).select("conv_id", "turn", detectors.has_system_mark(said).alias("marked"), detectors.is_review(said).alias("review"), detectors.is_memory_file(said).alias("memory"), detectors.is_confirmation(said).alias("confirms"))


_CORRECTS = f"(octet_length(encode(said)) <= 200 AND octet_length(encode({_TRIM})) >= 15 AND NOT {_MARKED} AND NOT ends_with({_TRIM}, '?') AND NOT {_CONFIRMS} AND {_any(_TRIM, detectors.CORRECTIONS)})"


@query(f"WITH {PLANTED} SELECT conv_id, turn, {_CORRECTS} AS corrects FROM planted")
def correction_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select("conv_id", "turn", detectors.is_correction(F.col("said")).alias("corrects"))


@query(
    f"""WITH {PLANTED}, p AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM planted WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, {_TRIM} AS context FROM p WHERE role = 'user' AND before = 'assistant' AND after = 'assistant' AND {_CORRECTS}"""
)
def corrections_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.corrections(planted_messages(spark, sf_dir))


def _labels_sql(patterns: Sequence[tuple[str, str]], columns: str) -> str:
    return f"""WITH {PLANTED}, l AS (SELECT *, {_label("said", patterns)} AS label FROM planted WHERE role = 'assistant')
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, {columns} FROM l WHERE label IS NOT NULL AND NOT {_MARKED} AND NOT {_REVIEW} AND NOT coalesce({_MEMORY}, false)"""


@query(_labels_sql(detectors.WORKAROUNDS, "label AS pattern, substr(said, 1, 200) AS context"))
def workarounds_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.workarounds(planted_messages(spark, sf_dir))


@query(_labels_sql(detectors.DEFERRALS, "label AS item"))
def deferrals_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.deferrals(planted_messages(spark, sf_dir))


# Tool results: shapes that take turns over `events`.

RESULTS = (
    '{"error":["boom",2],"success":false}', '{"error":{"message":"no KEY"},"success":false}', '{"error":null,"output":{"returncode":1,"stderr":"trace","stdout":""},"success":false}',
    '{"error":null,"output":{"returncode":1,"stderr":" ","stdout":""},"success":false}', '{"error":"Command timed out after 30 seconds","output":"half","success":false}',
    '{"error":"Command timed out after KEY seconds","output":null,"success":false}', '{"error":"x","success":true}', '{"error":"x","success":"false"}', '{"code":"clear_denied","success":false}',
    "oops", '{"output":{"denied_mode":null},"success":false}', '{"message":"command timed out after 1 second.","success":false}', '{"message":7,"success":false}', '{"error":"a","message":"b","success":false}',
    '{"error":{"code":"KEY_denied"},"success":false}', '{"error":null,"output":{"returncode":"1"},"success":false}',
)
TOOLS = ("bash", "mode", "fetch")
_RESULT_SQL = "[" + ", ".join(map(_quote, RESULTS)) + "]"
RESULT_ROWS = f"""results AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS session_id, ['bash', 'mode', 'fetch'][CAST(event_id % 3 AS INT) + 1] AS tool,
  replace({_RESULT_SQL}[CAST(event_id % {len(RESULTS)} AS INT) + 1], 'KEY', coalesce(json_extract_string(props, '$.k'), '0')) AS j FROM events),
parsed AS (SELECT *, CASE WHEN json_valid(j) THEN CAST(j AS JSON) END AS d FROM results),
parts AS (SELECT *, json_extract(d, '$.error') AS e, json_extract(d, '$.message') AS m, json_extract(d, '$.output') AS o, coalesce(json_type(d, '$.error'), 'NULL') AS et, coalesce(json_type(d, '$.message'), 'NULL') AS mt,
  coalesce(json_type(d, '$.output'), 'NULL') AS ot, json_type(d, '$.error.message') AS it, json_extract_string(d, '$.output.returncode') AS rc, json_type(d, '$.output.returncode') AS rct FROM parsed),
kinds AS (SELECT *, CASE WHEN et = 'NULL' AND mt = 'NULL' THEN 'absent' WHEN (et = 'NULL' AND mt = 'VARCHAR') OR (mt = 'NULL' AND (et = 'VARCHAR' OR it = 'VARCHAR')) THEN 'text' ELSE 'unrecognized' END AS kind,
  CASE WHEN et = 'NULL' THEN CASE WHEN mt IN ('VARCHAR', 'UBIGINT') THEN json_extract_string(d, '$.message') END WHEN et = 'VARCHAR' THEN json_extract_string(d, '$.error') ELSE json_extract_string(d, '$.error.message') END AS said FROM parts)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    shape = F.element_at(F.array(*[F.lit(r) for r in RESULTS]), (F.col("event_id") % len(RESULTS)).cast("int") + 1)
    tool = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (F.col("event_id") % 3).cast("int") + 1)
    j = F.replace(shape, F.lit("KEY"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")))
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), tool.alias("tool_name"), j.alias("j"))


@query(f"WITH {RESULT_ROWS} SELECT seq, kind, said FROM kinds WHERE d IS NOT NULL")
def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, text = detectors.error_text()
    shaped = detectors.with_shape(results(spark, sf_dir).withColumn("data", F.try_parse_json("j")).filter("data IS NOT NULL"))
    return shaped.select("seq", kind.alias("kind"), text.alias("said"))


_DENIED = "(tool = 'mode' AND (coalesce(json_extract_string(d, '$.output.status') = 'denied', false) OR json_exists(d, '$.output.denied_mode') OR coalesce(ends_with(json_extract_string(d, '$.error.code'), '_denied'), false) OR coalesce(ends_with(json_extract_string(d, '$.code'), '_denied'), false)))"
_EMPTY = r"""(tool = 'bash' AND len(list_filter(json_keys(d), lambda k: k NOT IN ('success', 'error', 'output', 'message'))) = 0 AND et IN ('NULL', 'VARCHAR', 'OBJECT')
  AND (et <> 'OBJECT' OR len(list_filter(json_keys(d, '$.error'), lambda k: k <> 'message')) = 0) AND (ot <> 'OBJECT' OR len(list_filter(json_keys(d, '$.output'), lambda k: k NOT IN ('returncode', 'stdout', 'stderr'))) = 0)
  AND CASE ot WHEN 'NULL' THEN true WHEN 'VARCHAR' THEN trim(json_extract_string(d, '$.output')) = '' OR regexp_matches(json_extract_string(d, '$.output'), '(?i)^command timed out after \d+ seconds?\.?$')
    ELSE coalesce(rct IN ('UBIGINT', 'BIGINT'), true) AND trim(coalesce(json_extract_string(d, '$.output.stdout'), '')) = '' AND trim(coalesce(json_extract_string(d, '$.output.stderr'), '')) = '' END
  AND ((kind = 'text' AND regexp_matches(trim(said), '(?i)^command timed out after \d+ seconds?\.?$')) OR (kind = 'absent' AND coalesce(rct IN ('UBIGINT', 'BIGINT') AND rc <> '0', false))))"""


@query(f"WITH {RESULT_ROWS} SELECT seq, {_DENIED} AS denied, coalesce({_EMPTY}, false) AS bare FROM kinds WHERE d IS NOT NULL")
def expected_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    shaped = detectors.with_shape(results(spark, sf_dir).withColumn("data", F.try_parse_json("j")).filter("data IS NOT NULL"))
    return shaped.select("seq", F.coalesce(detectors.is_mode_denial(), F.lit(False)).alias("denied"), detectors.is_empty_shell_failure().alias("bare"))


@query(
    f"""WITH {RESULT_ROWS} SELECT session_id, seq, tool AS tool_name, false AS call_level,
  CASE WHEN et = 'ARRAY' THEN json_extract_string(d, '$.error[0]') WHEN et = 'VARCHAR' THEN json_extract_string(d, '$.error') WHEN et <> 'NULL' THEN CAST(e AS VARCHAR) ELSE j END AS message
FROM kinds WHERE json_type(d, '$.success') = 'BOOLEAN' AND json_extract_string(d, '$.success') = 'false' AND NOT {_DENIED} AND NOT coalesce({_EMPTY}, false)"""
)
def tool_errors_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).select("session_id", "seq", F.lit("tool").alias("role"), F.col("j").cast("variant").alias("content"), F.col("tool_name").alias("name"))
    return detectors.errors(rows).drop("block")


ANSWERS = ("no such file", "Exit code 3", "Exit code 2\ntrace", "<tool_use_error>bad</tool_use_error>", "The server returned HTTP 403 here", "Permission for this command was denied by policy")
BLOCKS = f"""blocks AS (SELECT conv_id, turn, role, ['Bash', 'Edit', 'WebFetch'][CAST(conv_id % 3 AS INT) + 1] AS name, [{", ".join(_quote(a).replace(chr(10), "' || chr(10) || '") for a in ANSWERS)}][CAST((conv_id + turn) % 6 AS INT) + 1] AS answer,
  turn % 4 < 2 AS is_error, 'c' || (turn // 6) AS id FROM conversations WHERE role IN ('user', 'assistant'))"""


def block_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").filter("role IN ('user', 'assistant')")
    name = F.element_at(F.array(F.lit("Bash"), F.lit("Edit"), F.lit("WebFetch")), (F.col("conv_id") % 3).cast("int") + 1)
    said = F.element_at(F.array(*[F.lit(a) for a in ANSWERS]), ((F.col("conv_id") + F.col("turn")) % 6).cast("int") + 1)
    call = F.concat(F.lit("c"), F.floor(F.col("turn") / 6))
    use = F.to_json(F.array(F.struct(F.lit("tool_use").alias("type"), call.alias("id"), name.alias("name"))))
    answer = F.to_json(F.array(F.struct(F.lit("tool_result").alias("type"), call.alias("tool_use_id"), (F.col("turn") % 4 < 2).alias("is_error"), said.alias("content"))))
    content = F.parse_json(F.when(F.col("role") == "assistant", use).otherwise(answer))
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "role", content.alias("content"), F.lit(None).cast("string").alias("name"))


@query(
    f"""WITH {BLOCKS}, w AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN name END IGNORE NULLS) OVER b AS tool, coalesce(max(CASE WHEN role = 'user' THEN 1 END) OVER b, 0) AS seen
  FROM blocks WINDOW b AS (PARTITION BY conv_id, id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, coalesce(tool, 'unknown') AS tool_name FROM w WHERE role = 'user' AND seen = 0)
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, CAST(0 AS INT) AS block, tool_name, answer AS message, {_any("answer", detectors.CALL_LEVEL)} AS call_level FROM f
WHERE CASE WHEN is_error THEN NOT {_any("answer", detectors.EXPECTED_RESULTS)} ELSE tool_name = 'WebFetch' AND {_matches("answer", detectors.FETCH_FAILURE)} END"""
)
def block_errors_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.errors(block_messages(spark, sf_dir))


# Message contents of every shape.

SHAPED = """shaped AS (SELECT conv_id, turn, coalesce(text, '') AS t, (conv_id + turn) % 5 AS s FROM conversations)"""


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = F.coalesce("text", F.lit("")), (F.col("conv_id") + F.col("turn")) % 5
    block = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    arrays = F.to_json(F.array(block("text", t), block("image", F.lit("no")), block("text", F.lit("end"))))
    j = F.when(s == 1, arrays).when(s == 2, F.to_json(F.struct(F.col("turn").alias("n")))).when(s == 3, F.lit("null")).when(s == 4, F.concat(F.lit("["), F.to_json(block("tool_result", t)), F.lit(']'))).otherwise(F.lit("1"))
    content = F.when(s == 0, t.cast("variant")).otherwise(F.parse_json(j))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", content.alias("v"))


@query(
    f"""WITH {SHAPED} SELECT conv_id, turn, CASE s WHEN 0 THEN t WHEN 1 THEN t || chr(10) || 'end' ELSE '' END AS result,
  CASE s WHEN 0 THEN t WHEN 1 THEN t || chr(10) || 'end' WHEN 2 THEN '{{"n":' || turn || '}}' WHEN 3 THEN 'null' ELSE '' END AS said, s = 4 AS has_result FROM shaped"""
)
def content_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return contents(spark, sf_dir).select("conv_id", "turn", C.result_text(v).alias("result"), C.assistant_text(v).alias("said"), C.has_block(v, "tool_result").alias("has_result"))


# Signals.

WIDE = """wide AS (SELECT event_id AS seq, ['correction', 'error', 'workaround', 'deferral', 'pattern'][CAST(event_id % 5 AS INT) + 1] AS kind, 's' || user_id AS session_id, 'ctx ' || event_type || repeat('x', CAST(event_id % 97 AS INT)) AS context,
  CASE WHEN event_id % 11 = 0 THEN 'codex_fallback_main' ELSE event_type END AS tool_name, props AS message, event_type AS pattern, 'item ' || event_type AS item, 'called `' || event_type || '` ' || event_id || ' times' AS description,
  ['stuck_loop', 'resume_storm', ''][CAST(event_id % 3 AS INT) + 1] AS pattern_kind FROM events)"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = read(spark, sf_dir, "events"), F.col("event_id")
    of = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names)).cast("int") + 1)
    kind = F.col("event_type")
    return e.select(
        n.alias("seq"), of(signals.KINDS).alias("kind"), F.concat(F.lit("s"), "user_id").alias("session_id"), F.concat(F.lit("ctx "), kind, F.repeat(F.lit("x"), (n % 97).cast("int"))).alias("context"),
        F.when(n % 11 == 0, "codex_fallback_main").otherwise(kind).alias("tool_name"), F.col("props").alias("message"), kind.alias("pattern"), F.concat(F.lit("item "), kind).alias("item"),
        F.concat(F.lit("called `"), kind, F.lit("` "), n, F.lit(" times")).alias("description"), of(("stuck_loop", "resume_storm", "")).alias("pattern_kind"),
    )


@query(
    f"""WITH {WIDE} SELECT seq, '[signal/' || kind || '] ' || CASE kind WHEN 'correction' THEN session_id || ': ' || substr(context, 1, 80) WHEN 'error' THEN tool_name || ': ' || CASE WHEN tool_name = 'codex_fallback_main' THEN session_id ELSE substr(message, 1, 80) END
  WHEN 'workaround' THEN pattern || ': ' || substr(context, 1, 80) WHEN 'pattern' THEN session_id || ': ' || substr(description, 1, 80) ELSE session_id || ': ' || substr(item, 1, 80) END AS title,
  CASE WHEN kind IN ('correction', 'pattern') THEN 2 ELSE 3 END AS priority FROM wide"""
)
def signal_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).select("seq", signals.title().alias("title"), signals.priority(F.col("kind")).alias("priority"))


def _fields(*names: str) -> str:
    return " || ".join(f"octet_length(encode({n})) || ':' || {n}" for n in names)


@query(
    f"""WITH {WIDE}, t AS (SELECT seq, kind || ':' || session_id AS lead, CASE kind WHEN 'correction' THEN {_fields("context")} WHEN 'error' THEN {_fields("tool_name", "message")} WHEN 'workaround' THEN {_fields("pattern", "context")}
  WHEN 'deferral' THEN {_fields("item")} ELSE CASE pattern_kind WHEN 'stuck_loop' THEN {_fields("pattern_kind", "pattern")} WHEN '' THEN {_fields("pattern_kind", "description")} ELSE {_fields("pattern_kind")} END END AS s FROM wide),
b AS (SELECT *, list_transform(generate_series(1, length(s)), lambda i: CAST(ascii(s[i]) AS UHUGEINT)) AS bytes FROM t),
h AS (SELECT seq, lead || ':' || lower(printf('%016x', list_reduce(list_prepend(14695981039346656037::UHUGEINT, bytes),
  lambda h, x: (CAST(xor(CAST(h AS UBIGINT), CAST(x AS UBIGINT)) AS UHUGEINT) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)) AS id FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM h) SELECT seq, CASE WHEN n > 1 THEN id || '#' || n ELSE id END AS id FROM n"""
)
def signal_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.with_identity(wide(spark, sf_dir), ["seq"]).select("seq", "id")


@query(
    """SELECT count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS corrections, count(*) FILTER (WHERE o_orderpriority LIKE '2%') AS errors, count(*) FILTER (WHERE o_orderpriority LIKE '3%') AS workarounds,
  count(*) FILTER (WHERE o_orderpriority LIKE '4%') AS deferrals, count(*) FILTER (WHERE o_orderpriority LIKE '5%') AS patterns, count(*) AS total FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '1996-06-01'"""
)
def ledger_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in signals.KINDS]), F.substring("o_orderpriority", 1, 1).cast("int"))
    state = read(spark, sf_dir, "orders").select(F.concat_ws(":", kind, "o_orderkey").alias("id"), (F.col("o_orderstatus") != "F").alias("counted"), F.col("o_orderdate").alias("session_modified"))
    return signals.counted_in_window(state, F.lit("1996-06-01").cast("timestamp"))


def _named(name: str, sql: str, kind: str, order: int) -> str:
    return f"SELECT session_id, {order} AS kind_order, '{kind}' AS pattern_kind, evidence FROM ({sql})"


def _loops() -> str:
    from tidemark.plans.catalog import ORACLE_SQL

    return ORACLE_SQL["stuck_loops"]


def _runaways() -> str:
    from tidemark.plans.catalog import ORACLE_SQL

    return ORACLE_SQL["runaway_stretch"]


HEALTH = f"""({_named("c", _storm_sql("compaction"), "compaction_storm", 1)} UNION ALL {_named("l", _loops(), "stuck_loop", 2)}
UNION ALL {_named("r", _storm_sql("resume"), "resume_storm", 3)} UNION ALL {_named("i", _runaways(), "iteration_runaway", 4)})"""


@query(f"SELECT * FROM {HEALTH}")
def health_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.health_patterns(session_events(spark, sf_dir), TEST_LIMITS).select("session_id", "kind_order", "pattern_kind", "evidence")


@query(
    f"""WITH {PLANTED}, {RESULT_ROWS}, p AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM planted WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT 'correction' AS kind, 0 AS kind_ord, count(*) AS n FROM p WHERE role = 'user' AND before = 'assistant' AND after = 'assistant' AND {_CORRECTS}
UNION ALL SELECT 'error', 1, count(*) FROM kinds WHERE json_type(d, '$.success') = 'BOOLEAN' AND json_extract_string(d, '$.success') = 'false' AND NOT {_DENIED} AND NOT coalesce({_EMPTY}, false)
UNION ALL SELECT 'workaround', 2, count(*) FROM planted WHERE role = 'assistant' AND {_label("said", detectors.WORKAROUNDS)} IS NOT NULL AND NOT {_MARKED} AND NOT {_REVIEW} AND NOT coalesce({_MEMORY}, false)
UNION ALL SELECT 'deferral', 3, count(*) FROM planted WHERE role = 'assistant' AND {_label("said", detectors.DEFERRALS)} IS NOT NULL AND NOT {_MARKED} AND NOT {_REVIEW} AND NOT coalesce({_MEMORY}, false)
UNION ALL SELECT 'pattern', 4, count(*) FROM {HEALTH}"""
)
def union_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five kinds, from detectors with their own patterns."""
    m = planted_messages(spark, sf_dir)
    tools = results(spark, sf_dir).select("session_id", "seq", F.lit("tool").alias("role"), F.col("j").cast("variant").alias("content"), F.col("tool_name").alias("name"))
    every = signals.all_signals(detectors.corrections(m), detectors.errors(tools), detectors.workarounds(m), detectors.deferrals(m), health.health_patterns(session_events(spark, sf_dir), TEST_LIMITS))
    return every.groupBy("kind", "kind_ord").agg(F.count("*").alias("n"))


@query(
    """WITH n AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a (2)' ELSE 'b' || chr(7) END AS persona, CASE c_custkey % 2 WHEN 0 THEN 'x' ELSE 'x`' END AS channel FROM customer),
g AS (SELECT persona, channel, count(*) AS sessions FROM n GROUP BY ALL)
SELECT persona, channel, sessions, CASE persona WHEN 'a' THEN CASE channel WHEN 'x' THEN 'a@x' ELSE 'a@x''' END WHEN 'a (2)' THEN CASE channel WHEN 'x' THEN 'a (2)@x' ELSE 'a (2)@x''' END ELSE CASE channel WHEN 'x' THEN 'b @x' ELSE 'b @x''' END END AS key FROM g"""
)
def display_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    persona = F.when(n % 3 == 0, "a").when(n % 3 == 1, "a (2)").otherwise("b\x07")
    rows = read(spark, sf_dir, "customer").select(persona.alias("persona"), F.when(n % 2 == 0, "x").otherwise("x`").alias("channel")).groupBy("persona", "channel").agg(F.count("*").alias("sessions"))
    return rollup.with_display_key(rows)


# Scalars that no query called.


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS sub, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE 'r_' || c_mktsegment END AS role,
  CASE c_custkey % 4 WHEN 3 THEN 'plain' ELSE 'r_' || c_mktsegment END AS stem, c_name || ':x' AS bare, c_mktsegment AS ticked, regexp_replace(c_name || '/' || c_mktsegment, '[^A-Za-z0-9._-]', '-', 'g') AS slug FROM customer"""
)
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = read(spark, sf_dir, "customer"), F.col("c_custkey") % 4
    x = F.when(n == 3, "plain").otherwise(F.concat(F.lit("a_r_"), "c_mktsegment"))
    session = F.when(n == 0, F.concat(F.lit(X.SUB_AGENT_PREFIX), F.lit("-x"))).when(n == 1, F.concat(F.lit("agent-"), F.hex("c_custkey"))).when(n == 2, "agent-xyz").otherwise(x)
    return c.select(
        "c_custkey", X.is_sub_agent(session).alias("sub"), X.session_role(x).alias("role"), X.id_of_stem(x).alias("stem"), X.without_agent(F.concat(F.lit("codex:"), "c_name", F.lit(":x"))).alias("bare"),
        X.backticked(F.concat(F.lit("say `"), "c_mktsegment", F.lit("` and `more`"))).alias("ticked"), X.slug(F.concat_ws("/", "c_name", "c_mktsegment")).alias("slug"),
    )


@query(f"SELECT p_partkey, CASE WHEN length(p_name) > 9 THEN substr(p_name, 1, 9) || {_quote(X.TRUNCATED)} ELSE p_name END AS marked, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS exact, CAST(NULL AS VARCHAR) AS none FROM part")
def marked_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    return read(spark, sf_dir, "part").select("p_partkey", X.truncated_marked(F.col("p_name"), 9).alias("marked"), X.exact_decimal(price).cast("decimal(18,2)").cast("string").alias("exact"), X.exact_decimal(F.col("p_name")).cast("string").alias("none"))


SOURCES = "sources AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 's' || l_suppkey WHEN 1 THEN '.s' || l_suppkey WHEN 2 THEN 's/' || l_suppkey ELSE repeat('s', CAST(60 + l_orderkey % 10 AS INT)) END AS source FROM lineitem)"


@query(rf"WITH {SOURCES} SELECT l_orderkey, l_linenumber, regexp_full_match(source, '[A-Za-z0-9][A-Za-z0-9._-]{{0,63}}') AS valid, printf('%s-%06d.json', source, l_orderkey) AS name FROM sources")
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    source = F.when(n == 0, F.concat(F.lit("s"), "l_suppkey")).when(n == 1, F.concat(F.lit(".s"), "l_suppkey")).when(n == 2, F.concat(F.lit("s/"), "l_suppkey")).otherwise(F.repeat(F.lit("s"), (60 + F.col("l_orderkey") % 10).cast("int")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.valid_source(source).alias("valid"), X.segment_name(source, F.col("l_orderkey")).alias("name"))


@query(
    f"""SELECT event_id, {sql_stamp("ts - INTERVAL 2 HOURS")} AS east, {sql_stamp("ts + INTERVAL 330 MINUTES")} AS west, {sql_stamp("date_trunc('millisecond', ts)")} AS millis, CAST(NULL AS VARCHAR) AS bad FROM events"""
)
def zoned_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    iso = lambda form: F.date_format("ts", f"yyyy-MM-dd'T'HH:mm:ss.{form}")
    told = lambda x: stamp(X.parsed_time(x))
    return e.select(
        "event_id", told(F.concat(iso("SSSSSS"), F.lit("+02:00"))).alias("east"), told(F.concat(iso("SSSSSS"), F.lit("-05:30"))).alias("west"), told(F.concat(iso("SSS"), F.lit("z"))).alias("millis"), told(F.concat(iso("SSS"), F.lit("+2"))).alias("bad")
    )


@query(
    r"""SELECT event_id AS n, CASE WHEN event_id % 3 = 0 THEN lower(m) ELSE '00000000-0000-0000-0000-000000000000' END AS event_id, CASE event_type WHEN 'error' THEN 'decision' WHEN 'view' THEN 'state_change' ELSE 'health' END AS event_class,
  CASE WHEN event_id % 2 = 0 THEN 'confidential' ELSE 'metadata_only' END AS payload_tier, CASE WHEN event_id % 5 <> 0 THEN props END AS payload
FROM (SELECT *, upper(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)) AS m FROM (SELECT *, md5(CAST(event_id AS VARCHAR)) AS h FROM events))"""
)
def decoded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = read(spark, sf_dir, "events"), F.col("event_id")
    h = F.md5(n.cast("string").cast("binary"))
    uuid = F.upper(F.concat_ws("-", *[F.substring(h, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
    kind = F.when(F.col("event_type") == "error", "Decision").when(F.col("event_type") == "view", "StateChange").otherwise("odd")
    rows = e.select(
        n.alias("n"), F.when(n % 3 == 0, uuid).otherwise("bad").alias("event_id"), F.lit("bad").alias("timestamp"), F.lit("bad").alias("correlation_id"), F.lit(None).cast("string").alias("causation_id"), kind.alias("event_class"),
        F.when(n % 2 == 0, "Confidential").otherwise("strange").alias("payload_tier"), F.when(n % 5 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("payload"),
    )
    return ledger.decoded(rows, F.lit("2026-01-01").cast("timestamp")).select("n", "event_id", "event_class", "payload_tier", "payload")


# Segment files.


def segment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name and value of a segment file for each order; some are damaged."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    source, event = F.concat(F.lit("s"), "o_custkey"), F.format_string('[{"event_id":"e%d","zone":"z","source":"s%d","source_seq":%d,"timestamp":"2026-01-02T03:04:05Z","correlation_id":null,"causation_id":null,"actor_ref":"%s","object_ref":null,"event_class":"decision","payload_tier":"structured","payload":{"a":1,"b":[%d]}}]', k, F.col("o_custkey"), k, F.col("o_orderstatus"), k)
    events = F.when(k % 7 == 0, "[]").otherwise(event)
    seal = F.crc32(events.cast("binary")) + F.when(k % 11 == 0, 1).otherwise(0)
    seq = F.when(k % 13 == 0, F.lit("9223372036854775808")).otherwise(k.cast("string"))
    value = F.when(k % 17 == 0, F.concat(F.lit("{"), events)).otherwise(F.concat(F.lit('{"source":"'), source, F.lit('","source_seq":'), seq, F.lit(',"checksum":'), seal.cast("string"), F.lit(',"created_at":"2026-01-02T03:04:05Z","events":'), events, F.lit("}")))
    name = F.concat(source, F.lit("-"), F.lpad(seq, F.greatest(F.length(seq), F.lit(6)), F.lit("0")), F.when(k % 19 == 0, "1").otherwise(""), F.lit(".json"))
    return o.select(name.alias("name"), value.alias("value"))


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_custkey FROM orders) SELECT 's' || o_custkey AS segment_source, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 19 = 0 THEN CAST(CASE WHEN length(CAST(k AS VARCHAR)) < 6 THEN printf('%06d', k) ELSE CAST(k AS VARCHAR) END || '1' AS BIGINT) ELSE k END AS segment_seq,
  CASE WHEN k % 17 = 0 THEN 'unreadable' WHEN k % 19 = 0 THEN 'name' WHEN k % 11 = 0 THEN 'seal' WHEN k % 13 = 0 THEN 'range' END AS fault FROM o"""
)
def segment_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("fault")
    short = F.when(f.startswith("not a segment"), "unreadable").when(f.startswith("the content"), "name").when(f == "checksum mismatch", "seal").when(f.startswith("a number"), "range").otherwise(f)
    return segments.checked_files(segment_texts(spark, sf_dir)).select("segment_source", "segment_seq", short.alias("fault"))


@query(
    """SELECT 'e' || o_orderkey AS event_id, 's' || o_custkey AS source, o_orderkey AS source_seq, o_orderstatus AS actor_ref, '{"a":1,"b":[' || o_orderkey || ']}' AS payload, '2026-01-02 03:04:05.000000' AS at
FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0"""
)
def segment_events_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments.events_of(segments.checked_files(segment_texts(spark, sf_dir)))
    return found.select("event_id", "source", "source_seq", "actor_ref", "payload", stamp(F.col("timestamp")).alias("at"))


# Readers over lines that are tables.


def held(kind: type[base.Reader], lines: DataFrame, *args: object, **more: object) -> base.Reader:
    """A reader whose files are the rows (path, seq, line) of a table."""
    rows = lines.withColumn("modified", F.lit("2026-01-02 03:04:05").cast("timestamp")).select("path", "modified", "seq", "line")

    class Held(kind):  # type: ignore[misc, valid-type]
        def _lines(self, pattern: str | None = None, names: str | None = None) -> DataFrame:
            return rows.filter(F.col("path").rlike(pattern or self.pattern))

        def _listed(self, pattern: str | None = None, names: str | None = None) -> DataFrame:
            return self._lines(pattern, names).select("path", "modified").distinct()

    return Held(lines.sparkSession, [], *args, **more)


def _path(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _said(df: DataFrame) -> DataFrame:
    return df.select("path", "seq", "role", C.as_string(F.col("content")).alias("said"), "name")


CONV = "c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations)"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").withColumn("t", F.coalesce("text", F.lit("")))


def folders(spark: SparkSession, sf_dir: str) -> transcripts.SessionFolders:
    c = conversations(spark, sf_dir)
    return held(transcripts.SessionFolders, c.select(_path("file:/p/sessions/s", F.col("conv_id").cast("string"), "/transcript.jsonl").alias("path"), (F.col("turn") + 1).alias("seq"), _json(role=F.col("role"), content=F.col("t"), name=F.lit("n")).alias("line")))


@query("SELECT DISTINCT 'amplifier' AS reader, 's' || conv_id AS session_id, 'file:/p/sessions/s' || conv_id || '/transcript.jsonl' AS path, 's' || conv_id AS dedupe_key FROM conversations")
def folder_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders(spark, sf_dir).sessions().select("reader", "session_id", "path", "dedupe_key")


@query(f"WITH {CONV} SELECT 'file:/p/sessions/s' || conv_id || '/transcript.jsonl' AS path, turn + 1 AS seq, role, t AS said, 'n' AS name FROM c")
def folder_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(folders(spark, sf_dir).messages())


EVENT_KINDS = {"purchase": "context:compaction", "error": "session:resume", "view": "tool:pre", "click": "llm:response", "signup": "prompt:submit"}


def event_lines(spark: SparkSession, sf_dir: str, path: Column) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for p in EVENT_KINDS.items() for x in p])[F.col("event_type")]
    usage = F.struct(F.col("value").cast("decimal(10,2)").cast("string").alias("cost_usd"), (F.col("event_id") % 50).alias("input_tokens"), F.lit(3).alias("output_tokens"))
    raw = F.struct(F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("said "), "event_id").alias("text"))).alias("content"))
    data = F.struct(F.concat(F.lit("ask "), "event_id").alias("prompt"), F.col("event_type").alias("tool_name"), F.struct(F.col("event_id").alias("a")).alias("tool_input"), F.lit("m1").alias("model"), raw.alias("raw"), usage.alias("usage"))
    line = F.to_json(F.struct(kind.alias("event"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), data.alias("data")))
    return e.select(path.alias("path"), F.col("event_id").alias("seq"), line.alias("line"))


def event_folders(spark: SparkSession, sf_dir: str) -> transcripts.SessionFolders:
    return held(transcripts.SessionFolders, event_lines(spark, sf_dir, _path("file:/p/sessions/u", F.col("user_id").cast("string"), "/events.jsonl")))


@query("SELECT 'file:/p/sessions/u' || user_id || '/events.jsonl' AS path, event_id AS seq, CASE event_type WHEN 'signup' THEN 'user' ELSE 'assistant' END AS role, CASE event_type WHEN 'signup' THEN 'ask ' ELSE 'said ' END || event_id AS said, CAST(NULL AS VARCHAR) AS name FROM events WHERE event_type IN ('signup', 'click')")
def event_log_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(event_folders(spark, sf_dir).messages())


@query(
    f"""SELECT 'file:/p/sessions/u' || user_id || '/events.jsonl' AS path, event_id AS seq, CASE event_type WHEN 'view' THEN 'tool_call' WHEN 'click' THEN 'llm_response' WHEN 'signup' THEN 'user_message' WHEN 'purchase' THEN 'compaction' ELSE 'resume' END AS kind,
  {sql_stamp("ts")} AS at, CASE event_type WHEN 'view' THEN 'view' END AS tool_name, CASE event_type WHEN 'view' THEN '{{"a":' || event_id || '}}' END AS detail FROM events"""
)
def event_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_folders(spark, sf_dir).events().select("path", "seq", "kind", stamp(F.col("ts")).alias("at"), "tool_name", "detail")


@query("SELECT 'file:/p/sessions/u' || user_id || '/events.jsonl' AS path, event_id AS seq, 'm1' AS model, CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) AS cost, event_id % 50 AS input_tokens, CAST(3 AS BIGINT) AS output_tokens FROM events WHERE event_type = 'click'")
def event_log_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_folders(spark, sf_dir).usage().withColumn("cost", F.col("cost").cast("decimal(10,2)").cast("string"))


def indexed(spark: SparkSession, sf_dir: str) -> transcripts.IndexedEvents:
    u = F.col("user_id")
    folder = ("file:/p/sessions/u", u.cast("string"), "/context-intelligence/")
    meta = read(spark, sf_dir, "events").select("user_id").distinct()
    form = _json(format=F.when(u % 5 == 0, "other").otherwise("context-intelligence"), version=F.when(u % 7 == 0, "2.0").otherwise("1.4"), last_event_at=F.lit("2026-02-03T04:05:06Z"))
    return held(transcripts.IndexedEvents, event_lines(spark, sf_dir, _path(*folder, "events.jsonl")).union(meta.select(_path(*folder, "metadata.json"), F.lit(1).cast("long"), form)))


@query("SELECT DISTINCT 'u' || user_id AS session_id, '2026-02-03 04:05:06.000000' AS modified FROM events WHERE user_id % 5 <> 0 AND user_id % 7 <> 0")
def indexed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).sessions().select("session_id", stamp(F.col("modified")).alias("modified"))


@query("SELECT 'file:/p/sessions/u' || user_id || '/context-intelligence/events.jsonl' AS path, event_id AS seq FROM events WHERE user_id % 5 <> 0 AND user_id % 7 <> 0")
def indexed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).events().select("path", "seq")


def wrapped(spark: SparkSession, sf_dir: str) -> transcripts.WrappedLines:
    c, n = conversations(spark, sf_dir), F.col("turn") % 4
    inner = F.struct("role", F.col("t").alias("content"))
    line = F.when(n == 3, F.to_json(F.struct("role", F.col("t").alias("content")))).otherwise(F.to_json(F.struct(F.when(n == 2, "api-request-blob").when(n == 1, "odd").otherwise("user").alias("type"), inner.alias("message"))))
    return held(transcripts.WrappedLines, c.select(_path("file:/w/s", F.col("conv_id").cast("string"), ".jsonl").alias("path"), (F.col("turn") + 1).alias("seq"), line.alias("line")), None, "mine")


@query("SELECT DISTINCT 's' || conv_id AS session_id, 'mine' AS seat FROM conversations")
def wrapped_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapped(spark, sf_dir).sessions().select("session_id", "seat")


@query(f"WITH {CONV} SELECT 'file:/w/s' || conv_id || '.jsonl' AS path, turn + 1 AS seq, role, t AS said, CASE WHEN turn % 4 = 1 THEN 'odd' END AS name FROM c WHERE turn % 4 <> 2")
def wrapped_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(wrapped(spark, sf_dir).messages())


def rollouts(spark: SparkSession, sf_dir: str) -> transcripts.Rollouts:
    c = conversations(spark, sf_dir)
    content = F.array(F.struct(F.lit("input_text").alias("type"), F.col("t").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("no").alias("text")))
    payload = F.struct(F.lit("message").alias("type"), "role", content.alias("content"))
    line = _json(type=F.lit("response_item"), timestamp=F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), payload=payload)
    path = _path("file:/x/", F.when(F.col("conv_id") % 2 == 0, ".codex").otherwise("seat-1"), "/sessions/rollout-", F.col("conv_id").cast("string"), ".jsonl")
    heads = c.select("conv_id").distinct().select(path.alias("path"), F.lit(1).cast("long").alias("seq"), _json(type=F.lit("session_meta"), payload=F.struct(F.lit("/w").alias("cwd"), F.concat(F.lit("id"), "conv_id").alias("id"), F.lit("2026-01-01T00:00:00Z").alias("timestamp"))).alias("line"))
    return held(transcripts.Rollouts, c.select(path.alias("path"), (F.col("turn") + 2).alias("seq"), line.alias("line")).union(heads))


_ROLLOUT = "'file:/x/' || CASE WHEN conv_id % 2 = 0 THEN '.codex' ELSE 'seat-1' END || '/sessions/rollout-' || conv_id || '.jsonl'"


@query("SELECT DISTINCT 'rollout-' || conv_id AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'main' ELSE 'seat-1' END AS seat FROM conversations")
def rollout_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).sessions().select("session_id", "seat")


@query(f"WITH {CONV} SELECT {_ROLLOUT} AS path, turn + 2 AS seq, role, t AS said, CAST(NULL AS VARCHAR) AS name FROM c WHERE role IN ('user', 'assistant') AND t <> ''")
def rollout_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(rollouts(spark, sf_dir).messages())


@query(
    f"""SELECT {_ROLLOUT} AS path, '/w' AS cwd, 'id' || conv_id AS session, '2026-01-01 00:00:00.000000' AS started, strftime(make_timestamp((1700000000 + min(turn) FILTER (WHERE role = 'assistant')) * 1000000), '%Y-%m-%d %H:%M:%S.%f') AS first_turn FROM conversations GROUP BY conv_id"""
)
def rollout_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).index().select("path", "cwd", "session", stamp(F.col("started")).alias("started"), stamp(F.col("first_turn")).alias("first_turn"))


def typed(spark: SparkSession, sf_dir: str) -> transcripts.TypedEvents:
    c = conversations(spark, sf_dir)
    line = _json(type=F.concat("role", F.lit(".message")), data=F.struct("role", F.col("t").alias("content")))
    return held(transcripts.TypedEvents, c.select(_path("file:/t/s", F.col("conv_id").cast("string"), "/events.jsonl").alias("path"), (F.col("turn") + 1).alias("seq"), line.alias("line")))


@query(f"WITH {CONV} SELECT 'file:/t/s' || conv_id || '/events.jsonl' AS path, turn + 1 AS seq, role, t AS said, CAST(NULL AS VARCHAR) AS name FROM c WHERE role IN ('user', 'assistant') AND t <> ''")
def typed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(typed(spark, sf_dir).messages())


def branches(spark: SparkSession, sf_dir: str) -> transcripts.BranchFiles:
    e, n = read(spark, sf_dir, "events"), F.col("event_id")
    role = F.when(n % 3 == 0, "user").when(n % 3 == 1, "assistant").otherwise("toolResult")
    said = F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("said "), n).alias("text")))
    usage = F.when(n % 3 == 1, F.struct((n % 10).alias("input"), F.lit(2).alias("output"), F.lit(1).alias("cacheRead"), F.struct(F.col("value").cast("decimal(10,2)").alias("total")).alias("cost")))
    message = F.struct(role.alias("role"), said.alias("content"), F.lit("bash").alias("toolName"), (n % 2 == 0).alias("isError"), F.lit("m2").alias("model"), usage.alias("usage"))
    line = _json(type=F.lit("message"), timestamp=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), message=message)
    return held(transcripts.BranchFiles, e.select(_path("file:/b/at_u", F.col("user_id").cast("string"), ".jsonl").alias("path"), n.alias("seq"), line.alias("line")))


@query("SELECT DISTINCT 'u' || user_id AS session_id FROM events")
def branch_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branches(spark, sf_dir).sessions().select("session_id")


@query(
    """SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'tool' END AS role, CASE WHEN event_id % 3 <> 2 THEN 'said ' || event_id WHEN event_id % 2 = 0 THEN '{"error":"said ' || event_id || '","output":null,"success":false}'
  ELSE '{"error":null,"output":"said ' || event_id || '","success":true}' END AS said, CASE WHEN event_id % 3 = 2 THEN 'bash' END AS name FROM events"""
)
def branch_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _said(branches(spark, sf_dir).messages())
    # A null field may be left out of the JSON; read back, both forms are one.
    v = F.try_parse_json("said")
    full = F.concat(F.lit('{"error":'), F.coalesce(F.to_json(C.at(v, "$.error")), F.lit("null")), F.lit(',"output":'), F.coalesce(F.to_json(C.at(v, "$.output")), F.lit("null")), F.lit(',"success":'), F.to_json(C.at(v, "$.success")), F.lit("}"))
    return said.select("seq", "role", F.when(F.col("role") == "tool", full).otherwise(F.col("said")).alias("said"), "name")


@query("SELECT event_id AS seq, 'm2' AS model, CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) AS cost, event_id % 10 + 1 AS input_tokens, CAST(2 AS BIGINT) AS output_tokens FROM events WHERE event_id % 3 = 1")
def branch_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branches(spark, sf_dir).usage().select("seq", "model", F.col("cost").cast("decimal(10,2)").cast("string").alias("cost"), "input_tokens", "output_tokens")


@query("SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'user_message' ELSE 'llm_response' END AS kind FROM events WHERE event_id % 3 <> 2")
def branch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branches(spark, sf_dir).events().select((F.col("seq") / (1 << 20)).cast("long").alias("seq"), "kind")


def cells(spark: SparkSession, sf_dir: str) -> transcripts.ChatCells:
    c, n = conversations(spark, sf_dir), F.col("turn")
    role = F.when(n % 2 == 0, "user").otherwise("assistant")
    said = F.when(n % 4 == 0, F.concat(F.lit('<message from="a">'), F.replace("t", F.lit("<"), F.lit("&lt;")), F.lit("</message>"))).otherwise(F.col("t"))
    usage = F.struct((n + 1).alias("input_tokens"), F.lit(5).alias("output_tokens"))
    message = F.struct(F.when(n % 2 == 1, F.concat(F.lit("r"), F.floor(n / 4))).alias("id"), role.alias("role"), said.alias("content"), F.when(n % 2 == 1, usage).alias("usage"))
    line = _json(type=role, isMeta=(n % 6 == 0), timestamp=F.lit("2026-01-01T00:00:00Z"), message=message)
    return held(transcripts.ChatCells, c.select(_path("file:/c/v2-sessions/g", (F.col("conv_id") % 3).cast("string"), "/s", F.col("conv_id").cast("string"), ".jsonl").alias("path"), (n + 1).alias("seq"), line.alias("line")))


@query("SELECT DISTINCT 's' || conv_id AS session_id, 'g' || (conv_id % 3) AS agent, 'g' || (conv_id % 3) AS persona FROM conversations")
def cell_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).sessions().select("session_id", "agent", "persona")


@query(
    r"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), m AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN t ELSE regexp_replace(t, '^\s+|\s+$', '', 'g') END AS said FROM c WHERE turn % 6 <> 0)
SELECT 's' || conv_id AS session_id, turn + 1 AS seq, CASE turn % 2 WHEN 0 THEN 'user' ELSE 'assistant' END AS role, said FROM m WHERE said <> ''"""
)
def cell_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cells(spark, sf_dir).messages()
    return m.select(base.stem(F.col("path")).alias("session_id"), (F.col("seq") / (1 << 20)).cast("long").alias("seq"), "role", C.as_string(F.col("content")).alias("said"))


@query("SELECT 's' || conv_id AS session_id, min(turn) + 1 AS seq, min(turn) + 1 AS input_tokens, CAST(5 AS BIGINT) AS output_tokens FROM conversations WHERE turn % 2 = 1 GROUP BY conv_id, turn // 4")
def cell_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).usage().select(base.stem(F.col("path")).alias("session_id"), "seq", "input_tokens", "output_tokens")


def generic(spark: SparkSession, sf_dir: str) -> transcripts.GenericFiles:
    c = conversations(spark, sf_dir)
    path = _path("file:/g/d", F.col("conv_id").cast("string"), "/chat.jsonl")
    head = F.struct(F.when(F.col("conv_id") % 2 == 0, F.lit(" ana ")).otherwise(" ").alias("persona"), F.lit("lab").alias("channel"))
    heads = c.select("conv_id").distinct().select(path.alias("path"), F.lit(1).cast("long").alias("seq"), F.to_json(F.struct(head.alias("_session"))).alias("line"))
    return held(transcripts.GenericFiles, heads.union(c.select(path, F.col("turn") + 2, _json(role=F.col("role"), content=F.col("t")))), "[.]jsonl$", "*.jsonl", "parent")


@query("SELECT DISTINCT 'd' || conv_id AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'ana' END AS persona, 'lab' AS channel FROM conversations")
def generic_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generic(spark, sf_dir).sessions().select("session_id", "persona", "channel")


@query(f"WITH {CONV} SELECT 'file:/g/d' || conv_id || '/chat.jsonl' AS path, turn + 2 AS seq, role, t AS said, CAST(NULL AS VARCHAR) AS name FROM c WHERE role IS NOT NULL")
def generic_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(generic(spark, sf_dir).messages())


# Worker evidence: a dispatch for each order.

SINCE = "1996-01-01"
DISPATCH = """dispatch AS (SELECT o_orderkey AS k, 'd' || o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'claude' ELSE 'codex' END AS harness, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS status,
  o_orderdate AS start, o_orderdate + INTERVAL 1 DAY AS kickoff_at, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL 2 DAY END AS updated, o_orderkey % 4 = 0 AS failed FROM orders)"""


def _iso(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue documents {issue, comments} as variant v."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    dispatch = F.struct(
        F.concat(F.lit("d"), k).alias("id"), F.when(k % 3 == 0, "claude").otherwise("codex").alias("harness"), F.concat(F.lit("seat"), k % 7).alias("seat"), F.lit("h1").alias("host"), F.concat(F.lit("%"), k % 40).alias("pane"), _iso(F.col("o_orderdate")).alias("dispatched_at")
    )
    kickoff = F.struct(F.concat(F.lit("d"), k).alias("id"), F.when(k % 4 == 0, "failed").otherwise("ok").alias("state"), F.lit("dialog:dir-trust:x").alias("detail"), _iso(F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("at"))
    updated = F.when(k % 5 != 0, _iso(F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")))
    issue = F.struct(F.concat(F.lit("i"), k).alias("uid"), F.concat(F.lit("q#"), k).alias("qualified_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"), updated.alias("updated_at"), F.struct(dispatch.alias("dispatch"), kickoff.alias("kickoff")).alias("metadata"))
    body = F.when(k % 2 == 0, "review: roborev --gpt x\nfine").otherwise("review: roborev --claude x")
    comment = F.struct(_iso(F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")).alias("created_at"), body.alias("body"))
    return o.select(F.parse_json(F.to_json(F.struct(issue.alias("issue"), F.array(comment, comment).alias("comments")))).alias("v"))


def since() -> Column:
    return F.lit(SINCE).cast("timestamp")


@query(f"WITH {DISPATCH} SELECT 'q#' || k AS name FROM dispatch WHERE (harness = 'codex' AND status = 'open') OR updated IS NULL OR updated >= TIMESTAMP '{SINCE}' OR start >= TIMESTAMP '{SINCE}' OR kickoff_at >= TIMESTAMP '{SINCE}'")
def issue_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = issues(spark, sf_dir).select(C.at(F.col("v"), "$.issue").alias("v"))
    return workers.candidates(listed, since()).select(C.text_at(F.col("v"), "$.qualified_id").alias("name"))


@query(f"WITH {DISPATCH} SELECT id, harness, 'seat' || (k % 7) AS seat, {sql_stamp('start')} AS start, {sql_stamp('kickoff_at')} AS kickoff_at, 'issue:i' || k AS path, 2 AS n FROM dispatch")
def dispatches_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workers.dispatches(issues(spark, sf_dir)).select("id", "harness", "seat", stamp(F.col("start")).alias("start"), stamp(F.col("kickoff_at")).alias("kickoff_at"), "path", F.size("comments").alias("n"))


@query(f"WITH {DISPATCH} SELECT id || ':codex_trust_prompt' AS session_id, {sql_stamp('kickoff_at')} AS at, id || ': kickoff stopped at directory-trust prompt' AS detail FROM dispatch WHERE harness = 'codex' AND failed AND kickoff_at >= TIMESTAMP '{SINCE}'")
def trust_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workers.trust_prompts(workers.dispatches(issues(spark, sf_dir)), since()).select("session_id", stamp(F.col("at")).alias("at"), "detail")


_SAME = f"((harness = 'codex' AND k % 2 = 0) OR (harness = 'claude' AND k % 2 = 1)) AND start + INTERVAL 3 DAYS >= TIMESTAMP '{SINCE}'"


@query(f"WITH {DISPATCH} SELECT id || ':same_model_review' AS session_id, {sql_stamp('start + INTERVAL 3 DAYS')} AS at FROM dispatch WHERE {_SAME}")
def same_model_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workers.same_model_reviews(workers.dispatches(issues(spark, sf_dir)), since(), "roborev").select("session_id", stamp(F.col("at")).alias("at"))


@query("SELECT 'h1' AS host, 'default' AS socket, CAST(o_orderkey % 40 AS VARCHAR) AS pane, arg_max('d' || o_orderkey, struct_pack(a := o_orderdate, b := 'd' || o_orderkey)) AS newest FROM orders GROUP BY o_orderkey % 40")
def pane_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = workers.pane_owners(issues(spark, sf_dir).select(C.at(F.col("v"), "$.issue").alias("v")))
    return owners.groupBy("host", "socket", "pane").agg(F.max_by("id", F.struct("at", "id")).alias("newest"))


@query(
    f"""WITH l AS (SELECT ts, event_type AS host, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_id % 2 = 0 AND event_id % 3 = 0 AND ts >= TIMESTAMP '2020-01-01')
SELECT 'allocation:' || host || ':' || day || ':codex_fallback_main' AS session_id, {sql_stamp("max(date_trunc('second', ts))")} AS at, count(*) AS n FROM l GROUP BY host, day"""
)
def allocations_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    line = F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "event_type", F.when(n % 2 == 0, "exec").otherwise("plan"), F.when(n % 3 == 0, "main").otherwise("seat"))
    found = workers.allocations(read(spark, sf_dir, "events").select(F.lit("log").alias("path"), line.alias("line")), F.lit("2020-01-01").cast("timestamp"), True)
    return found.select("session_id", stamp(F.col("at")).alias("at"), F.regexp_extract("detail", r"; (\d+) exec", 1).cast("long").alias("n"))


@query(
    f"""WITH {DISPATCH}, owner AS (SELECT k % 40 AS pane, arg_max(k, struct_pack(a := start, b := id)) AS newest FROM dispatch GROUP BY k % 40)
SELECT id || ':codex_missing_hook_state' AS session_id, {sql_stamp("start + INTERVAL 1 HOUR")} AS at FROM dispatch d JOIN owner o ON d.k % 40 = o.pane AND d.k = o.newest WHERE harness = 'codex' AND status = 'open' AND k % 2 = 0"""
)
def missing_hook_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    found = workers.dispatches(issues(spark, sf_dir)).withColumn("worktree", F.concat(F.lit("/w/"), "id"))
    owners = workers.pane_owners(issues(spark, sf_dir).select(C.at(F.col("v"), "$.issue").alias("v")))
    # Odd orders left a state under the pane's plain name.
    states = o.filter(k % 2 == 1).select(F.concat(F.lit("q-"), k, F.lit("-"), k % 40, F.lit(".ended.1")).alias("name"))
    cwd = F.concat(F.lit("/w/d"), k)
    ran = o.select(cwd.alias("cwd"), F.lit(None).cast("string").alias("session"), F.col("o_orderdate").alias("started"), F.lit("tui").alias("originator"), (F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("first_turn"), cwd.alias("path"))
    live = o.select(F.lit("default").alias("socket"), (k % 40).cast("string").alias("pane"), cwd.alias("cwd"))
    told = workers.missing_hook_states(found, owners, states, ran, live, F.lit("1990-01-01").cast("timestamp"), "h1", True)
    return told.select("session_id", stamp(F.col("at")).alias("at"))


@query(f"WITH {DISPATCH} SELECT id || ':codex_trust_prompt' AS session_id, 'codex_trust_prompt' AS name, id || ': kickoff stopped at directory-trust prompt' AS message FROM dispatch WHERE harness = 'codex' AND failed AND kickoff_at >= TIMESTAMP '{SINCE}' UNION ALL SELECT id || ':same_model_review', 'same_model_review', id || ': review used builder model family' FROM dispatch WHERE {_SAME}")
def worker_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence as messages, each a tool error."""
    d = workers.dispatches(issues(spark, sf_dir))
    every = workers.evidence(workers.trust_prompts(d, since()), workers.same_model_reviews(d, since(), "roborev"))
    found = detectors.errors(workers.as_messages(every))
    return found.select("session_id", F.col("tool_name").alias("name"), "message")


@query("SELECT o_orderkey, CAST(o_orderkey % 40 AS VARCHAR) AS pane, CASE WHEN o_orderkey % 2 = 0 THEN 'q-' || o_orderkey || '-default-' || (o_orderkey % 40) || ' q-' || o_orderkey || '-' || (o_orderkey % 40) ELSE 'q-' || o_orderkey || '-s-1-' || (o_orderkey % 40) END AS names FROM orders")
def hook_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pane = workers.pane_number(F.concat(F.lit("%"), k % 40))
    return read(spark, sf_dir, "orders").select("o_orderkey", pane.alias("pane"), F.array_join(workers.hook_state_names(F.concat(F.lit("q#"), k), F.when(k % 2 == 0, "default").otherwise("s/1"), pane), " ").alias("names"))


@query("SELECT o_orderkey, CAST(CAST(o_orderkey * 0.000001 AS DECIMAL(28,6)) AS VARCHAR) AS usd, lower(hex(encode(o_orderstatus))) = lower(hex(encode('O'))) AS same FROM orders")
def micro_dollars(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", X.micro_dollars(F.col("o_orderkey")).cast("string").alias("usd"), (hashing.fields_hash(F.col("o_orderstatus")) == hashing.fields_hash(F.lit("O"))).alias("same"))


SPACES = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


@query(f"SELECT doc_id, substr(translate(text, {' || '.join(f'chr({ord(c)})' for c in SPACES)}, repeat('-', {len(SPACES)})), 1, 240) AS k FROM documents")
def idempotency_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.idempotency_key(F.col("text")).alias("k"))
