"""Every operator as a query on the driver's tables, with its SQL twin.

The tables stand in for the engine's own inputs: `events` for ledger events and
session events (a session is a user's day), `conversations` for messages, `orders`
and `lineitem` for spend and segments, `customer` for personas. Thresholds and
patterns are set so that these tables give rows; the operators' own defaults are
proved by the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import content as C
from tidemark.functions import hashing
from tidemark.functions import text as X
from tidemark.operators import detectors, health, ledger, rollup, signals, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The engine's inputs, from the driver's tables.


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("user:"), F.col("user_id")).alias("actor_ref"),
        F.concat(F.lit("subsystem:"), F.col("event_type")).alias("object_ref"),
        F.col("event_type").alias("event_class"),
        F.get_json_object("props", "$.k").alias("correlation_id"),
        F.col("props").alias("payload"),
    )


LEDGER = """ledger AS (SELECT event_id, ts AS "timestamp", 'user:' || user_id AS actor_ref, 'subsystem:' || event_type AS object_ref,
  event_type AS event_class, json_extract_string(props, '$.k') AS correlation_id FROM events)"""


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "tool_call").when(F.col("event_type") == "click", "llm_response").when(F.col("event_type") == "signup", "user_message").when(F.col("event_type") == "purchase", "compaction").otherwise("resume")
    return e.select(F.concat(F.lit("u"), F.col("user_id")).alias("session_id"), F.col("event_id").alias("seq"), kind.alias("kind"), "ts", F.col("event_type").alias("tool_name"), (F.get_json_object("props", "$.k").cast("long") % 2).cast("string").alias("detail"))


SESSION_EVENTS = """se AS (SELECT 'u' || user_id AS session_id, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'tool_call' WHEN 'click' THEN 'llm_response' WHEN 'signup' THEN 'user_message' WHEN 'purchase' THEN 'compaction' ELSE 'resume' END AS kind,
  ts, event_type AS tool_name, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 AS VARCHAR) AS detail FROM events)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").cast("variant").alias("content"), F.lit(None).cast("string").alias("name"))


def tool_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").filter("event_type = 'error'")
    return e.select(F.get_json_object("props", "$.k").alias("tool_name"), F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.lit(False).alias("call_level"), F.col("props").alias("message"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    cost = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice").cast("decimal(18,2)").cast(rollup.COST))
    return o.select(
        F.col("o_custkey").cast("string").alias("session_id"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("role"),
        F.col("o_orderpriority").alias("model"),
        cost.alias("cost"),
        (F.col("o_orderkey") % 1000).alias("input_tokens"),
        (F.col("o_orderkey") % 100).alias("output_tokens"),
        F.to_date("o_orderdate").alias("date"),
    )


USAGE = """usage AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS role, o_orderpriority AS model,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS cost, o_orderkey % 1000 AS input_tokens, o_orderkey % 100 AS output_tokens,
  CAST(o_orderdate AS DATE) AS date FROM orders)"""


def money(x: Column) -> Column:
    return x.cast("decimal(38,2)").cast("string")


def stamp(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


# Ledger queries.


@query(
    """SELECT json_extract_string(props, '$.k') AS tool_name, count(DISTINCT user_id) AS n_sessions,
  string_agg(DISTINCT CAST(user_id AS VARCHAR), ', ' ORDER BY CAST(user_id AS VARCHAR)) AS sessions
FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(DISTINCT user_id) >= 3"""
)
def p0_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.priority_alerts(tool_errors(spark, sf_dir))
    return found.select("tool_name", F.size("sessions").cast("long").alias("n_sessions"), F.array_join("sessions", ", ").alias("sessions"))


SHOWN = ("event_id", "event_class", "actor_ref")


@query(f"WITH {LEDGER} SELECT event_id, event_class, actor_ref FROM ledger ORDER BY timestamp DESC, event_id LIMIT 100")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.recent(ledger_events(spark, sf_dir), 100).select(*SHOWN)


@query(f"WITH {LEDGER} SELECT event_id, event_class, actor_ref FROM ledger WHERE event_class = 'error' ORDER BY timestamp DESC, event_id LIMIT 100")
def events_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.recent(ledger_events(spark, sf_dir), 100, F.col("event_class") == "error").select(*SHOWN)


@query(f"WITH {LEDGER} SELECT event_id, event_class, actor_ref FROM ledger WHERE actor_ref = 'user:7' ORDER BY timestamp DESC, event_id LIMIT 100")
def events_by_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.recent(ledger_events(spark, sf_dir), 100, F.col("actor_ref") == "user:7").select(*SHOWN)


@query(f"WITH {LEDGER} SELECT event_id, event_class, actor_ref FROM ledger WHERE object_ref = 'subsystem:click' ORDER BY timestamp DESC, event_id LIMIT 50")
def events_for_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.recent(ledger_events(spark, sf_dir), 50, F.col("object_ref") == "subsystem:click").select(*SHOWN)


@query(f"WITH {LEDGER} SELECT event_id, event_class, actor_ref FROM ledger WHERE correlation_id = '7'")
def events_by_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.correlated(ledger_events(spark, sf_dir), "7").select(*SHOWN)


@query(
    f"""WITH {LEDGER}, newest AS (SELECT * FROM ledger ORDER BY timestamp DESC, event_id LIMIT 250)
SELECT event_id, event_class, actor_ref FROM newest WHERE object_ref LIKE 'subsystem:p%' OR object_ref = 'subsystem:error' ORDER BY timestamp DESC, event_id LIMIT 50"""
)
def query_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.query(ledger_events(spark, sf_dir), 50, subsystems=("p*", "error"), exact=False).select(*SHOWN)


@query(
    f"""WITH {LEDGER} SELECT event_id, event_class, actor_ref FROM ledger
WHERE timestamp >= TIMESTAMP '2020-01-01' AND event_class = 'purchase' AND object_ref LIKE 'subsystem:p%' ORDER BY timestamp DESC, event_id LIMIT 50"""
)
def query_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.query(ledger_events(spark, sf_dir), 50, F.lit("2020-01-01").cast("timestamp"), "Purchase", ("p*",)).select(*SHOWN)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 20).cast("string").alias("source"), (F.col("o_orderkey") % 400 + 1).alias("source_seq"), F.col("o_orderstatus").alias("digest"), F.col("o_orderkey").alias("k"))


SEGMENTS = "seg AS (SELECT CAST(o_custkey % 20 AS VARCHAR) AS source, o_orderkey % 400 + 1 AS source_seq, o_orderstatus AS digest, o_orderkey AS k FROM orders)"


@query(
    f"""WITH {SEGMENTS}, top AS (SELECT source, max(source_seq) AS m FROM seg GROUP BY source),
expected AS (SELECT source, unnest(generate_series(1, m)) AS missing FROM top)
SELECT e.source, e.missing FROM expected e WHERE NOT EXISTS (SELECT 1 FROM seg s WHERE s.source = e.source AND s.source_seq = e.missing)"""
)
def seq_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.gaps(segments(spark, sf_dir))


@query(f"WITH {SEGMENTS} SELECT source, max(source_seq) AS latest_seq, count(*) AS segments FROM seg GROUP BY source")
def latest_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(segments(spark, sf_dir))


@query("SELECT (SELECT count(*) FROM events) AS n_events, (SELECT count(*) FROM orders) AS n_segments")
def projection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").agg(F.count("*").alias("n_events"))
    return e.crossJoin(read(spark, sf_dir, "orders").agg(F.count("*").alias("n_segments")))  # one row each


INCOMING = """inc AS (SELECT CAST(o_custkey AS VARCHAR) AS source, o_orderkey AS source_seq, md5(o_orderstatus) AS digest FROM orders),
store AS (SELECT CAST(o_custkey AS VARCHAR) AS source, o_orderkey AS source_seq, md5(CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderstatus END) AS digest FROM orders WHERE o_orderkey % 3 = 0)"""


def incoming_and_store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders")
    key = [F.col("o_custkey").cast("string").alias("source"), F.col("o_orderkey").alias("source_seq")]
    held = F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_orderstatus"))
    return o.select(*key, F.md5(F.col("o_orderstatus").cast("binary")).alias("digest")), o.filter("o_orderkey % 3 = 0").select(*key, F.md5(held.cast("binary")).alias("digest"))


@query(
    f"""WITH {INCOMING} SELECT i.source, i.source_seq, CASE WHEN s.digest IS NULL THEN 'committed' WHEN s.digest = i.digest THEN 'skipped' ELSE 'failed' END AS outcome
FROM inc i LEFT JOIN store s USING (source, source_seq)"""
)
def ingest_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ingest_outcomes(*incoming_and_store(spark, sf_dir)).select("source", "source_seq", "outcome")


@query(
    f"""WITH {INCOMING}, o AS (SELECT CASE WHEN s.digest IS NULL THEN 'committed' WHEN s.digest = i.digest THEN 'skipped' ELSE 'failed' END AS outcome
FROM inc i LEFT JOIN store s USING (source, source_seq)) SELECT outcome, count(*) AS n FROM o GROUP BY outcome"""
)
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ingest_outcomes(*incoming_and_store(spark, sf_dir)).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {INCOMING} SELECT source, source_seq FROM inc EXCEPT SELECT source, source_seq FROM store")
def index_refresh_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed, ingested = incoming_and_store(spark, sf_dir)
    return ledger.new_segments(listed, ingested).select("source", "source_seq")


@query(
    """WITH b AS (SELECT l_partkey AS event_id, CAST(l_suppkey AS VARCHAR) AS source, l_orderkey * 10 + l_linenumber AS source_seq FROM lineitem),
stored AS (SELECT p_partkey AS event_id FROM part WHERE p_size < 25)
SELECT event_id, source, source_seq FROM b WHERE event_id NOT IN (SELECT event_id FROM stored)
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY source, source_seq) = 1"""
)
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("event_id"), F.col("l_suppkey").cast("string").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_seq"))
    stored = read(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").alias("event_id"))
    return ledger.new_events(batch, stored).select("event_id", "source", "source_seq")


MARKS = """marks AS (SELECT source, 200 AS mark FROM (SELECT DISTINCT source FROM seg) WHERE CAST(source AS INT) % 2 = 0),
again AS (SELECT source, source_seq FROM seg WHERE k % 17 = 0)"""


@query(
    f"""WITH {SEGMENTS}, {MARKS} SELECT s.source, s.source_seq, s.k FROM seg s LEFT JOIN marks m USING (source)
WHERE s.source_seq > coalesce(m.mark, 0) OR EXISTS (SELECT 1 FROM again a WHERE a.source = s.source AND a.source_seq = s.source_seq)"""
)
def verify_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    marks = seg.select("source").distinct().filter(F.col("source").cast("int") % 2 == 0).select("source", F.lit(200).alias("mark"))
    again = seg.filter("k % 17 = 0")
    return ledger.to_verify(seg, marks, again.filter("k % 2 = 0"), again.filter("k % 2 = 1")).select("source", "source_seq", "k")


@query(
    f"""WITH {SEGMENTS}, bad AS (SELECT source, min(source_seq) AS f FROM seg WHERE k % 53 = 0 GROUP BY source)
SELECT s.source, coalesce(max(s.source_seq) FILTER (WHERE b.f IS NULL OR s.source_seq < b.f), 0) AS mark FROM seg s LEFT JOIN bad b USING (source) GROUP BY s.source"""
)
def contiguous_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = segments(spark, sf_dir).groupBy("source", "source_seq").agg(F.bool_or(F.col("k") % 53 == 0).alias("bad"))
    return windows.contiguous_mark(once, "source", "source_seq", F.col("bad")).withColumn("mark", F.coalesce("mark", F.lit(0)))


# Sessions.


@query(
    """SELECT c_nationkey || '/' || c_mktsegment AS dedupe_key, c_custkey AS path FROM customer
QUALIFY row_number() OVER (PARTITION BY c_nationkey || '/' || c_mktsegment ORDER BY c_custkey % 3, c_custkey) = 1"""
)
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    handles = c.select(F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("dedupe_key"), (F.col("c_custkey") % 3).alias("reader_rank"), F.col("c_custkey").alias("path"))
    return ledger.first_reader_wins(handles).select("dedupe_key", "path")


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS session_id FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey % 100 NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"""
)
def unprocessed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    handles = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("session_id"), (F.col("c_custkey") % 100).cast("string").alias("dedupe_key"))
    done = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("id"))
    return ledger.unseen(handles, done).select("session_id")


@query(
    """SELECT c_custkey FROM customer WHERE c_acctbal >= 5000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' UNION SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '2%')"""
)
def pending_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    pending = o.filter("o_orderpriority LIKE '1%'").select("o_custkey").union(o.filter("o_orderpriority LIKE '2%'").select("o_custkey")).distinct()
    c = read(spark, sf_dir, "customer")
    return c.join(pending, c["c_custkey"] == pending["o_custkey"], "left").filter("c_acctbal >= 5000 OR o_custkey IS NOT NULL").select("c_custkey")


# Detectors on messages.

TEST_PATTERNS = (r"(?i)(^|[^a-z])the([^a-z]|$)", r"(?i)^in ")
TEST_LABELS = (("that", r"(?i)(^|[^a-z])that([^a-z]|$)"), ("le", r"(?i)(^|[^a-z])le([^a-z]|$)"), ("der", r"(?i)(^|[^a-z])der([^a-z]|$)"))
SQL_LABELS = "CASE WHEN regexp_matches(text, '(?i)(^|[^a-z])that([^a-z]|$)') THEN 'that' WHEN regexp_matches(text, '(?i)(^|[^a-z])le([^a-z]|$)') THEN 'le' WHEN regexp_matches(text, '(?i)(^|[^a-z])der([^a-z]|$)') THEN 'der' END"
SQL_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(
    rf"""WITH p AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, {SQL_TRIM} AS context FROM p
WHERE role = 'user' AND before = 'assistant' AND after = 'assistant' AND octet_length(encode(text)) <= 400 AND octet_length(encode({SQL_TRIM})) >= 15
  AND NOT ends_with({SQL_TRIM}, '?') AND (regexp_matches({SQL_TRIM}, '(?i)(^|[^a-z])the([^a-z]|$)') OR regexp_matches({SQL_TRIM}, '(?i)^in '))"""
)
def correction_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.corrections(messages(spark, sf_dir), TEST_PATTERNS, high=400)


@query(f"SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, {SQL_LABELS} AS pattern, substr(text, 1, 200) AS context FROM conversations WHERE role = 'assistant' AND {SQL_LABELS} IS NOT NULL")
def workaround_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.workarounds(messages(spark, sf_dir), TEST_LABELS)


@query(f"SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, {SQL_LABELS} AS item FROM conversations WHERE role = 'assistant' AND {SQL_LABELS} IS NOT NULL")
def deferral_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.deferrals(messages(spark, sf_dir), TEST_LABELS)


@query(
    """SELECT event_id AS seq, user_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'unknown') AS tool_name FROM events"""
)
def tool_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("call", F.when(F.col("event_type") == "signup", F.col("props")))
    return e.select(F.col("event_id").alias("seq"), "user_id", windows.latest_name(e, ["user_id"], ["event_id"], "call", "unknown").alias("tool_name"))


@query(
    """SELECT e.event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'absent' ELSE 'text' END AS kind, json_extract_string(props, '$.k') AS k,
  CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS digit FROM events e"""
)
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    k = C.as_string(C.at(F.col("v"), "$.k"))
    return e.select("event_id", F.when(k.isNull(), "absent").otherwise("text").alias("kind"), k.alias("k"), (k.cast("long") % 10).alias("digit"))


# Health patterns.

TEST_LIMITS = health.Limits(compactions=2, compaction_span="20 DAYS", resumes=2, resume_span="20 DAYS", loop=2, runaway=3)


def _storm_sql(kind: str) -> str:
    return f"""WITH {SESSION_EVENTS}, c AS (SELECT session_id, ts AS stop, count(*) OVER w AS n, min(ts) OVER w AS start FROM se WHERE kind = '{kind}'
  WINDOW w AS (PARTITION BY session_id ORDER BY ts RANGE BETWEEN INTERVAL 20 DAYS PRECEDING AND CURRENT ROW))
SELECT session_id, n || ' {kind}s ' || strftime(start, '%H:%M') || '-' || strftime(stop, '%H:%M') AS evidence FROM c WHERE n >= 2
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, stop) = 1"""


@query(_storm_sql("compaction"))
def compaction_storms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.compaction_storms(session_events(spark, sf_dir), TEST_LIMITS).select("session_id", "evidence")


@query(_storm_sql("resume"))
def resume_storms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.resume_storms(session_events(spark, sf_dir), TEST_LIMITS).select("session_id", "evidence")


@query(
    f"""WITH {SESSION_EVENTS}, t AS (SELECT * FROM se WHERE kind = 'tool_call'),
f AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND detail IS NOT DISTINCT FROM lag(detail) OVER w THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
i AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT session_id, min(seq) AS at, '`' || min(tool_name) || '` x' || count(*) || ' identical arguments ' || strftime(arg_min(ts, seq), '%H:%M') || '-' || strftime(arg_max(ts, seq), '%H:%M') AS evidence
FROM i GROUP BY session_id, island HAVING count(*) >= 2"""
)
def stuck_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.stuck_loops(session_events(spark, sf_dir), TEST_LIMITS).select("session_id", "at", "evidence")


@query(
    f"""WITH {SESSION_EVENTS}, s AS (SELECT *, sum(CASE WHEN kind = 'user_message' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS stretch FROM se),
g AS (SELECT session_id, stretch, count(*) AS n, arg_min(ts, seq) AS start, arg_max(ts, seq) AS stop FROM s WHERE kind = 'tool_call' GROUP BY session_id, stretch HAVING count(*) >= 3)
SELECT session_id, n || ' tool calls without a user message ' || strftime(start, '%H:%M') || '-' || strftime(stop, '%H:%M') AS evidence FROM g
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, stretch) = 1"""
)
def runaway_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.runaways(session_events(spark, sf_dir), TEST_LIMITS).select("session_id", "evidence")


# Signals, identities, the ledger.


@query(
    """WITH e AS (SELECT 'error:' || user_id || ':' || event_type AS id, event_id AS seq FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM e) SELECT seq, CASE WHEN n > 1 THEN id || '#' || n ELSE id END AS id FROM n"""
)
def repeat_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.concat_ws(":", F.lit("error"), "user_id", "event_type").alias("id"), F.col("event_id").alias("seq"))
    return windows.numbered_repeats(e, "id", ["seq"])


@query(
    """WITH t AS (SELECT p_partkey, length(p_brand) || ':' || p_brand || length(p_name) || ':' || p_name AS s FROM part),
b AS (SELECT p_partkey, list_transform(generate_series(1, length(s)), lambda i: CAST(ascii(s[i]) AS UHUGEINT)) AS bytes FROM t)
SELECT p_partkey, lower(printf('%016x', list_reduce(list_prepend(14695981039346656037::UHUGEINT, bytes),
  lambda h, x: (CAST(xor(CAST(h AS UBIGINT), CAST(x AS UBIGINT)) AS UHUGEINT) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)) AS hash FROM b"""
)
def fnv_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", hashing.fields_hash(F.col("p_brand"), F.col("p_name")).alias("hash"))


LEDGER_STATE = """ledger AS (SELECT 'order:' || o_orderkey AS id, o_orderkey % 3 = 0 AS counted, o_orderkey % 2 = 0 AS filed, CAST(o_orderdate AS DATE) AS first_seen, o_orderdate AS session_modified FROM orders WHERE o_orderkey % 5 <> 0),
sig AS (SELECT l_orderkey, l_linenumber, 'order:' || l_orderkey AS id FROM lineitem)"""


def ledger_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0")
    return o.select(F.concat(F.lit("order:"), F.col("o_orderkey")).alias("id"), (F.col("o_orderkey") % 3 == 0).alias("counted"), (F.col("o_orderkey") % 2 == 0).alias("filed"), F.to_date("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("session_modified"))


@query(
    f"""WITH {LEDGER_STATE} SELECT l_orderkey, l_linenumber, NOT coalesce(l.counted, false) AS is_new, NOT coalesce(l.filed, false) AS to_offer FROM sig s LEFT JOIN ledger l USING (id)"""
)
def ledger_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("order:"), F.col("l_orderkey")).alias("id"))
    return signals.split_by_ledger(sig, ledger_state(spark, sf_dir)).drop("id")


@query(
    f"""WITH {LEDGER_STATE}, marks AS (SELECT id, true AS counted, false AS filed, DATE '1998-08-01' AS first_seen, TIMESTAMP '1998-08-01' AS session_modified FROM ledger WHERE NOT counted),
f AS (SELECT id, min(first_seen) AS first_seen, bool_or(counted) AS counted, bool_or(filed) AS filed, max(session_modified) AS m FROM (SELECT * FROM ledger UNION ALL BY NAME SELECT * FROM marks) GROUP BY id)
SELECT id, CAST(first_seen AS VARCHAR) AS first_seen, counted, filed, {sql_stamp("m")} AS modified FROM f WHERE first_seen >= DATE '1998-08-01' - 900 AND (counted OR filed)"""
)
def merged_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = ledger_state(spark, sf_dir)
    marks = state.filter("NOT counted").select("id", F.lit(True).alias("counted"), F.lit(False).alias("filed"), F.lit("1998-08-01").cast("date").alias("first_seen"), F.lit("1998-08-01").cast("timestamp").alias("session_modified"))
    kept = signals.merged_ledger(state, marks, F.lit("1998-08-01").cast("date"), 900)
    return kept.select("id", F.col("first_seen").cast("string").alias("first_seen"), "counted", "filed", stamp(F.col("session_modified")).alias("modified"))


@query(
    """SELECT count(*) FILTER (WHERE event_type = 'click') AS corrections, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'view') AS workarounds,
  count(*) FILTER (WHERE event_type = 'signup') AS deferrals, count(*) FILTER (WHERE event_type = 'purchase') AS patterns, count(*) AS total FROM events WHERE value > 10"""
)
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for p in (("click", "correction"), ("error", "error"), ("view", "workaround"), ("signup", "deferral"), ("purchase", "pattern")) for x in p])
    return signals.kind_counts(read(spark, sf_dir, "events").withColumn("kind", kind[F.col("event_type")]), F.col("value") > 10)


@query(
    """WITH t AS (SELECT doc_id, source || ': ' || replace(substr(text, 1, 80), chr(10), ' ') AS title FROM documents), c AS (SELECT title, count(*) AS n, min(doc_id) AS first FROM t GROUP BY title)
SELECT title, n, first FROM c WHERE n > 1"""
)
def title_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    titled = d.select("doc_id", F.concat(F.col("source"), F.lit(": "), F.replace(X.truncated(F.col("text"), 80), F.lit("\n"), F.lit(" "))).alias("title"))
    return titled.groupBy("title").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


# Rollups.


@query(
    f"""WITH {USAGE} SELECT CASE WHEN grouping(r) = 1 THEN NULL ELSE r END AS role, CAST(sum(cost) AS VARCHAR) AS cost, count(*) AS sessions, count(cost) AS sessions_with_cost,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens
FROM (SELECT *, coalesce(role, '(root)') AS r FROM usage) GROUP BY ROLLUP (r)"""
)
def spend_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.spend(usage(spark, sf_dir)).withColumn("cost", money(F.col("cost")))


@query(f"WITH {USAGE} SELECT model, CAST(sum(cost) AS VARCHAR) AS cost FROM usage GROUP BY model")
def spend_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.spend_by_model(usage(spark, sf_dir)).withColumn("cost", money(F.col("cost")))


@query(
    f"""WITH {USAGE} SELECT session_id, CAST(sum(cost) AS VARCHAR) AS cost, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM usage GROUP BY session_id"""
)
def usage_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.usage_sums(usage(spark, sf_dir)).withColumn("cost", money(F.col("cost")))


PERSONAS = """s AS (SELECT CAST(c_custkey AS VARCHAR) AS session_id, CASE WHEN c_custkey % 7 <> 0 THEN n_name END AS persona, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS channel FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'view') AS patterns FROM events GROUP BY user_id),
u AS (SELECT session_id, sum(cost) AS cost, sum(input_tokens) AS i, sum(output_tokens) AS o FROM usage GROUP BY session_id)"""


@query(
    f"""WITH {USAGE}, {PERSONAS} SELECT persona, channel, count(*) AS sessions, CAST(coalesce(sum(errors), 0) AS BIGINT) AS errors, CAST(coalesce(sum(patterns), 0) AS BIGINT) AS patterns,
  CAST(coalesce(sum(i), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(o), 0) AS BIGINT) AS output_tokens, CAST(sum(cost) AS VARCHAR) AS cost,
  CASE WHEN channel IS NULL THEN persona ELSE persona || '@' || channel END AS key
FROM s LEFT JOIN k USING (session_id) LEFT JOIN u USING (session_id) WHERE persona IS NOT NULL GROUP BY persona, channel"""
)
def persona_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sessions = c.select(F.col("c_custkey").cast("string").alias("session_id"), F.when(F.col("c_custkey") % 7 != 0, F.col("n_name")).alias("persona"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("channel"))
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "pattern")
    found = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), kind.alias("kind"))
    folded = rollup.personas(sessions, found, rollup.usage_sums(usage(spark, sf_dir)))
    return rollup.with_display_key(folded).withColumn("cost", money(F.col("cost"))).drop("corrections", "workarounds", "deferrals")


DAILY = """daily AS (SELECT date, 'total' AS dim, 'all' AS name, cost FROM usage UNION ALL SELECT date, 'agent', role, cost FROM usage WHERE role IS NOT NULL UNION ALL SELECT date, 'model', model, cost FROM usage)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage(spark, sf_dir)
    total = u.select("date", F.lit("total").alias("dim"), F.lit("all").alias("name"), "cost")
    return total.union(u.filter("role IS NOT NULL").select("date", F.lit("agent"), "role", "cost")).union(u.select("date", F.lit("model"), "model", "cost"))


@query(
    f"""WITH {USAGE}, {DAILY}, m AS (SELECT max(date) AS d FROM usage) SELECT dim, name, CAST(sum(cost) AS VARCHAR) AS cost, count(DISTINCT date) AS days
FROM daily, m WHERE date BETWEEN d - 7 AND d - 1 GROUP BY dim, name"""
)
def archive_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily(spark, sf_dir)
    last = F.lit(read(spark, sf_dir, "orders").agg(F.max(F.to_date("o_orderdate"))).first()[0])
    return rollup.archive_period(rows, F.date_sub(last, 7), F.date_sub(last, 1)).withColumn("cost", money(F.col("cost")))


@query(f"WITH {USAGE} SELECT model AS name, CAST(sum(cost) AS VARCHAR) AS cost FROM usage GROUP BY model ORDER BY sum(cost) DESC, model LIMIT 3")
def top_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = rollup.spend_by_model(usage(spark, sf_dir)).withColumnRenamed("model", "name")
    return rollup.top_costs(costs, 3).withColumn("cost", money(F.col("cost")))


@query(
    f"""WITH {USAGE}, sig AS (SELECT DISTINCT event_type || '/' || json_extract_string(props, '$.k') AS title, CAST(user_id AS VARCHAR) AS session_id FROM events),
open AS (SELECT DISTINCT event_type || '/' || json_extract_string(props, '$.k') AS title FROM events WHERE value > 80), c AS (SELECT session_id, sum(cost) AS cost FROM usage GROUP BY session_id HAVING sum(cost) IS NOT NULL)
SELECT title, CAST(sum(cost) AS VARCHAR) AS cost FROM sig JOIN c USING (session_id) WHERE title IN (SELECT title FROM open) GROUP BY title"""
)
def recurrence_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.lit("error").alias("kind"), F.concat(F.col("event_type"), F.lit("/"), F.get_json_object("props", "$.k")).alias("title"), F.col("user_id").cast("string").alias("session_id"), "value")
    return rollup.recurrence_costs(e, e.filter("value > 80"), rollup.usage_sums(usage(spark, sf_dir))).withColumn("cost", money(F.col("cost")))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS expires FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1996-01-01' AND o_orderstatus = 'O'")
def expired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return o.select("o_orderkey", F.to_date("o_orderdate").alias("expires")).filter(F.col("expires") < F.lit("1996-01-01").cast("date")).withColumn("expires", F.col("expires").cast("string"))


@query(
    """SELECT event_type AS host, CAST(CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS VARCHAR) AS day, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS latest FROM events GROUP BY 1, 2"""
)
def local_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    day = F.to_date(F.from_utc_timestamp("ts", "America/New_York")).cast("string")
    return e.groupBy(F.col("event_type").alias("host"), day.alias("day")).agg(F.count("*").alias("n"), stamp(F.max("ts")).alias("latest"))


@query("SELECT user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS newest FROM events GROUP BY user_id")
def argmax_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"))


# Scalar functions.


@query(
    r"""WITH m AS (SELECT conv_id, turn, '<message from="' || role || '">' || replace(text, '&', '&amp;') || ' &lt;b&gt;</message><message> ' || turn || ' </message>' AS x FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_extract_all(x, '(?s)<message\b[^>]*>(.*?)</message>', 1),
  lambda t: regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '^\s+|\s+$', '', 'g')), lambda t: t <> ''), chr(10)) AS said FROM m"""
)
def envelope_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    x = F.concat(F.lit('<message from="'), F.col("role"), F.lit('">'), F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit(" &lt;b&gt;</message><message> "), F.col("turn"), F.lit(" </message>"))
    return c.select("conv_id", "turn", X.envelope_text(x).alias("said"))


@query(
    r"""SELECT p_partkey, '''' || replace(replace(replace(p_name || chr(9) || chr(7) || '''' || '\', '\', '\\'), '''', '\'''), chr(9), '\t') || '''' AS raw FROM part"""
)
def quoted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    told = X.quoted(F.concat(F.col("p_name"), F.lit("\t\x07'\\")))
    return p.select("p_partkey", F.replace(told, F.lit("\\x07"), F.lit("\x07")).alias("raw"))


@query(r"SELECT p_partkey, replace(regexp_replace('`' || p_name || chr(10) || p_brand, '[[:cntrl:]]', ' ', 'g'), '`', '''') AS shown FROM part")
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", X.display_safe(F.concat(F.lit("`"), F.col("p_name"), F.lit("\n"), F.col("p_brand"))).alias("shown"))


@query(
    """WITH h AS (SELECT c_custkey, md5(c_name) AS m FROM customer), t AS (SELECT c_custkey, 'rollout-' || m || '-' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS x FROM h)
SELECT c_custkey, nullif(regexp_extract(x, '([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$', 1), '') AS uuid FROM t"""
)
def uuid_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.md5(F.col("c_name").cast("binary"))
    parts = [F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return read(spark, sf_dir, "customer").select("c_custkey", X.trailing_uuid(F.concat(F.lit("rollout-"), m, F.lit("-"), F.concat_ws("-", *parts))).alias("uuid"))


@query(r"SELECT c_custkey, nullif(regexp_extract(replace(c_name, '#', '_') || '_' || c_mktsegment, '(?s)^[^_]*_(.+)$', 1), '') AS role, 'x:' || c_name LIKE 'agent%' AS sub FROM customer")
def role_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat(F.replace("c_name", F.lit("#"), F.lit("_")), F.lit("_"), F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select("c_custkey", X.session_role(x).alias("role"), X.is_sub_agent(F.concat(F.lit("x:"), F.col("c_name"))).alias("sub"))


@query("SELECT o_orderkey, '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS shown FROM orders")
def format_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", X.dollars(F.col("o_totalprice").cast("decimal(18,2)").cast(rollup.COST)).alias("shown"))


@query("SELECT l_orderkey, l_linenumber, printf('s%d-%06d.json', l_suppkey, l_orderkey) AS name, length('s' || l_suppkey) <= 64 AS valid FROM lineitem")
def segment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit("s"), F.col("l_suppkey"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.segment_name(source, F.col("l_orderkey")).alias("name"), X.valid_source(source).alias("valid"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS zoned, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS naive, CAST(NULL AS VARCHAR) AS date_only FROM events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return e.select("event_id", stamp(X.parsed_time(F.concat(iso, F.lit("Z")))).alias("zoned"), stamp(X.parsed_time(iso)).alias("naive"), stamp(X.parsed_time(F.date_format("ts", "yyyy-MM-dd"))).alias("date_only"))
