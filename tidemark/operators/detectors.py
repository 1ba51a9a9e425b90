"""Detectors over messages: corrections, tool errors, workarounds, deferrals, priority alerts.

A message is (session_id, seq, role, content variant, name). Each detector is a
function from such a DataFrame to one of signals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import content as C
from tidemark.functions import text as X

#: The limits, marks and patterns of each detector, in order.
CORRECTION_MIN_BYTES, CORRECTION_MAX_BYTES = 15, 200
ERROR_MESSAGE_CHARS = 500
CONTEXT_CHARS = 200
ALERT_SESSIONS = 3
WORKAROUNDS = (
    ("for now", r"(?i)\bfor now\b"),
    ("temporary", r"(?i)\btemporary\b"),
    ("workaround", r"(?i)\bworkarounds?\b"),
    ("hardcoded", r"(?i)\bhard-?coded\b"),
    ("TODO", r"(?i)\bTODO\b"),
    ("FIXME", r"(?i)\bFIXME\b"),
    ("quick fix", r"(?i)\bquick fix\b"),
    ("hack", r"(?i)\bhack(s|y|ed|ing)?\b"),
)
DEFERRALS = (
    ("come back later", r"(?i)\bI'?ll come back to (this|that|it)"),
    ("deferring", r"(?i)\bdeferr?ing (this|that|it|until)"),
    ("defer", r"(?i)\bdefer (this|that|it)(?: (to|until|for))?"),
    ("punt", r"(?i)\bpunt(ing)? on (this|that|it)"),
    ("leave for later", r"(?i)\bleav(e|ing) (this|that|it) for (later|now|next)"),
    ("skipping for now", r"(?i)\bskipping for now"),
    ("park for now", r"(?i)\bpark(ing)? (this|that|it) for now"),
    ("next session", r"(?i)\bnext session"),
    ("circle back", r"(?i)\bcircle back (to|on)"),
)
CORRECTIONS = (
    r"(?i)^no[,.! ]",
    r"(?i)(^|[.;:!,-]\s*|\band\s+)(just\s+|please\s+)?(don['’]?t|do not)\b",
    r"(?i)\bplease stop\b",
    r"(?i)\bstop (doing|replying|posting|answering|sending|using|adding)\b",
    r"(?i)\bwrong\b",
    r"(?i)\bincorrect\b",
    r"(?i)\bnot (that|what|like that|right|the right)\b",
    r"(?i)\bshould(n['’]?t| not| never)\b",
    r"(?i)\bthat['’]?s not\b",
    r"(?i)\bI meant\b",
    r"(?i)\bnot what I\b",
    r"(?i)\bundo\b",
    r"(?i)\brevert\b",
    r"(?i)\byou missed\b",
    r"(?is)\b(still|wrong|same|broken|fail\w*|not)\b.*\bagain\b|\bagain\b.*\b(still|wrong|same|broken|fail\w*|not)\b",
    r"(?is)^actually\b.*\b(no|not|don['’]?t|instead|should|meant|wrong|use|change)\b",
)
SYSTEM_MARKS = ("[structured-output-enforce]", "<system-reminder>", "<command-name>", "<local-command-stdout>", "<task-notification>")
CONFIRMATIONS = ("ok", "okay", "looks good", "yes", "yep", "do it", "go ahead", "sounds good", "thanks", "lgtm")
REVIEW_HEADING = "## Files Examined"
REVIEW_VERDICT = r"(?im)^(?:#{1,6}[ \t]+)?(?:\*\*|__)?INDEPENDENT CODE REVIEW[ \t]+(?:PASSED|FAILED)[ \t]*(?:\*\*|__)?[ \t]*\r?$"
MEMORY_HEADING = "# Memory Index"
EXPECTED_RESULTS = (
    r"^Exit code \d+$",
    r"^The user doesn't want to (proceed with this tool use|take this action right now)\.",
    r"^Permission for this (action|command) was denied by ",
)
CALL_LEVEL = (r"^Exit code \d+\b", r"^<tool_use_error>", r"^PreToolUse:\S+ hook error", r"^The server returned HTTP 4\d{2}\b")
FETCH_TOOL, FETCH_FAILURE = "WebFetch", r"^The server returned HTTP [45]\d{2}\b"
TIMEOUT = r"(?i)^command timed out after \d+ seconds?\.?$"
TOP_KEYS, OUTPUT_KEYS, ERROR_KEYS = ("success", "error", "output", "message"), ("returncode", "stdout", "stderr"), ("message",)
WORKER_TOOLS = ("codex_trust_prompt", "same_model_review", "codex_fallback_main", "codex_missing_hook_state")


def where_once(df: DataFrame, condition: Column) -> DataFrame:
    """df filtered by a condition on columns that are dear to compute.

    Pushed down, the filter would repeat their expressions for each mention. A row
    number, always true here, keeps it above the projection that computes them.
    """
    return df.withColumn("_ok", condition & (F.monotonically_increasing_id() >= 0)).filter("_ok").drop("_ok")


def any_match(x: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | x.rlike(p)
    return out


def first_label(x: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """The label of the first pattern that matches, else null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, p in patterns:
        out = out.when(x.rlike(p), F.lit(label))
    return out


def has_system_mark(x: Column, marks: Sequence[str] = SYSTEM_MARKS) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | x.contains(m)
    return out


def is_review(x: Column) -> Column:
    return X.trim_start(x).startswith(REVIEW_HEADING) | x.rlike(REVIEW_VERDICT)


def is_memory_file(x: Column) -> Column:
    """An index file, or front matter that names and describes an entry."""
    t = X.trim_start(x)
    lines = F.transform(F.split(t, "\n"), lambda s: F.regexp_replace(s, r"\r$", ""))
    fence = F.transform(lines, lambda s: F.regexp_replace(s, r"(?U)\s+$", "") == "---")
    end = F.array_position(F.slice(fence, 2, F.greatest(F.size(fence) - 1, F.lit(0))), True)
    front = F.slice(lines, 2, F.greatest(end - 1, F.lit(0)).cast("int"))
    entry = (F.element_at(fence, 1)) & (end > 0) & F.exists(front, lambda s: s.startswith("name:")) & F.exists(front, lambda s: s.startswith("description:"))
    return t.startswith(MEMORY_HEADING) | entry


def is_confirmation(x: Column) -> Column:
    return F.lower(F.regexp_replace(X.trim_all(x), r"[.!]+$", "")).isin(*CONFIRMATIONS)


def is_correction(x: Column, patterns: Sequence[str] = CORRECTIONS, low: int = CORRECTION_MIN_BYTES, high: int = CORRECTION_MAX_BYTES) -> Column:
    """Cheap tests first: lengths in bytes, then marks, then patterns."""
    t = X.trim_all(x)
    return (F.octet_length(x) <= high) & (F.octet_length(t) >= low) & ~has_system_mark(x) & ~t.endswith("?") & ~is_confirmation(t) & any_match(t, patterns)


def corrections(messages: DataFrame, patterns: Sequence[str] = CORRECTIONS, low: int = CORRECTION_MIN_BYTES, high: int = CORRECTION_MAX_BYTES) -> DataFrame:
    """Short corrective user turns between two assistant turns: session_id, seq, context."""
    w = Window.partitionBy("session_id").orderBy("seq")
    placed = messages.select("session_id", "seq", "role", "content", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))
    turns = placed.filter("role = 'user' AND before = 'assistant' AND after = 'assistant'").filter(~C.has_block(F.col("content"), "tool_result"))
    said = turns.select("session_id", "seq", C.content_string(F.col("content")).alias("said"))
    return where_once(said, is_correction(F.col("said"), patterns, low, high)).select("session_id", "seq", X.trim_all(F.col("said")).alias("context"))


def _labelled(messages: DataFrame, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    said = messages.filter("role = 'assistant'").select("session_id", "seq", C.assistant_text(F.col("content")).alias("said"))
    labelled = said.withColumn("label", first_label(F.col("said"), patterns))
    return where_once(labelled, F.col("label").isNotNull() & ~has_system_mark(F.col("said")) & ~is_review(F.col("said")) & ~is_memory_file(F.col("said")))


def workarounds(messages: DataFrame, patterns: Sequence[tuple[str, str]] = WORKAROUNDS) -> DataFrame:
    """One a message, by the first pattern that matches: session_id, seq, pattern, context."""
    return _labelled(messages, patterns).select("session_id", "seq", F.col("label").alias("pattern"), X.truncated(F.col("said"), CONTEXT_CHARS).alias("context"))


def deferrals(messages: DataFrame, patterns: Sequence[tuple[str, str]] = DEFERRALS) -> DataFrame:
    return _labelled(messages, patterns).select("session_id", "seq", F.col("label").alias("item"))


def with_shape(df: DataFrame) -> DataFrame:
    """df with the parts of a failed result `data`, and the kind of each, as columns of their own."""
    parts = {"error": "$.error", "output": "$.output", "said": "$.message", "code": "$.output.returncode", "out": "$.output.stdout", "err": "$.output.stderr", "inner": "$.error.message"}
    wide = df.withColumns({f"_{n}": C.at(F.col("data"), p) for n, p in parts.items()})
    kinds = {f"_{n}_kind": F.coalesce(C.kind(F.col(f"_{n}")), F.lit("null")) for n in parts}
    return wide.withColumns(kinds | {"_data_kind": C.kind(F.col("data")), "_output_keys": C.keys(F.col("_output")), "_error_keys": C.keys(F.col("_error")), "_keys": C.keys(F.col("data"))})


def error_text() -> tuple[Column, Column]:
    """(kind, text) of the error: absent, text, or unrecognized; over columns of with_shape()."""
    e, m, i = F.col("_error_kind"), F.col("_said_kind"), F.col("_inner_kind")
    kind = F.when((e == "null") & (m == "null"), "absent").when(((e == "null") & (m == "string")) | ((m == "null") & ((e == "string") | (i == "string"))), "text").otherwise("unrecognized")
    text = F.when(e == "null", F.col("_said").try_cast("string")).when(e == "string", F.col("_error").try_cast("string")).otherwise(F.col("_inner").try_cast("string"))
    return kind, text


def is_mode_denial() -> Column:
    """The mode tool refusing a switch: by status, by the presence of a field, or by code."""
    data = F.col("data")
    by_code = F.coalesce(C.text_at(data, "$.error.code").endswith("_denied"), F.lit(False)) | F.coalesce(C.text_at(data, "$.code").endswith("_denied"), F.lit(False))
    by_status = F.coalesce(C.text_at(data, "$.output.status") == "denied", F.lit(False))
    return (F.col("tool_name") == "mode") & (by_status | F.array_contains("_output_keys", "denied_mode") | by_code)


def _within(keys: str, allowed: tuple[str, ...]) -> Column:
    return F.size(F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))) == 0


def _blank(stream: str) -> Column:
    """A stream that is absent, null or white space; false for any other kind of value."""
    kind = F.col(f"{stream}_kind")
    return (kind == "null") | ((kind == "string") & (X.trim_all(F.col(stream).try_cast("string")) == ""))


def is_empty_shell_failure() -> Column:
    """A shell call that timed out or exited nonzero and says nothing else at all; over columns of with_shape()."""
    e, o = F.col("_error_kind"), F.col("_output_kind")
    bare = (F.col("_data_kind") == "object") & _within("_keys", TOP_KEYS) & (e.isin("null", "string") | ((e == "object") & _within("_error_keys", ERROR_KEYS))) & (o.isin("null", "string") | ((o == "object") & _within("_output_keys", OUTPUT_KEYS)))
    code = C.compact(F.col("_code"))
    integer = (F.col("_code_kind") == "number") & code.rlike(r"^-?\d+$")
    said = X.trim_all(F.col("_output").try_cast("string"))
    blank = F.when(o == "null", True).when(o == "string", (said == "") | said.rlike(TIMEOUT)).otherwise((~F.array_contains("_output_keys", "returncode") | integer) & _blank("_out") & _blank("_err"))
    kind, text = error_text()
    timed_out = (kind == "text") & X.trim_all(text).rlike(TIMEOUT)
    exited = (kind == "absent") & integer & (code != "0")
    return (F.col("tool_name") == "bash") & F.coalesce(bare & blank & (timed_out | exited), F.lit(False))


def error_message(data: Column) -> Column:
    """The first of an error list, a scalar or object error, else the whole result."""
    error = C.at(data, "$.error")
    first = C.at(data, "$.error[0]")
    return F.when((C.kind(error) == "array") & first.isNotNull(), C.as_string(first)).when(~C.is_null(error) & (C.kind(error) != "array"), C.as_string(error)).otherwise(C.compact(data))


def errors(messages: DataFrame) -> DataFrame:
    """Failed tool calls of both shapes: session_id, seq, block, tool_name, message, call_level."""
    text = F.when(C.kind(F.col("content")) == "string", F.col("content").cast("string")).otherwise(C.compact(F.col("content")))
    results = messages.filter("role = 'tool'").select("session_id", "seq", F.coalesce("name", F.lit("unknown")).alias("tool_name"), F.try_parse_json(text).alias("data"))
    success = C.at(F.col("data"), "$.success")
    failed = where_once(results, F.coalesce((C.kind(success) == "boolean") & (success.try_cast("boolean") == F.lit(False)), F.lit(False)))
    loud = where_once(with_shape(failed), ~F.coalesce(is_mode_denial(), F.lit(False)) & ~is_empty_shell_failure())
    native = loud.select("session_id", "seq", F.lit(0).alias("block"), "tool_name", error_message(F.col("data")).alias("message"), F.lit(False).alias("call_level"))
    return native.unionByName(_block_errors(messages))


def _block_errors(messages: DataFrame) -> DataFrame:
    blocks = messages.filter("role IN ('assistant', 'user')").select("session_id", "seq", "role", F.posexplode(C.items(F.col("content"))).alias("block", "b"))
    calls = (F.col("role") == "assistant") & C.is_block(F.col("b"), "tool_use")
    answers = (F.col("role") == "user") & C.is_block(F.col("b"), "tool_result")
    both = blocks.filter(calls | answers).select(
        "session_id", "seq", "block", answers.alias("is_result"), F.when(calls, C.text_at(F.col("b"), "$.id")).otherwise(C.text_at(F.col("b"), "$.tool_use_id")).alias("id"), F.when(calls, C.text_at(F.col("b"), "$.name")).alias("name"), "b"
    )
    before = Window.partitionBy("session_id", "id").orderBy("seq", "block").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.col("is_result").cast("int")).over(before), F.lit(0))
    known = both.filter("id IS NOT NULL").withColumn("tool_name", F.coalesce(F.last("name", True).over(before), F.lit("unknown"))).withColumn("seen", seen).filter("is_result AND seen = 0").drop("seen")
    unknown = both.filter("id IS NULL AND is_result").withColumn("tool_name", F.lit("unknown"))
    told = known.unionByName(unknown).withColumn("message", C.result_text(C.at(F.col("b"), "$.content")))
    flag = C.at(F.col("b"), "$.is_error")
    flagged = F.coalesce((C.kind(flag) == "boolean") & flag.try_cast("boolean"), F.lit(False))
    failed = F.when(flagged, ~any_match(X.trim_all(F.col("message")), EXPECTED_RESULTS)).otherwise((F.col("tool_name") == FETCH_TOOL) & F.col("message").rlike(FETCH_FAILURE))
    return where_once(told, F.coalesce(failed, F.lit(False))).select("session_id", "seq", "block", "tool_name", "message", any_match(X.trim_start(F.col("message")), CALL_LEVEL).alias("call_level"))


def priority_alerts(found: DataFrame, least: int = ALERT_SESSIONS) -> DataFrame:
    """Tools that failed in least or more root sessions: tool_name, sessions (sorted)."""
    eligible = found.filter(~F.col("tool_name").isin(*WORKER_TOOLS) & ~F.col("call_level") & ~X.is_sub_agent(F.col("session_id")))
    grouped = eligible.select("tool_name", "session_id").distinct().groupBy("tool_name").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("session_id")).alias("sessions"))
    return grouped.filter(F.col("n") >= least).select("tool_name", "sessions")
