"""Readers of session files in each known format."""

from __future__ import annotations

import sqlite3
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import content as C
from tidemark.functions import text as X
from tidemark.operators import windows
from tidemark.sources import base
from tidemark.sources.base import Reader, directory, fitted, json_lines, parent, stem

def V() -> Column:
    """A line's JSON value."""
    return F.col("v")


def flat_messages(rows: DataFrame) -> DataFrame:
    """Lines that are messages themselves."""
    return fitted(rows.select("path", "seq", C.text_at(V(), "$.role").alias("role"), C.at(V(), "$.content").alias("content"), C.text_at(V(), "$.name").alias("name")), base.MESSAGES)


def first_of_links(listed: DataFrame) -> DataFrame:
    """Of files that are one and the same behind links, the one of the smallest rank and path."""
    return windows.first_rows(listed.withColumn("real", base.canonical("path")), ["real"], ["rank", "path"]).drop("real")


def _time(v: Column) -> Column:
    return X.parsed_time(F.coalesce(C.text_at(v, "$.timestamp"), C.text_at(v, "$.ts")))


class EventLog:
    """Messages, events and usage of event lines {event, timestamp, data}."""

    @staticmethod
    def messages(rows: DataFrame) -> DataFrame:
        kind = C.text_at(V(), "$.event")
        said = C.block_texts(C.at(V(), "$.data.raw.content"))
        made = (
            F.when(kind == "prompt:submit", F.struct(F.lit("user").alias("role"), C.at(V(), "$.data.prompt").alias("content"), F.lit(None).cast("string").alias("name")))
            .when((kind == "llm:response") & (said != ""), F.struct(F.lit("assistant").alias("role"), said.cast("variant").alias("content"), F.lit(None).cast("string").alias("name")))
            .when(kind == "tool:post", F.struct(F.lit("tool").alias("role"), F.coalesce(C.at(V(), "$.data.result"), F.parse_json(F.lit("null"))).alias("content"), F.nullif(C.text_at(V(), "$.data.tool_name"), F.lit("")).alias("name")))
        )
        return fitted(rows.select("path", "seq", made.alias("m")).filter("m IS NOT NULL").select("path", "seq", "m.*"), base.MESSAGES)

    @staticmethod
    def events(rows: DataFrame) -> DataFrame:
        kinds = {"context:compaction": "compaction", "session:resume": "resume", "tool:pre": "tool_call", "llm:response": "llm_response", "prompt:submit": "user_message"}
        kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[C.text_at(V(), "$.event")]
        call = F.col("kind") == "tool_call"
        made = rows.select("path", "seq", "v", kind.alias("kind"), _time(V()).alias("ts")).filter("kind IS NOT NULL AND ts IS NOT NULL")
        return fitted(made.select("path", "seq", "kind", "ts", F.when(call, C.text_at(V(), "$.data.tool_name")).alias("tool_name"), F.when(call, C.compact(C.at(V(), "$.data.tool_input"))).alias("detail")), base.EVENTS)

    @staticmethod
    def usage(rows: DataFrame) -> DataFrame:
        priced = rows.filter((C.text_at(V(), "$.event") == "llm:response") & (C.kind(C.at(V(), "$.data.usage")) == "object"))
        model = F.coalesce(C.text_at(V(), "$.data.model"), C.text_at(V(), "$.data.raw.model"))
        return fitted(priced.select("path", "seq", model.alias("model"), base.decimal_at(V(), "$.data.usage.cost_usd").alias("cost"), base.long_at(V(), "$.data.usage.input_tokens").alias("input_tokens"), base.long_at(V(), "$.data.usage.output_tokens").alias("output_tokens")), base.USAGE)


class SessionFolders(Reader):
    """A folder for each session, with a transcript, an event log, or both."""

    name = "amplifier"

    def _files(self) -> DataFrame:
        path = F.col("path")
        rank = F.when(path.rlike("/sessions/[^/]+/transcript[.]jsonl$"), 1).when(path.endswith("/transcript.jsonl"), 0).otherwise(2)
        listed = self._listed("/transcript[.]jsonl$|/sessions/[^/]+/events[.]jsonl$")
        return windows.first_rows(listed.withColumns({"dir": parent(path), "rank": rank}), ["dir"], ["rank", "path"])

    def sessions(self) -> DataFrame:
        return self._named(self._files(), directory(F.col("path")))

    def _own(self, rows: DataFrame) -> DataFrame:
        """Rows of a session's event log under the path that names the session."""
        files = self._files().select(F.col("path").alias("_path"), "dir")
        return rows.withColumn("dir", parent(F.col("path"))).join(files, "dir").drop("dir", "path").withColumnRenamed("_path", "path")

    def messages(self) -> DataFrame:
        files = self._files().select("path")
        flat = flat_messages(json_lines(self._lines("/transcript[.]jsonl$")))
        made = EventLog.messages(json_lines(self._lines("/sessions/[^/]+/events[.]jsonl$")))
        return flat.unionByName(made).join(files, "path", "left_semi")

    def events(self) -> DataFrame:
        return fitted(self._own(EventLog.events(json_lines(self._lines("/events[.]jsonl$")))), base.EVENTS)

    def usage(self) -> DataFrame:
        return fitted(self._own(EventLog.usage(json_lines(self._lines("/events[.]jsonl$")))), base.USAGE)


class IndexedEvents(Reader):
    """Event logs beside a metadata file, whose format and major version are checked."""

    name = "context-intelligence"
    FORMAT, MAJOR = "context-intelligence", "1"
    PATTERN = "/sessions/[^/]+/context-intelligence/"
    pattern = f"{PATTERN}events[.]jsonl$"

    def _admitted(self) -> DataFrame:
        meta = json_lines(self._lines(f"{self.PATTERN}metadata[.]json$", "metadata.json").groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("line")))
        fits = (C.text_at(V(), "$.format") == self.FORMAT) & C.text_at(V(), "$.version").rlike(rf"^{self.MAJOR}\.")
        good = meta.filter(fits).select(parent(F.col("path")).alias("dir"), X.parsed_time(C.text_at(V(), "$.last_event_at")).alias("last"))
        return self._listed().withColumn("dir", parent(F.col("path"))).join(good, "dir").select("path", F.coalesce("last", "modified").alias("modified"))

    def _rows(self) -> DataFrame:
        return json_lines(self._lines()).join(self._admitted().select("path"), "path", "left_semi")

    def sessions(self) -> DataFrame:
        return self._named(self._admitted(), directory(F.col("path"), 2))

    def messages(self) -> DataFrame:
        return EventLog.messages(self._rows())

    def events(self) -> DataFrame:
        return EventLog.events(self._rows())

    def usage(self) -> DataFrame:
        return EventLog.usage(self._rows())


class WrappedLines(Reader):
    """Lines {type, message: {role, content}} or plain messages; copies inside request blobs are dropped."""

    name = "claude-code"

    def __init__(self, spark: SparkSession, roots: Sequence[str], profiles: str | None = None, default_seat: str | None = None):
        super().__init__(spark, [*roots, *([f"{profiles}/*/projects"] if profiles else [])])
        self.own, self.profiles, self.default_seat = list(roots), profiles, default_seat

    def sessions(self) -> DataFrame:
        if not self.profiles and len(self.own) < 2:
            return self._named(self._listed(), stem(F.col("path")), seat=F.lit(self.default_seat))
        # The roots come first, in order; a file that several reach is read under its first path.
        parts = [base.listed_files(self.spark, [r], self.pattern).withColumn("rank", F.lit(i)) for i, r in enumerate(sorted(set(self.own)))]
        if self.profiles:
            parts.append(base.listed_files(self.spark, [f"{self.profiles}/*/projects"], self.pattern).withColumn("rank", F.lit(len(self.own))))
        listed = first_of_links(reduce(DataFrame.unionByName, parts))
        profile = F.nullif(F.regexp_extract("path", "([^/]+)/projects/", 1), F.lit(""))
        named = self._named(listed, stem(F.col("path"))).drop("seat").join(listed.select("path", "rank"), "path")
        return fitted(named.withColumn("seat", F.when(F.col("rank") < len(self.own), F.lit(self.default_seat)).otherwise(profile)), base.SESSIONS)

    def messages(self) -> DataFrame:
        outer = C.text_at(V(), "$.type")
        rows = json_lines(self._lines()).filter(~F.coalesce(outer == "api-request-blob", F.lit(False)))
        inner = C.at(V(), "$.message")
        wrapped = C.kind(inner) == "object"
        m = F.when(wrapped, inner).otherwise(V())
        name = F.coalesce(C.text_at(F.col("m"), "$.name"), F.when(F.col("wrapped") & ~F.col("outer").isin("user", "assistant", "system"), F.col("outer")))
        made = rows.select("path", "seq", m.alias("m"), F.coalesce(wrapped, F.lit(False)).alias("wrapped"), outer.alias("outer"))
        return fitted(made.select("path", "seq", C.text_at(F.col("m"), "$.role").alias("role"), C.at(F.col("m"), "$.content").alias("content"), name.alias("name")).filter("role IS NOT NULL"), base.MESSAGES)


class Rollouts(Reader):
    """Rollout files of the main home and of pool profiles: response items that are messages of user or assistant."""

    name = "codex"
    pattern, names = "/rollout-[^/]*[.]jsonl$", "rollout-*.jsonl"
    TEXTS = ("input_text", "output_text", "text")

    def __init__(self, spark: SparkSession, roots: Sequence[str], profiles: str | None = None):
        super().__init__(spark, [*roots, *([f"{profiles}/*/sessions"] if profiles else [])])

    def sessions(self) -> DataFrame:
        home = F.nullif(F.regexp_extract("path", "([^/]+)/sessions/", 1), F.lit(""))
        own = stem(F.col("path"))
        listed = self._listed()
        if len(self.roots) > 1:
            listed = first_of_links(reduce(DataFrame.unionByName, [base.listed_files(self.spark, [r], self.pattern, self.names).withColumn("rank", F.lit(i)) for i, r in enumerate(self.roots)]))
        return self._named(listed, own, seat=F.when(home == ".codex", "main").otherwise(home), dedupe_key=F.coalesce(X.trailing_uuid(own), own))

    def messages(self) -> DataFrame:
        p = C.at(V(), "$.payload")
        rows = json_lines(self._lines()).filter((C.text_at(V(), "$.type") == "response_item") & (C.text_at(p, "$.type") == "message"))
        texts = F.transform(C.items(C.at(p, "$.content")), lambda b: F.when(C.text_at(b, "$.type").isin(*self.TEXTS), C.text_at(b, "$.text")))
        said = F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n")
        made = rows.select("path", "seq", C.text_at(p, "$.role").alias("role"), said.alias("said")).filter("role IN ('user', 'assistant') AND said <> ''")
        return fitted(made.withColumn("content", F.col("said").cast("variant")), base.MESSAGES)

    def index(self) -> DataFrame:
        """path, cwd, session, started, originator (of the first line) and first_turn (of the first assistant message)."""
        rows = json_lines(self._lines())
        p = C.at(V(), "$.payload")
        meta = rows.filter((F.col("seq") == 1) & (C.text_at(V(), "$.type") == "session_meta")).select(
            "path", C.text_at(p, "$.cwd").alias("cwd"), F.coalesce(C.text_at(p, "$.id"), C.text_at(p, "$.session_id")).alias("session"), X.parsed_time(F.coalesce(C.text_at(p, "$.timestamp"), C.text_at(V(), "$.timestamp"))).alias("started"), C.text_at(p, "$.originator").alias("originator")
        )
        turns = rows.filter((C.text_at(V(), "$.type") == "response_item") & (C.text_at(p, "$.type") == "message") & (C.text_at(p, "$.role") == "assistant"))
        return meta.join(turns.groupBy("path").agg(F.min(X.parsed_time(C.text_at(V(), "$.timestamp"))).alias("first_turn")), "path", "left")


class TypedEvents(Reader):
    """Event files with user.message and assistant.message lines."""

    name = "copilot"

    pattern = "/[^/]+/events[.]jsonl$"

    def sessions(self) -> DataFrame:
        return self._named(self._listed(), directory(F.col("path")))

    def messages(self) -> DataFrame:
        kind = C.text_at(V(), "$.type")
        role = F.when(kind == "user.message", "user").when(kind == "assistant.message", "assistant")
        made = json_lines(self._lines()).select("path", "seq", role.alias("role"), C.text_at(V(), "$.data.content").alias("said")).filter("role IS NOT NULL AND said <> ''")
        return fitted(made.withColumn("content", F.col("said").cast("variant")), base.MESSAGES)


class BranchFiles(Reader):
    """Session files with user, assistant and toolResult messages; branches are read as one sequence."""

    name = "pi"
    INPUTS = ("input", "cacheRead", "cacheWrite")

    def _rows(self) -> DataFrame:
        return json_lines(self._lines())

    def sessions(self) -> DataFrame:
        return self._named(self._listed(), X.id_of_stem(stem(F.col("path"))))

    def messages(self) -> DataFrame:
        m = C.at(V(), "$.message")
        said = C.result_text(C.at(m, "$.content"))
        failed = F.coalesce(F.try_variant_get(m, "$.isError", "boolean"), F.lit(False))
        result = F.parse_json(F.to_json(F.when(failed, F.struct(F.lit(False).alias("success"), said.alias("error"), F.lit(None).cast("string").alias("output"))).otherwise(F.struct(F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"), said.alias("output")))))
        role = C.text_at(m, "$.role")
        rows = self._rows().filter((C.text_at(V(), "$.type") == "message") & role.isin("user", "assistant", "toolResult"))
        tool = role == "toolResult"
        made = rows.select("path", "seq", F.when(tool, "tool").otherwise(role).alias("role"), F.when(tool, result).otherwise(said.cast("variant")).alias("content"), F.when(tool, C.text_at(m, "$.toolName")).alias("name"), (tool | (said != "")).alias("keep"))
        return fitted(made.filter("keep"), base.MESSAGES)

    def events(self) -> DataFrame:
        m = C.at(V(), "$.message")
        role = C.text_at(m, "$.role")
        kind = F.when(C.text_at(V(), "$.type") == "compaction", "compaction").when(C.text_at(V(), "$.type") == "message", F.when(role == "user", "user_message").when(role == "assistant", "llm_response"))
        own = F.struct(kind.alias("kind"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("detail"))
        return _with_calls(self._rows(), kind, own, C.at(m, "$.content"), "toolCall", "$.arguments", role == "assistant")

    def usage(self) -> DataFrame:
        m = C.at(V(), "$.message")
        u = "$.message.usage"
        rows = self._rows().filter((C.text_at(V(), "$.type") == "message") & (C.text_at(m, "$.role") == "assistant") & (C.kind(C.at(V(), u)) == "object"))
        tokens = sum((base.long_at(V(), f"{u}.{k}") for k in self.INPUTS), F.lit(0).cast("long"))
        return fitted(rows.select("path", "seq", C.text_at(m, "$.model").alias("model"), base.decimal_at(V(), f"{u}.cost.total").alias("cost"), tokens.alias("input_tokens"), base.long_at(V(), f"{u}.output").alias("output_tokens")), base.USAGE)


def _with_calls(rows: DataFrame, kind: Column, own: Column, content: Column, block: str, arguments: str, calls_of: Column) -> DataFrame:
    """Each row's own event, then one for each call among its blocks, all at the row's time."""
    calls = F.when(calls_of, F.transform(F.filter(C.items(content), lambda b: C.is_block(b, block)), lambda b: F.struct(F.lit("tool_call").alias("kind"), C.text_at(b, "$.name").alias("tool_name"), C.compact(C.at(b, arguments)).alias("detail")))).otherwise(F.array())
    every = F.concat(F.when(kind.isNotNull(), F.array(own)).otherwise(F.array()), calls)
    made = rows.select("path", "seq", _time(V()).alias("ts"), F.posexplode(every).alias("i", "e")).filter("ts IS NOT NULL")
    # A line holds fewer than 2**20 blocks; its events keep their order inside it.
    return fitted(made.select("path", (F.col("seq") * (1 << 20) + F.col("i")).alias("seq"), "ts", "e.*"), base.EVENTS)


class ChatCells(Reader):
    """Chat agents' session files, named by the routing database of their host."""

    name = "nanoclaw"

    def __init__(self, spark: SparkSession, roots: Sequence[str], routing_db: str | None = None, include: Sequence[str] = (), exclude: Sequence[str] = ()):
        super().__init__(spark, roots)
        self.routing_db, self.include, self.exclude = routing_db, list(include), list(exclude)

    def agents(self) -> DataFrame:
        """agent, persona, folder, channel: of each agent group, with its channels' names in order of priority."""
        if not self.routing_db:
            return self.spark.createDataFrame([], "agent string, persona string, folder string, channel string")
        with sqlite3.connect(f"file:{self.routing_db}?mode=ro", uri=True) as db:
            rows = {t: db.execute(f"SELECT {cols} FROM {t}").fetchall() for t, cols in (("agent_groups", "id, name, folder"), ("messaging_groups", "id, name"), ("messaging_group_agents", "messaging_group_id, agent_group_id, priority, created_at"))}
        frame = self.spark.createDataFrame
        agents = frame([tuple(map(_text, r)) for r in rows["agent_groups"]], "agent string, persona string, folder string")
        groups = frame([tuple(map(_text, r)) for r in rows["messaging_groups"]], "group string, group_name string")
        links = frame([(_text(a), _text(b), c, _text(d)) for a, b, c, d in rows["messaging_group_agents"]], "group string, agent string, priority long, created_at string")
        joined = agents.join(links, "agent", "left").join(groups, "group", "left")
        names = F.transform(F.sort_array(F.collect_list(F.when(F.col("group_name").isNotNull(), F.struct((-F.col("priority")).alias("p"), "created_at", "group_name")))), lambda x: x["group_name"])
        return joined.groupBy("agent", "persona", "folder").agg(F.nullif(F.array_join(names, ", "), F.lit("")).alias("channel"))

    def _rows(self) -> DataFrame:
        return json_lines(self._lines())

    def sessions(self) -> DataFrame:
        agent = F.regexp_extract("path", "/v2-sessions/([^/]+)/", 1)
        listed = self._listed().withColumn("agent", F.when(agent != "", agent).otherwise(directory(F.col("path"))))
        known = self.agents()
        joined = listed.join(known, "agent", "left")
        mapped = F.col("persona").isNotNull()

        def named(values: Sequence[str]) -> Column:
            return F.coalesce(F.col("agent").isin(*values) | F.col("persona").isin(*values) | F.col("folder").isin(*values), F.lit(False))

        if self.exclude:
            joined = joined.filter(mapped & ~named(self.exclude))
        if self.include:
            joined = joined.filter(mapped & named(self.include))
        own = joined.withColumn("persona", F.coalesce("persona", "agent"))
        return fitted(own.withColumns({"reader": F.lit(self.name), "session_id": stem(F.col("path")), "dedupe_key": stem(F.col("path"))}), base.SESSIONS)

    def _flag(self, key: str) -> Column:
        return F.coalesce(F.try_variant_get(V(), f"$.{key}", "boolean"), F.lit(False))

    def messages(self) -> DataFrame:
        m = C.at(V(), "$.message")
        rows = self._rows().filter(C.text_at(V(), "$.type").isin("user", "assistant") & ~self._flag("isCompactSummary") & ~self._flag("isMeta")).select("path", "seq", C.text_at(m, "$.role").alias("role"), C.at(m, "$.content").alias("content"))
        blocks = rows.select("path", "seq", "role", F.posexplode(C.items(F.col("content"))).alias("i", "b"))
        uses = blocks.filter(C.is_block(F.col("b"), "tool_use")).select("path", "seq", "i", C.text_at(F.col("b"), "$.id").alias("id"), C.text_at(F.col("b"), "$.name").alias("name"), F.lit(None).cast("variant").alias("b"))
        results = blocks.filter((F.col("role") == "user") & C.is_block(F.col("b"), "tool_result")).select("path", "seq", "i", C.text_at(F.col("b"), "$.tool_use_id").alias("id"), F.lit(None).cast("string").alias("name"), "b")
        both = uses.unionByName(results)
        known = both.withColumn("tool", windows.latest_name(both, ["path", "id"], ["seq", "i"], "name", None)).filter("b IS NOT NULL")
        said = C.result_text(C.at(F.col("b"), "$.content"))
        failed = F.coalesce(F.try_variant_get(F.col("b"), "$.is_error", "boolean"), F.lit(False))
        body = F.parse_json(F.to_json(F.struct((~failed).alias("success"), F.when(failed, said).alias("error"), F.when(~failed, said).alias("output"))))
        tools = known.select("path", (F.col("seq") * (1 << 20) + F.col("i") + 1).alias("seq"), F.lit("tool").alias("role"), body.alias("content"), F.col("tool").alias("name"))
        text = F.when(C.kind(F.col("content")) == "string", F.col("content").cast("string")).otherwise(C.block_texts(F.col("content")))
        spoken = F.when(F.col("role") == "user", X.envelope_text(text)).otherwise(text)
        plain = rows.select("path", (F.col("seq") * (1 << 20)).alias("seq"), "role", spoken.alias("said")).filter("role IN ('user', 'assistant') AND said <> ''")
        return fitted(plain.withColumn("content", F.col("said").cast("variant")), base.MESSAGES).unionByName(fitted(tools, base.MESSAGES))

    def _response(self) -> Column:
        return F.coalesce(C.text_at(V(), "$.message.id"), C.text_at(V(), "$.requestId"), C.text_at(V(), "$.uuid"))

    def _first_of_response(self, rows: DataFrame) -> DataFrame:
        """rows with fresh: whether an assistant line is the first of its response."""
        keyed = rows.withColumn("response", F.coalesce(self._response(), F.concat(F.lit("line "), F.col("seq"))))
        n = F.row_number().over(Window.partitionBy("path", F.col("role"), "response").orderBy("seq"))
        return keyed.withColumn("fresh", n == 1)

    def events(self) -> DataFrame:
        m = C.at(V(), "$.message")
        timed = self._rows().filter(C.text_at(V(), "$.type").isin("user", "assistant") & _time(V()).isNotNull()).withColumn("role", C.text_at(m, "$.role")).filter("role IN ('user', 'assistant')")
        rows = self._first_of_response(timed)
        echo = C.has_block(C.at(m, "$.content"), "tool_result")
        user = F.when(self._flag("isCompactSummary"), "compaction").when(~self._flag("isMeta") & ~echo, "user_message")
        kind = F.when(F.col("role") == "user", user).when(F.col("fresh"), "llm_response")
        own = F.struct(kind.alias("kind"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("detail"))
        return _with_calls(rows, kind, own, C.at(m, "$.content"), "tool_use", "$.input", F.col("role") == "assistant")

    def usage(self) -> DataFrame:
        u = "$.message.usage"
        rows = self._rows().filter((C.text_at(V(), "$.type") == "assistant") & (C.kind(C.at(V(), u)) == "object")).withColumn("role", F.lit("assistant"))
        fresh = self._first_of_response(rows).filter("fresh")
        tokens = base.long_at(V(), f"{u}.input_tokens") + base.long_at(V(), f"{u}.cache_read_input_tokens") + base.long_at(V(), f"{u}.cache_creation_input_tokens")
        return fitted(fresh.select("path", "seq", C.text_at(V(), "$.message.model").alias("model"), tokens.alias("input_tokens"), base.long_at(V(), f"{u}.output_tokens").alias("output_tokens")), base.USAGE)


def _text(x: object) -> str | None:
    return None if x is None else str(x)


class GenericFiles(Reader):
    """Flat messages in files that a pattern names; their first line may hold persona and channel under a header key."""

    name = "generic"
    HEADER_BYTES = 64 * 1024

    def __init__(self, spark: SparkSession, roots: Sequence[str], pattern: str = "[.]jsonl$", names: str = "*.jsonl", id_from: str = "stem", header_key: str = "_session", reader: str | None = None):
        super().__init__(spark, roots)
        self.pattern, self.names, self.id_from, self.header_key = pattern, names, id_from, header_key
        self.name = reader or self.name

    def sessions(self) -> DataFrame:
        path = F.col("path")
        first = json_lines(self._lines().filter((F.col("seq") == 1) & (F.octet_length("line") <= self.HEADER_BYTES)))
        named = [F.nullif(X.trim_all(C.text_at(V(), f"$.{self.header_key}.{k}")), F.lit("")).alias(k) for k in ("persona", "channel")]
        heads = first.select("path", *named)
        own = directory(path) if self.id_from == "parent" else stem(path)
        return fitted(self._named(self._listed(), own).drop("persona", "channel").join(heads, "path", "left"), base.SESSIONS)

    def messages(self) -> DataFrame:
        return flat_messages(json_lines(self._lines())).filter("role IS NOT NULL")
