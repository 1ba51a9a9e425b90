"""Spend, personas, archive periods, recurrence costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X

ROOT_ROLE = "(root)"
COST = "decimal(28,12)"


def spend(stats: DataFrame) -> DataFrame:
    """One pass over (session_id, role, cost, input_tokens, output_tokens): totals and sums by role.

    Columns: role (null in the row of totals), cost, sessions, sessions_with_cost,
    input_tokens, output_tokens.
    """
    sums = [F.sum("cost").alias("cost"), F.count("*").alias("sessions"), F.count("cost").alias("sessions_with_cost"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")]
    named = stats.withColumn("role", F.coalesce("role", F.lit(ROOT_ROLE)))
    return named.rollup("role").agg(*sums)


def spend_by_model(model_costs: DataFrame) -> DataFrame:
    """Sums of (session_id, model, cost) by model."""
    return model_costs.groupBy("model").agg(F.sum("cost").alias("cost"))


def personas(sessions: DataFrame, signals: DataFrame, stats: DataFrame) -> DataFrame:
    """Per persona and channel: sessions, signals of each kind, tokens, and cost if any session has one."""
    own = sessions.filter("persona IS NOT NULL").select("session_id", "persona", "channel")
    kinds = ("correction", "error", "workaround", "deferral", "pattern")
    found = signals.groupBy("session_id").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in kinds])
    joined = own.join(found, "session_id", "left").join(stats.select("session_id", "input_tokens", "output_tokens", "cost"), "session_id", "left")
    sums = [F.coalesce(F.sum(f"{k}s"), F.lit(0)).alias(f"{k}s") for k in kinds] + [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]
    return joined.groupBy("persona", "channel").agg(F.count("*").alias("sessions"), *sums, F.sum("cost").alias("cost"))


def persona_key(persona: Column, channel: Column) -> Column:
    return F.concat_ws("@", X.display_safe(persona), X.display_safe(channel))


def with_display_key(rows: DataFrame) -> DataFrame:
    """key: persona@channel; in order of persona and channel, one that is taken gets the first free of " (2)", " (3)", ...

    A suffixed key can take another row's own name, so keys are dealt in that order,
    for all names that are alike but for suffixes together.
    """
    named = rows.withColumn("_key", persona_key(F.col("persona"), F.col("channel")))
    # Only names alike up to their suffixes can clash; such a family has few members.
    stem = F.regexp_replace("_key", r"( \(\d+\))+$", "")
    member = F.struct("persona", F.col("channel").isNotNull().alias("has"), "channel", "_key")
    families = named.groupBy(stem.alias("_stem")).agg(F.sort_array(F.collect_set(member)).alias("members"))
    start = F.array().cast("array<struct<persona:string,channel:string,key:string>>")

    def deal(taken: Column, m: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda n: F.when(n == 1, m["_key"]).otherwise(F.concat(m["_key"], F.lit(" ("), n, F.lit(")"))))
        free = F.filter(tries, lambda t: ~F.exists(taken, lambda k: k["key"] == t))
        return F.concat(taken, F.array(F.struct(m["persona"].alias("persona"), m["channel"].alias("channel"), F.get(free, F.lit(0)).alias("key"))))

    dealt = families.select(F.explode(F.aggregate("members", start, deal)).alias("m")).select(F.col("m.persona").alias("_p"), F.col("m.channel").alias("_c"), F.col("m.key").alias("key"))
    return named.join(dealt, (F.col("persona") == F.col("_p")) & F.col("channel").eqNullSafe(F.col("_c"))).drop("_p", "_c", "_key")


def archive_period(daily: DataFrame, low: Column, high: Column) -> DataFrame:
    """Sums of (date, dim, name, cost) from low to high: dim is total, agent or model; days counts dates with a total."""
    inside = daily.filter(F.col("date").between(low, high))
    return inside.groupBy("dim", "name").agg(F.sum("cost").alias("cost"), F.countDistinct("date").alias("days"))


def top_costs(costs: DataFrame, n: int = 5) -> DataFrame:
    """The n dearest of (name, cost); names in order on ties."""
    return costs.orderBy(F.col("cost").desc(), "name").limit(n)


def recurrence_costs(signals: DataFrame, open_titles: DataFrame, costs: DataFrame) -> DataFrame:
    """For each title that was open already, the summed cost of the distinct sessions it came up in."""
    again = signals.filter("kind <> 'deferral'").join(open_titles.select("title").distinct(), "title", "left_semi").select("title", "session_id").distinct()
    return again.join(costs.filter("cost IS NOT NULL").select("session_id", "cost"), "session_id").groupBy("title").agg(F.sum("cost").alias("cost"))


def usage_sums(usage: DataFrame) -> DataFrame:
    """Token and cost sums by session; the cost is null if no row has one."""
    return usage.groupBy("session_id").agg(F.sum("cost").alias("cost"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
