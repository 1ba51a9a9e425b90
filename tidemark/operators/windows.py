"""Sequence operators: dense windows, islands, stretches, gaps, first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def densest_window(df: DataFrame, key: str, ts: str, span: str, least: int) -> DataFrame:
    """For each key the window of at most span (both ends included) with most rows, if it has least or more.

    Of equal windows the earliest stays. Columns: key, n, start, stop.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    width = df.sparkSession.sql(f"SELECT timestampdiff(MICROSECOND, TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-01' + INTERVAL {span}) AS n").first()["n"]
    back = Window.partitionBy(key).orderBy("_us").rangeBetween(-width, 0)
    counted = df.filter(F.col(ts).isNotNull()).withColumn("_us", micros).select(key, F.col(ts).alias("stop"), "_us", F.count("*").over(back).alias("n"), F.min(ts).over(back).alias("start"))
    best = counted.filter(F.col("n") >= least).groupBy(key).agg(F.max_by(F.struct("n", "start", "stop"), F.struct("n", -F.col("_us"))).alias("b"))
    return best.select(key, F.col("b.n").alias("n"), F.col("b.start").alias("start"), F.col("b.stop").alias("stop"))


def islands(df: DataFrame, key: str, order: Sequence[str], same: Sequence[str], ts: str, least: int) -> DataFrame:
    """Runs of least or more rows that follow one another with equal (also equally null) columns.

    Columns: key, same, n, start, stop, at (the run's first place in the order).
    """
    w = Window.partitionBy(key).orderBy(*order)
    now, before = F.struct(*same), F.lag(F.struct(*same)).over(w)
    changed = df.withColumn("_new", F.when(before.isNull() | ~now.eqNullSafe(before), 1).otherwise(0))
    numbered = changed.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.struct(*order)
    runs = numbered.groupBy(key, "_island").agg(*[F.first(c).alias(c) for c in same], F.count("*").alias("n"), F.min_by(ts, first).alias("start"), F.max_by(ts, first).alias("stop"), F.min(order[0]).alias("at"))
    return runs.filter(F.col("n") >= least).drop("_island")


def longest_stretch(df: DataFrame, key: str, order: Sequence[str], reset: Column, counts: Column, ts: str, least: int) -> DataFrame:
    """For each key the stretch between resets with most counted rows, if it has least or more; the earliest on ties."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = df.withColumn("_stretch", F.sum(F.when(reset, 1).otherwise(0)).over(w)).filter(counts)
    place = F.struct(*order)
    sums = numbered.groupBy(key, "_stretch").agg(F.count("*").alias("n"), F.min_by(ts, place).alias("start"), F.max_by(ts, place).alias("stop"))
    best = sums.filter(F.col("n") >= least).groupBy(key).agg(F.max_by(F.struct("n", "start", "stop"), F.struct("n", -F.col("_stretch"))).alias("b"))
    return best.select(key, "b.*")


def missing_numbers(df: DataFrame, key: str, number: str) -> DataFrame:
    """Numbers from 1 to each key's largest that are not there."""
    w = Window.partitionBy(key).orderBy(number)
    steps = df.select(key, number).distinct().withColumn("_last", F.lag(number, 1, 0).over(w))
    gaps = steps.filter(F.col(number) > F.col("_last") + 1)
    return gaps.select(key, F.explode(F.sequence(F.col("_last") + 1, F.col(number) - 1)).alias("missing"))


def contiguous_mark(df: DataFrame, key: str, number: str, failed: Column) -> DataFrame:
    """For each key the last number before its first failure in ascending order; null if there is none."""
    w = Window.partitionBy(key).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    clean = df.withColumn("_failed", F.max(F.when(failed, 1).otherwise(0)).over(w))
    return clean.groupBy(key).agg(F.max(F.when(F.col("_failed") == 0, F.col(number))).alias("mark"))


def numbered_repeats(df: DataFrame, identity: str, order: Sequence[Column | str]) -> DataFrame:
    """identity with "#n" behind it from its second row in the order on."""
    w = Window.partitionBy(identity).orderBy(*order)
    n = F.row_number().over(w)
    return df.withColumn("_n", n).withColumn(identity, F.when(F.col("_n") > 1, F.concat(F.col(identity), F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col(identity))).drop("_n")


def latest_name(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, default: str | None) -> Column:
    """The last non-null name before a row of the same keys; as a column expression."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = F.last(name, ignorenulls=True).over(w)
    return F.coalesce(found, F.lit(default)) if default is not None else found
