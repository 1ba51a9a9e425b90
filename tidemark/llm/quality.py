"""Quality rules with risk-controlled thresholds.

Each text has a few measures; a rule is a set of cutoffs and rejects a text with a
measure above its cutoff. Rules come from labelled texts: within a stratum, a rule
is admitted only if an exact binomial test on the good texts that pass the base
rule shows that it rejects fewer than alpha of them.

Rules are tested in fixed orders: an order starts with the highest cutoff of one
measure, lowers it step by step, goes on with the next measure beside it, and ends
at the first rule that is not admitted, so its tests need no correction for their
number. Each measure begins one order (the others follow in turn), so one on which
good texts differ does not keep the others out. With m measures and s strata,
all rules admitted are right together with probability 1 - delta if each order has
the level delta / (s * m). Of a stratum's admitted rules that one is used which
rejects the most texts labelled bad.

A stratum with labels too few to admit even a rule that rejects no good text is
pooled with the others like it; its bound then holds for the pool. Which strata
are pooled depends on the number of labels alone. A stratum without any label has
no rule. What was admitted is logged for each stratum.

All of it is DataFrame expressions: the words of a text are one array, repeated
three-word windows are found by hashing them and sorting the hashes, and the
binomial tail is a fold over its terms.

Strata are the listed languages and one more for every other (or null) value, so
their number, and with it what reaches the driver, is fixed by a parameter.

Rules are fitted on all labels, however many: labels and counts meet in a join
that shuffles both where they are many. Texts take no part in it.

Null and empty texts have no words and fail the base rule. Labels with a null
id or a null quality are not used; a text with several labels counts once for
each. Texts are read whole. Repeated rows are judged one by one. Empty tables
give empty results, an empty label table admits no cutoff. Other columns pass
through and columns named like a result are replaced.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.llm.jaccard_join import bits_for
from tidemark.llm.shared import free_name, written

logger = logging.getLogger(__name__)

STRATA = ("en", "de", "fr", "es")
ALPHA = 0.02
DELTA = 0.05
#: Candidate cutoffs of each measure, lowest first.
CUTOFFS = {
    "symbol_rate": (0.02, 0.05, 0.1, 0.2, 0.4),
    "dup_line_rate": (0.1, 0.2, 0.3, 0.5, 0.8),
    "repeat_rate": (0.1, 0.2, 0.3, 0.4),
    "mean_word": (10.0, 12.0, 15.0, 20.0),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACE = "\t\n\x0b\x0c\r"


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with the counts of COUNTS."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (text, *COUNTS)]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    spaced = F.translate(t, _SPACE, " " * len(_SPACE))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.trim(F.translate(x, _SPACE, " " * len(_SPACE)))) > 0)
    first = df.select(
        *keep,
        F.array_remove(F.split(spaced, " "), "").alias("__words"),
        F.length(F.translate(t, " " + _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.transform(lines, lambda x: F.xxhash64(x, F.lit(1))).alias("__lines"),
    )
    named = [F.col(f"`{c}`") for c in first.columns if c not in ("__words", "__lines")]
    hashed = first.select(*named, "__lines", F.transform("__words", lambda x: F.xxhash64(x)).alias("__hashes"))
    n = F.size("__hashes")
    grams = F.when(n >= 3, F.zip_with(F.zip_with(F.slice("__hashes", 1, n - 2), F.slice("__hashes", 2, n - 2), lambda a, b: F.xxhash64(a, b)), F.slice("__hashes", 3, n - 2), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))
    counted = hashed.select(*named, "__lines", n.cast("long").alias("n_words"), grams.alias("__grams"))
    placed = counted.select(
        *named,
        "n_words",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__grams") > F.size(F.array_distinct("__grams")), F.sort_array(F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).alias("__sorted"),
    )
    again = F.filter("__sorted", lambda x, i: (F.get("__sorted", i - 1)["g"] == x["g"]) | (F.coalesce(F.get("__sorted", i + 1)["g"] == x["g"], F.lit(False))))
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return placed.select(*named, "n_words", "n_dup_lines", F.when(F.col("__sorted").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_rate": F.col("n_symbols") / words,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_dup_lines") + 1, words / 20),
        "repeat_rate": F.col("n_repeat_words") / words,
        "mean_word": F.col("word_chars") / words,
    }


def stratum(lang: str, strata: Sequence[str]) -> Column:
    return F.when(F.col(f"`{lang}`").isin(*strata), F.col(f"`{lang}`")).otherwise("other")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials at rate p, as a fold over the logarithms of its terms."""
    ratio = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log1p(F.lit(-p))).alias("term"), F.exp(n * F.log1p(F.lit(-p))).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1).cast("double") / i) + ratio
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    return F.when(k <= 0, F.exp(n * F.log1p(F.lit(-p)))).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), start, step, lambda a: a["sum"]))


def orders(cutoffs: dict[str, Sequence[float]]) -> list[list[dict[str, float]]]:
    """For each measure the rules of the order that it begins, each with one cutoff more or lower than the last."""
    out = []
    for first in range(len(cutoffs)):
        turned = [*list(cutoffs)[first:], *list(cutoffs)[:first]]
        rule: dict[str, float] = {}
        out.append([rule := rule | {m: c} for m in turned for c in sorted(cutoffs[m], reverse=True)])
    return out


def breaks(rule: dict[str, float]) -> Column:
    of = measures()
    return reduce(or_, [of[m] > c for m, c in rule.items()])


@dataclass
class Admitted:
    """The rule of a stratum: n good texts were judged with it (those of the whole pool where there is one), k of them break it."""

    stratum: str
    pool: tuple[str, ...]
    rule: dict[str, float]
    n: int
    k: int


def admitted(counted: DataFrame, labels: DataFrame, lang: str, strata: Sequence[str], alpha: float, delta: float, cutoffs: dict[str, Sequence[float]]) -> list[Admitted]:
    """The admitted rule of each stratum that has one, from labelled rows of counted.

    At most len(strata) + 1 rows for each rule of orders() reach the driver.
    """
    # The row number keeps the filter above the counts, as in keep_good.
    own = counted.select(F.col("doc_id").alias("_id"), stratum(lang, strata).alias("stratum"), *COUNTS, F.monotonically_increasing_id().alias("_at"))
    joined = own.filter((F.col("_at") >= 0) & ~base_failed()).drop("_at").join(usable_labels(labels), "_id")
    tried = orders(cutoffs)
    places = [(o, i) for o, rules in enumerate(tried) for i in range(len(rules))]
    sums = []
    for o, i in places:
        broken = breaks(tried[o][i])
        sums += [F.sum(F.when(broken, F.col(x)).otherwise(0)).alias(f"{name}_{o}_{i}") for name, x in (("k", "good"), ("bad", "bad"))]
    counts = joined.groupBy("stratum").agg(F.sum("good").alias("n"), *sums).filter("n > 0")
    level = delta / ((len(strata) + 1) * len(cutoffs))
    few = math.log(level) / math.log1p(-alpha)  # fewer good texts admit nothing
    pool = F.when(F.col("n") >= few, F.col("stratum"))
    pooled = counts.groupBy(pool.alias("own")).agg(F.sort_array(F.collect_list("stratum")).alias("pool"), F.sum("n").alias("n"), *[F.sum(f"{x}_{o}_{i}").alias(f"{x}_{o}_{i}") for o, i in places for x in ("k", "bad")])
    cells = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(i).alias("i"), F.col(f"k_{o}_{i}").alias("k"), F.col(f"bad_{o}_{i}").alias("bad")) for o, i in places])
    # At and above its mean a binomial's tail is at least one half: no need to add up its terms, which may be millions.
    hopeless = (F.col("k") > F.col("n") * alpha) & F.lit(level < 0.5)
    tested = pooled.select("pool", "n", F.inline(cells)).withColumn("passes", F.when(hopeless, False).otherwise(binomial_tail(F.col("k"), F.col("n"), alpha) <= level))
    by: dict[tuple[str, ...], dict[tuple[int, int], Row]] = {}
    for row in tested.collect():
        by.setdefault(tuple(row["pool"]), {})[row["o"], row["i"]] = row
    out = []
    for members, rows in sorted(by.items()):
        passed = []
        for o, rules in enumerate(tried):
            for i in range(len(rules)):
                if not rows[o, i]["passes"]:
                    break
                passed.append(rows[o, i])
        if passed:
            best = max(passed, key=lambda r: (r["bad"], r["i"], -r["o"]))
            out += [Admitted(name, members, tried[best["o"]][best["i"]], best["n"], best["k"]) for name in members]
    for name in [*strata, "other"]:
        logger.info("stratum %s: %s", name, next((a for a in out if a.stratum == name), "no rule admitted"))
    return out


def usable_labels(labels: DataFrame) -> DataFrame:
    """_id of every labelled text, once, with the numbers of its good and bad labels."""
    told = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").alias("_id"))
    return told.agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))


def perhaps_labelled(docs: DataFrame, told: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in told's _id, and few others, by a broadcast table of at most MOST_BITS bits."""
    size = bits_for(told.count())
    at = lambda c: F.xxhash64(c).bitwiseAND(F.lit(size - 1)) + 1
    bucket, place, bits = (free_name(docs, n) for n in ("bucket", "place", "bits"))
    table = told.groupBy(F.bitmap_bucket_number(at("_id")).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at("_id"))).alias(bits))
    placed = docs.withColumns({bucket: F.bitmap_bucket_number(at("doc_id")), place: F.bitmap_bit_position(at("doc_id"))})
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = placed.join(F.broadcast(table), bucket).filter(F.getbit(byte, F.col(place).bitwiseAND(F.lit(7)).cast("int")) == 1)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def rejection(counted: DataFrame, labels: DataFrame, lang: str, strata: Sequence[str], alpha: float, delta: float, cutoffs: dict[str, Sequence[float]]) -> Column:
    """Whether the admitted rule of its stratum rejects a row."""
    rejected = F.lit(False)
    for a in admitted(counted, labels, lang, strata, alpha, delta, cutoffs):
        rejected = rejected | ((stratum(lang, strata) == a.stratum) & breaks(a.rule))
    return rejected


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", strata: Sequence[str] = STRATA, alpha: float = ALPHA, delta: float = DELTA, cutoffs: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """docs without text, with COUNTS, base_failed and kept.

    The counts are written once to the shared folder; cutoffs and verdicts both
    read them.
    """
    docs = docs.drop("base_failed", "kept")
    counted = written(with_counts(docs, text), "quality")
    rejected = rejection(counted, labels, lang, strata, alpha, delta, cutoffs or CUTOFFS)
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | rejected))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", strata: Sequence[str] = STRATA, alpha: float = ALPHA, delta: float = DELTA, cutoffs: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """The rows of docs, unchanged, that judge() keeps.

    Texts stay where they are: labelled ones are counted for the cutoffs, and all
    as they pass, which costs less than to shuffle or write them. Which are labelled
    is told by a table of bits, whose size is bounded; it may let others through,
    which the join with the labels drops. Ids of two types have hashes that differ,
    so then all are counted.
    """
    labelled, told = docs, usable_labels(labels)
    if docs.schema["doc_id"].dataType == told.schema["_id"].dataType:
        labelled = perhaps_labelled(docs, told)
    rejected = rejection(with_counts(labelled, text), labels, lang, strata, alpha, delta, cutoffs or CUTOFFS)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.select(F.struct(*columns).alias("_row"), F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`"))
    # A row number, always true here, keeps the filter above the counts: pushed down, it would repeat their expressions.
    kept = ~(base_failed() | rejected) & (F.monotonically_increasing_id() >= 0)
    return with_counts(own, "_text").withColumn("_kept", kept).filter("_kept").select("_row.*")
