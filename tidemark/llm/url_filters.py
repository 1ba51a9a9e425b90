"""URL allow and block lists as a trie over reversed host labels and path segments.

A rule is a host and a path. It fits a URL whose host is the rule's host or one
of its subdomains, and whose path starts with the rule's path. Of all rules that
fit, the longest wins (by the length of host and path; the deeper host on ties);
without one, the default verdict stands. Where the same host and path are both
allowed and blocked, the block wins.

The trie is walked by host labels from the right, then by whole path segments; the
last segment of a rule may be the start of a longer one, as for "/7" in "/77", so
each node keeps the ends that rules have in it apart, by their lengths. Nodes are
numbers in flat tables, so long rules need no deep recursion. The trie is broadcast;
rules whose texts exceed TRIE_CHARS are cut into slices of that size, each with a
trie of its own, and the best rule of all slices wins: the verdict is the same.

Nulls and URLs without "://" have an empty host and path, which only a rule with an
empty host and path fits. Repeated rows are judged one by one; empty tables give
empty results; other columns pass through, and columns named like a result are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import free_name

#: Characters of the rules in one trie; with its tables, a trie of that size takes a few hundred MB at most.
TRIE_CHARS = 8_000_000
RESULT = ("host", "path", "rule", "verdict")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def rank(self) -> tuple[int, int, bool]:
        """By what rules that fit the same URL win over others."""
        return len(self.name), len(self.host), self.verdict == "block"


@dataclass
class Trie:
    below: dict[tuple[int, str], int] = field(default_factory=dict)  # (node, label or segment) to node
    paths: dict[int, int] = field(default_factory=dict)  # of a host's node: where its paths begin
    ends: dict[tuple[int, str], Rule] = field(default_factory=dict)  # (node, start of the next segment) to rule
    lengths: dict[int, list[int]] = field(default_factory=dict)  # of a node: the lengths of such starts, longest first
    size: int = 1

    def _node(self) -> int:
        self.size += 1
        return self.size - 1

    def _step(self, node: int, label: str) -> int:
        found = self.below.get((node, label))
        if found is None:
            found = self.below[node, label] = self._node()
        return found

    def add(self, rule: Rule) -> None:
        node = 0
        for label in reversed(rule.host.split(".")) if rule.host else ():
            node = self._step(node, label)
        if node not in self.paths:
            self.paths[node] = self._node()
        node = self.paths[node]
        *whole, start = rule.path.split("/")
        for segment in whole:
            node = self._step(node, segment)
        old = self.ends.get((node, start))
        if old is None or rule.rank() > old.rank():
            self.ends[node, start] = rule
        if old is None:
            self.lengths[node] = sorted({*self.lengths.get(node, ()), len(start)}, reverse=True)


def build_trie(rules: Sequence[Rule]) -> Trie:
    trie = Trie()
    for rule in rules:
        trie.add(rule)
    return trie


def _host_nodes(trie: Trie, host: str) -> Iterator[int]:
    node: int | None = 0
    yield node
    for label in reversed(host.split(".")):
        node = trie.below.get((node, label))
        if node is None:
            return
        yield node


def find_rule(trie: Trie, host: str, path: str) -> Rule | None:
    best: Rule | None = None
    segments = path.split("/")
    for node in _host_nodes(trie, host):
        at = trie.paths.get(node)
        for i, segment in enumerate(segments):
            if at is None:
                break
            for n in trie.lengths.get(at, ()):
                found = trie.ends.get((at, segment[:n])) if n <= len(segment) else None
                if found:
                    if best is None or found.rank() > best.rank():
                        best = found
                    break
            at = trie.below.get((at, segment)) if i < len(segments) - 1 else None
    return best


def slices(rules: Sequence[Rule], chars: int) -> list[list[Rule]]:
    """The rules in runs of at most so many characters (or of one longer rule)."""
    out: list[list[Rule]] = [[]]
    size = 0
    for rule in rules:
        if out[-1] and size + len(rule.name) > chars:
            out.append([])
            size = 0
        out[-1].append(rule)
        size += len(rule.name)
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow", trie_chars: int = TRIE_CHARS) -> DataFrame:
    """df with host, path, rule and verdict (allow or block) of each url."""
    host, path = host_and_path(F.col(f"`{url}`"))
    kept = df.drop(*[c for c in RESULT if c != url])
    split = kept.withColumns({"host": host, "path": path})
    context = df.sparkSession.sparkContext

    def judge(part: list[Rule]) -> Column:
        shared = context.broadcast(build_trie(part))

        @F.pandas_udf("length int, host_length int, block boolean, rule string, verdict string")
        def of(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
            found = [find_rule(shared.value, h, p) for h, p in zip(hosts, paths, strict=True)]
            rows = [(*r.rank(), r.name, r.verdict) if r else (-1, -1, False, None, default) for r in found]
            return pd.DataFrame(rows, columns=["length", "host_length", "block", "rule", "verdict"])

        return of("host", "path")

    judged = [judge(part) for part in slices(rules, trie_chars)]
    name = free_name(split, "judged")
    best = split.withColumn(name, F.greatest(*judged) if len(judged) > 1 else judged[0])
    return best.select(*[f"`{c}`" for c in split.columns], F.col(name)["rule"].alias("rule"), F.col(name)["verdict"].alias("verdict"))
