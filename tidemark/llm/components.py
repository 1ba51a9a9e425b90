"""Connected components of a link table, by alternating star contractions.

Each round links every vertex to the smallest one near it, first its larger
neighbours (large star), then its smaller ones (small star), until nothing
changes; long chains shrink by a constant factor each round. Every step is a
minimum by vertex, added up before the shuffle, and a join on vertex. The links of
hubs, vertices with more than HUB links and more than a fixed share of all links,
do not meet in that join: hubs number HUBS at most, so their minima are broadcast
to wherever their links are. Rounds are written to the shared folder, and only
their counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch

HUB = 50_000
HUBS = 100_000


def _with_least(edges: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """edges (u, v) with m of least (u, m, n) for each u; of hubs by broadcast."""
    limit = max(HUB, -(-links // HUBS))
    hubs = least.filter(F.col("n") > limit).select("u", F.col("m").alias("hub_m"))
    marked = edges.join(F.broadcast(hubs), "u", "left")
    rest = marked.filter("hub_m IS NULL").select("u", "v").join(least.filter(F.col("n") <= limit).select("u", "m"), "u")
    return rest.select("u", "v", "m").union(marked.filter("hub_m IS NOT NULL").select("u", "v", F.col("hub_m").alias("m")))


def _least(edges: DataFrame, m: Column) -> DataFrame:
    return edges.groupBy("u").agg(m.alias("m"), F.count("*").alias("n"))


def _star(edges: DataFrame, large: bool, links: int) -> DataFrame:
    """Edges (u, v), u > v, after one large or small star."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, F.least(F.col("u"), F.min("v")))
        moved = _with_least(both.filter("v > u"), least, 2 * links).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = _least(edges, F.min("v"))
        moved = _with_least(edges, least, links).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root (the component's smallest vertex) of every vertex of links (a, b long)."""
    edges = scratch.written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        n = edges.count()
        half = scratch.written(_star(edges, True, n), "stars") if n > HUB else _star(edges, True, n)
        new = scratch.written(_star(half, False, n), "stars")
        # Finished when it is a set of stars: no vertex is both a centre and a ray.
        open_ends = new.select(F.col("u").alias("x")).join(new.select(F.col("v").alias("x")).distinct(), "x", "left_semi").limit(1).count()
        many = new.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() if not open_ends else 1
        edges = new
        if not open_ends and not many:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
