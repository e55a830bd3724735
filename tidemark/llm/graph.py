"""Connected components of links between long ids, by joins that only shrink the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize

#: Up to so many edges, least neighbours are broadcast, after a count; beyond, joins are salted, so that a hub's edges are dealt out.
BROADCAST_EDGES = 300_000
SALT = 16


def _with_least(edges: DataFrame, end: str, least: DataFrame, few: bool) -> DataFrame:
    """edges joined with least (n, m; one row a node) on edges.end = n."""
    if few:
        return edges.join(F.broadcast(least), edges[end] == least["n"])
    salted = edges.withColumn("_s", F.pmod(F.xxhash64("a", "b"), F.lit(SALT)).cast("int"))
    each = least.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(each, (salted[end] == each["n"]) & (salted["_s"] == each["_s"])).drop("_s")


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v. Returns id, root: the least id reachable, for every id on an edge.

    Rounds of two steps: each node links its larger neighbours to the least of its neighbourhood,
    then its smaller ones likewise. Rounds grow with the logarithm of the longest path. Least
    neighbours come from aggregates that combine before the shuffle, so no neighbourhood is gathered.
    """
    now = materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges", shrink=8)
    seen = _state(now)
    while True:
        few = seen[0] <= BROADCAST_EDGES
        # Larger neighbours (a) of each node (b), to the least of the node and all its neighbours.
        both = now.select(F.col("b").alias("n"), F.col("a").alias("m")).union(now.select(F.col("a").alias("n"), F.col("b").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = _with_least(now, "b", least, few).select("a", F.col("m").alias("b"))
        large = large.union(least.filter("n != m").select(F.col("n").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct()
        # Smaller neighbours (b) of each node (a), to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, "a", low.withColumnRenamed("a", "n"), few).select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, materialize(small.union(low.select("a", F.col("m").alias("b"))).filter("a != b").distinct(), "edges", shrink=8)
        drop(before)
        state = _state(now)
        if state == seen:
            break
        seen = state
    # A star now: every node has one edge, to its root.
    rooted = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return rooted.union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
