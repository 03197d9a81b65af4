"""Connected components of a table of edges, in few rounds and without a row per pair of members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.operators.detect import c
from lintlake.session import cut_lineage


def _state(edges: DataFrame, keys: list[str]):
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, node, comp)`` for every node of ``edges (keys, a, b)``; ``comp`` is the least node it is linked with.

    Every node links its greater neighbours, then its lesser ones, to the least of them, until nothing moves. Both
    steps keep one star around each node, so there are never more rows than edges, and paths shorten by doubling.
    Loops and repeated edges do no harm, but a node that only loops has no row.
    """
    now = cut_lineage(edges.where("a != b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now, keys)
    while state[0]:
        both = now.unionByName(now.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*keys, "a").agg(F.min("b").alias("m")).select(*keys, "a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.distinct())
        small = large.join(large.groupBy(*keys, "a").agg(F.min("b").alias("m")), [*keys, "a"])
        linked = small.select(*keys, "a", F.col("m").alias("b")).union(small.where(c.b != c.m).select(*keys, "b", "m"))
        now = cut_lineage(linked.distinct())
        before, state = state, _state(now, keys)
        if state == before:
            break
    centres = now.select(*keys, F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return now.select(*keys, F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(centres)
