"""Connected components of a table of edges: one task for a bounded table, alternating stars beyond it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lintlake.llm.common import written

#: Edges that one task joins by itself, in about 100 MB; more of them take rounds over all tasks.
ONE_TASK = 1_000_000


def _step(edges: DataFrame) -> DataFrame:
    """Every node links its greater neighbours, then its lesser ones, to the least of them."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a").select("a", "b", "m")
    return small.select("a", F.col("m").alias("b")).union(small.where("b != m").select("b", "m")).distinct()


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of the task as ``(node, comp)``: roots hang on lesser roots until no edge joins two of them."""
    read = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    a, b = (np.concatenate(side) for side in zip(*read, strict=True)) if read else (np.empty(0, np.int64),) * 2
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    comp = np.arange(len(nodes))
    while True:
        x, y = comp[x], comp[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(comp, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(comp, up := comp[comp]):
            comp = up
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[comp])], ["node", "comp"])


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, and their number and digest, seen while they are written."""
    seen = Observation()
    counted = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("digest"))
    return written(counted), tuple(seen.get.values())


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``(node, comp)`` for every node of ``edges (a, b)``; ``comp`` is the least node reachable.

    Loops and repeated edges do no harm; without edges there are no rows. Up to ``one_task`` edges, counted while
    they are written, are joined in one task. Beyond that each round keeps the edges of a node in one star around its
    least neighbour, so the number of rows never exceeds that of the edges.
    """
    now, state = _kept(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    if state[0] <= one_task:
        return now.coalesce(1).mapInArrow(_joined, "node long, comp long")
    while True:
        now, after = _kept(_step(now))
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
