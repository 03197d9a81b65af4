"""Skew-safe numbering: positions inside a group without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.session import cut_lineage


def numbered_positions(
    df: DataFrame, keys: list[str], order: list[Column | str], name: str, partitions: int | None = None
) -> DataFrame:
    """Add ``name`` = 1, 2, ... inside each group of ``keys``, following ``order``.

    A window over the group would sort a hot group in a single task. Here the rows
    are range partitioned on (keys, order), numbered inside each slice, and every
    slice gets the rows that earlier slices hold of its groups. The slices are
    written out first, so a lost executor cannot change which slice a row is in.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = [F.col(k) for k in keys] + [F.col(c) if isinstance(c, str) else c for c in order]
    sliced = df.repartitionByRange(n, *sort_cols).withColumn("_slice", F.spark_partition_id())
    sliced = cut_lineage(sliced)
    local = Window.partitionBy("_slice", *keys).orderBy(*sort_cols[len(keys):])
    sizes = sliced.groupBy("_slice", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        sliced.withColumn("_at", F.row_number().over(local))
        .join(offsets, ["_slice", *keys])
        .withColumn(name, F.col("_before") + F.col("_at"))
        .drop("_slice", "_at", "_before")
    )


def first_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int, name: str = "_rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes to ``k`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
