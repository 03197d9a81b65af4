"""Shared pieces of the training-data operators: row keys, shared tables, slices of document order."""

from __future__ import annotations

import pickle
import uuid

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.session import ensure_checkpoint_dir

#: Stands for a missing doc_id, so that such rows keep a place in the order (the first).
NO_ID = -(2**63)


#: Rows of an Arrow batch: whole texts are wide, and two batches a worker are held at once.
BATCH_ROWS, BATCH_CONF = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Arrow batches of texts, unless the session has a setting of its own."""
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def key_columns(docs: DataFrame) -> dict[str, Column]:
    """Expressions of ``id``, ``tk`` and ``text`` as in :func:`keyed`."""
    small_batches(docs.sparkSession)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return {"id": F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), "tk": F.xxhash64(text), "text": text}


def keyed(docs: DataFrame) -> DataFrame:
    """``(id, tk, text)``: the place of a document in the order, and its text without nulls.

    ``tk`` digests the text, so rows that share a doc_id but not the text are told apart,
    and rows that repeat both count as one document. Other columns are left behind, whatever
    their names are.
    """
    return docs.select(*[c.alias(name) for name, c in key_columns(docs).items()])


def doc_id_of(id_: Column) -> Column:
    return F.when(id_ != F.lit(NO_ID), id_)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a table written to the shared folder: survives lost executors, keeps statistics."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices_of(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are below ``key``, by halving."""
    if not cuts:
        return F.lit(0)
    points = F.lit(cuts).cast("array<bigint>")
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(len(cuts).bit_length())),
        F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s)
        .when(F.get(points, F.floor((s["lo"] + s["hi"]) / 2).cast("int")) < key, F.struct((F.floor((s["lo"] + s["hi"]) / 2) + 1).cast("int").alias("lo"), s["hi"].alias("hi")))
        .otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi"))),
    )
    return found["lo"]


def materialised(df: DataFrame, *new: Column) -> DataFrame:
    """``df`` with new columns that are computed once per row: the optimiser doesn't repeat them where they are used."""
    return df.select("*", F.inline(F.array(F.struct(*new))))


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, where ``body`` names it several times or in a loop."""
    return F.get(F.transform(F.array(value), body), 0)


def packed(value) -> bytes:
    """Arrays of one task for another one, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, 5))


def unpacked(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


#: A table is broadcast below this size, which is measured first; above it the join shuffles.
BROADCAST_BYTES = 16 << 20


def joined_by_key(rows: DataFrame, small: DataFrame, bytes_of: Column, how: str = "inner") -> DataFrame:
    """Join on ``id, tk``. ``small`` is written and measured (``bytes_of`` gives the bytes of a row)."""
    small = written(small)
    size = small.agg(F.sum(bytes_of.cast("long"))).first()[0] or 0
    return rows.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, ["id", "tk"], how)
