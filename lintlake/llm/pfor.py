"""Token-ID output: shards of patched frame-of-reference blocks in ascending doc_id order.

A shard's ids are cut into blocks of 256. A block stores its least id, the differences to it in as many
bits as a chosen percentile of them needs (of several percentiles the one that makes the block smallest),
and the rest as exceptions: place and value. The header lists where each block starts, so any range of ids
is read without the blocks before it.

Documents are range partitioned by doc_id; a task encodes its range and writes segments of
``SEGMENT_IDS`` or more ids, each with its documents and their lengths, as binary rows of Parquet files in
the shared folder (that file layer brings atomic commits, remote stores and splits; a row's payload is one
shard in the format above). Reading decodes the payloads; the ids before a range are sums over ranges.

Defined results: a null is an empty text, whose ids are the end id alone; rows that repeat a doc_id are
written each, ordered by text digest; a missing doc_id comes first. Extra columns are ignored. An empty table
gives no files and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.llm.common import doc_id_of, keyed, partitions_of
from lintlake.llm.text_arrays import lists_of
from lintlake.llm.tokens import encoded
from lintlake.session import ensure_checkpoint_dir

MAGIC = 0x31524650
BLOCK = 256
PERCENTILES = (80, 90, 95, 99, 100)
SEGMENT_IDS = 1 << 18
ENCODE_BYTES = 1 << 20


def _bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def encode(ids: np.ndarray) -> bytes:
    """One shard: header, block directory (start, least id, width, exceptions), packed differences, exceptions."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint32)
    grid[:n] = ids
    if n:
        grid[n:] = ids[-1]
    grid = grid.reshape(blocks, BLOCK)
    least = grid.min(1) if blocks else np.zeros(0, np.uint32)
    differ = grid - least[:, None]
    # the percentile whose width makes each block smallest; an exception takes five bytes
    ordered = np.sort(differ, 1)
    width, size = np.zeros(blocks, np.int64), np.full(blocks, np.iinfo(np.int64).max)
    for p in PERCENTILES:
        w = _bits(ordered[:, min(BLOCK - 1, BLOCK * p // 100)])
        cost = BLOCK // 8 * w + 5 * (differ >> w[:, None].astype(np.uint64) > 0).sum(1)
        better = cost < size
        width[better], size[better] = w[better], cost[better]
    outside = differ >> width[:, None].astype(np.uint64) > 0
    extra = outside.sum(1)
    start = np.concatenate([[0], np.cumsum(BLOCK // 8 * width)])
    body = np.zeros(start[-1], np.uint8)
    inside = np.where(outside, 0, differ)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            bits = (inside[rows][:, :, None] >> np.arange(w, dtype=np.uint32) & 1).astype(np.uint8)
            body[(start[rows][:, None] + np.arange(BLOCK // 8 * w)).ravel()] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little").ravel()
    block, place = np.nonzero(outside)
    directory = np.zeros(blocks, "<u4,<u4,u1,<u2")
    directory["f0"], directory["f1"], directory["f2"], directory["f3"] = start[:-1], least, width, extra
    header = np.array([MAGIC, n, blocks, len(body)], "<u4")
    return header.tobytes() + directory.tobytes() + body.tobytes() + place.astype(np.uint8).tobytes() + differ[block, place].astype("<u4").tobytes()


def decode(data: bytes, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """The ids ``[lo, hi)`` of a shard; only the blocks that hold them are unpacked."""
    magic, n, blocks, size = np.frombuffer(data, "<u4", 4).tolist()
    if magic != MAGIC:
        raise ValueError("not a shard of patched blocks")
    hi = n if hi is None else min(hi, n)
    directory = np.frombuffer(data, "<u4,<u4,u1,<u2", blocks, 16)
    at = 16 + directory.nbytes
    body = np.frombuffer(data, np.uint8, size, at)
    extra = directory["f3"].astype(np.int64)
    before = np.concatenate([[0], np.cumsum(extra)])
    a, b = lo // BLOCK, -(-hi // BLOCK) if hi > lo else lo // BLOCK
    part = directory[a:b]
    differ = np.zeros((b - a, BLOCK), np.uint32)
    for w in np.unique(part["f2"]).tolist():
        if w:
            rows = np.flatnonzero(part["f2"] == w)
            packed = body[part["f0"][rows].astype(np.int64)[:, None] + np.arange(BLOCK // 8 * w)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            wide = np.zeros((len(rows), BLOCK, 32), np.uint8)
            wide[:, :, :w] = bits
            differ[rows] = np.packbits(wide.reshape(len(rows), -1), axis=1, bitorder="little").view("<u4")
    places = np.frombuffer(data, np.uint8, int(before[-1]), at + size)[before[a] : before[b]]
    values = np.frombuffer(data, "<u4", int(before[-1]), at + size + int(before[-1]))[before[a] : before[b]]
    differ[np.repeat(np.arange(b - a), extra[a:b]), places] = values
    return (differ + part["f1"][:, None]).ravel()[lo - a * BLOCK : hi - a * BLOCK].astype(np.uint32)


SEGMENT = "range int, segment int, before long, n long, doc_ids array<long>, lengths array<int>, shard binary"


def _write(path: str, segment_ids: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, before = TaskContext.get().partitionId(), 0, 0
        docs, lengths, held, size = [], [], [], 0

        def out():
            ids = np.concatenate(held)
            cells = [[part], [segment], [before], [len(ids)], [np.concatenate(docs).tolist()], [np.concatenate(lengths).tolist()], [encode(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            names = ["range", "segment", "before", "n", "doc_ids", "lengths", "shard"]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names)

        for batch, ids, first in encoded(batches, path, ENCODE_BYTES):
            docs.append(batch.column("id").to_numpy(zero_copy_only=False))
            lengths.append(np.diff(first))
            held.append(ids)
            size += len(ids)
            if size >= segment_ids:
                yield out()
                segment, before = segment + 1, before + size
                docs, lengths, held, size = [], [], [], 0
        if held:
            yield out()

    return run


def write_tokens(docs: DataFrame, vocabulary: str, path: str, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of all texts to the folder ``path``, in ascending doc_id order."""
    n = partitions_of(docs.sparkSession)
    ordered = keyed(docs).repartitionByRange(n, "id", "tk").sortWithinPartitions("id", "tk").select("id", "text")
    ordered.mapInArrow(_write(vocabulary, segment_ids), SEGMENT).write.parquet(path)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            ids = decode(row.column("shard")[0].as_buffer())
            doc_ids, lengths = lists_of(row.column("doc_ids"))[0], lists_of(row.column("lengths"))[0].astype(np.int64)
            first = np.concatenate([[0], np.cumsum(lengths)])
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            columns = [pa.array(np.full(len(lengths), row.column("range")[0].as_py()), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(first[:-1] + row.column("before")[0].as_py()), pa.array(lengths), pa.array(crc, pa.int64())]
            yield pa.record_batch(columns, ["range", "id", "at", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in a folder of shards."""
    rows = spark.read.schema(SEGMENT).parquet(path)
    sums = rows.groupBy("range").agg(F.sum("n").alias("n"))
    # one row per range, of which there are as many as shuffle partitions
    before = sums.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    docs = rows.mapInArrow(_read, "range int, id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(before), "range").select(doc_id_of(F.col("id")).alias("doc_id"), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    """Per document the ids before it, their number and their checksum, from the files."""
    import public_tokenizers

    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_tokens(spark, path)
