"""Packing by vector bins: sequences under limits on tokens, segments and loss-bearing tokens at once.

A document's ids are cut into whole sequences of ``tokens`` ids and a rest. Rests are packed by the
dot-product heuristic: into the open sequence goes the rest that fits and whose demands, weighted by how
much all rests together ask of each limit, point most towards what is left of the sequence. When no rest
fits, or one segment is left, a cut from the largest rest fills the sequence, so only the last sequence of a
batch of ``BATCH_DOCS`` documents is not full. Tasks pack the documents they read, without a shuffle; the
numbers of their sequences follow from sums over tasks.

A piece's first token bears no loss, since nothing in the sequence predicts it; the others do, unless a
``loss`` column says how many of a document's last tokens do (the answer of an instruction).

Defined results: a null is an empty text, whose only id is the end id; repeated rows are packed each.
Extra columns are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import doc_id_of, key_columns, written
from lintlake.llm.tokens import KEPT_PIECES, encoded

ENCODE_BYTES = 1 << 20
BATCH_DOCS, BATCH_IDS = 4096, 4 << 20


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 128
    loss: int = 1023

    def as_array(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], np.int64)


def loss_in(start, length, loss_from):
    """Loss-bearing tokens of a piece: those from ``loss_from`` on (of the document), but never its first."""
    return np.maximum(0, start + length - np.maximum(start + 1, loss_from))


class _Rests:
    """Rests by what they demand: those that demand the same are weighed once, and the first document's goes first."""

    def __init__(self, doc: np.ndarray, start: np.ndarray, need: np.ndarray):
        kinds, of = np.unique(need, axis=0, return_inverse=True)
        self.n, self.need, self.some = len(doc), kinds.astype(np.float64), np.ones(len(kinds), bool)
        self.at = {(size, loss): k for k, (size, _, loss) in enumerate(kinds.tolist())}
        self.held: list[list[tuple[int, int]]] = [[] for _ in range(len(kinds))]
        for k, d, s in zip(of.ravel().tolist(), doc.tolist(), start.tolist(), strict=True):
            self.held[k].append((d, s))  # ascending, so a heap

    def _first(self, value: np.ndarray) -> int:
        ties = np.flatnonzero(value == value.max()).tolist()
        return ties[0] if len(ties) == 1 else min(ties, key=lambda k: self.held[k][0])

    def best(self, weight: np.ndarray, left: np.ndarray) -> int | None:
        """The kind that fits and points most towards what is left."""
        fits = self.some & (self.need[:, 0] <= left[0]) & (self.need[:, 1] <= left[1]) & (self.need[:, 2] <= left[2])
        return self._first(np.where(fits, self.need @ (weight * left), -1.0)) if fits.any() else None

    def largest(self) -> int:
        return self._first(np.where(self.some, self.need[:, 0], -1.0))

    def pop(self, kind: int) -> tuple[int, int, int]:
        d, s = heappop(self.held[kind])
        self.n -= 1
        self.some[kind] = bool(self.held[kind])
        return d, s, int(self.need[kind, 0])

    def push(self, d: int, s: int, size: int, loss: int) -> None:
        kind = self.at.setdefault((size, loss), len(self.held))
        if kind == len(self.held):
            self.held.append([])
            self.need = np.append(self.need, [[size, 1.0, loss]], 0)
            self.some = np.append(self.some, True)
        heappush(self.held[kind], (d, s))
        self.some[kind] = True
        self.n += 1


def pack(sizes: np.ndarray, loss_from: np.ndarray, limits: Limits) -> np.ndarray:
    """Pieces ``(document, start, length, sequence, offset)`` of documents of ``sizes`` tokens."""
    cap = limits.as_array()
    step = min(limits.tokens, limits.loss + 1)  # a piece that could not break a limit alone
    pieces, sequence = [], 0
    whole = np.where(sizes >= step, sizes // step, 0)
    for d in np.flatnonzero(whole).tolist():
        for k in range(int(whole[d])):
            pieces.append((d, k * step, step, sequence, 0))
            sequence += 1
    doc = np.flatnonzero(sizes - whole * step)
    start = (whole * step)[doc]
    length = sizes[doc] - start
    need = np.stack([length, np.ones(len(doc), np.int64), loss_in(start, length, loss_from[doc])], 1)
    weight = need.sum(0) / cap / cap / cap  # demand of each limit, in its own unit
    rests = _Rests(doc, start, need)
    left, used, offset = cap.copy(), False, 0
    while rests.n:
        take = 0
        if left[1] > 1 and (best := rests.best(weight, left)) is not None:
            d, at, take = rests.pop(best)
            loss = int(loss_in(at, take, loss_from[d]))
        elif left[1] > 0:
            d, at, size = rests.pop(rests.largest())
            take = int(min(size, left[0], limits.loss + 1))
            while take and (loss := int(loss_in(at, take, loss_from[d]))) > left[2]:
                take -= 1
            if size > take:
                rests.push(d, at + take, size - take, int(loss_in(at + take, size - take, loss_from[d])))
        if take:
            pieces.append((d, at, take, sequence, offset))
            left -= [take, 1, loss]
            offset, used = offset + take, True
        if not take or not left[0] or not left[1]:
            left, used, offset, sequence = cap.copy(), False, 0, sequence + int(used)
    return np.array(pieces, np.int64).reshape(-1, 5)


PIECES = "part int, id long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long"


def _pack(path: str, limits: Limits, kept: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sequences = TaskContext.get().partitionId(), 0
        held, docs, size = [], 0, 0

        def out():
            doc_ids = np.concatenate([h[0] for h in held])
            share = np.concatenate([h[3] for h in held])
            sizes = np.concatenate([np.diff(h[2]) for h in held])
            first = np.concatenate([[0], np.cumsum(sizes)])
            raw = np.concatenate([h[1] for h in held]).astype("<u4").tobytes()
            loss_from = np.where(share < 0, 0, np.maximum(0, sizes - share))
            found = pack(sizes, loss_from, limits)
            doc, start, length, sequence, offset = found.T
            lo = 4 * (first[doc] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(lo.tolist(), (lo + 4 * length).tolist(), strict=True)]
            columns = [np.full(len(doc), part, np.int32), doc_ids[doc], start, length, np.array(crc, np.int64), sizes[doc], sequence + sequences, offset]
            names = ["part", "id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset"]
            return pa.record_batch([pa.array(c) for c in columns], names), int(sequence.max()) + 1

        for batch, ids, first in encoded(batches, path, ENCODE_BYTES, kept):
            held.append((batch.column("id").to_numpy(zero_copy_only=False), ids, first, batch.column("loss").to_numpy(zero_copy_only=False)))
            docs, size = docs + batch.num_rows, size + len(ids)
            if docs >= BATCH_DOCS or size >= BATCH_IDS:
                rows, n = out()
                yield rows
                sequences, held, docs, size = sequences + n, [], 0, 0
        if held:
            yield out()[0]

    return run


def pack_documents(docs: DataFrame, vocabulary: str, limits: Limits = Limits(), loss=None, kept: int = KEPT_PIECES) -> DataFrame:
    """One row per piece; ``loss`` may be a column: how many of a document's last tokens bear loss.

    A worker keeps the ids of up to ``kept`` pieces of text; fewer take less memory and more time.
    """
    key = key_columns(docs)
    source = docs.select(key["id"].alias("id"), key["text"].alias("text"), (F.lit(-1) if loss is None else loss).cast("long").alias("loss"))
    pieces = written(source.mapInArrow(_pack(vocabulary, limits, kept), PIECES))
    # one row per task
    counts = pieces.groupBy("part").agg((F.max("sequence") + 1).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return pieces.join(before, "part").select(
        doc_id_of(F.col("id")).alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("sequence")).alias("sequence_id"), "offset"
    )


def query(spark, sf_dir: str) -> DataFrame:
    """All pieces of the packed sequences."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
