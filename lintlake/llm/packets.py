"""Texts and ranges that meet by document: both travel in packets, one per task and target partition.

A shuffle of single rows moves texts almost uncompressed; a packet of many texts takes about 0.4 of their
bytes. Packets of ranges come before those of texts, so a task reads the ranges of its documents first and
then works on one packet of texts at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import packed, partitions_of, unpacked
from lintlake.llm.text_arrays import CHUNK_BYTES, chunks, mix, texts_of, values

SEND_BYTES = 16 << 20
SCHEMA = "target int, kind int, packet binary"


def _target(id_: np.ndarray, tk: np.ndarray, n: int) -> np.ndarray:
    return (mix(id_.view(np.uint64) ^ mix(tk.view(np.uint64))) % np.uint64(n)).astype(np.int64)


def _batch(target, kind, packets):
    return pa.record_batch([pa.array(target, pa.int32()), pa.array([kind] * len(target), pa.int32()), pa.array(packets, pa.binary())], ["target", "kind", "packet"])


def _send_texts(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            texts = [t for *_, part in held for t in part]
            id_, tk = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            target = _target(id_, tk, n)
            by = np.argsort(target, kind="stable")
            parts = np.split(by, np.flatnonzero(np.diff(target[by])) + 1)
            return _batch([int(target[p[0]]) for p in parts], 1, [packed((id_[p], tk[p], np.array([len(texts[i]) for i in p]), b"".join([texts[i] for i in p]))) for p in parts])

        for batch in chunks(batches):
            data, at = texts_of(batch.column("text"))
            body = data.tobytes()
            held.append((values(batch, "id"), values(batch, "tk"), [body[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]))
            size += len(body) + 100 * batch.num_rows
            if size >= SEND_BYTES:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return run


def _send_ranges(n: int, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            target = _target(columns[0], columns[1], n)
            by = np.argsort(target, kind="stable")
            parts = np.split(by, np.flatnonzero(np.diff(target[by])) + 1)
            return _batch([int(target[p[0]]) for p in parts], 0, [packed([c[p] for c in columns]) for p in parts])

        for batch in batches:
            if batch.num_rows:
                held.append([values(batch, c) for c in names])
                size += batch.num_rows
                if size >= 1 << 20:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def _meet(work: Callable, only_ranged: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, ranges = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                at, kind, packet = (batch.column(c)[i].as_py() for c in range(3))
                if at != target:
                    target, ranges = at, []
                if kind == 0:
                    ranges.append(unpacked(packet))
                    continue
                if ranges:
                    columns = [np.concatenate(x) for x in zip(*ranges, strict=True)] if len(ranges) > 1 else ranges[0]
                    if len(ranges) > 1 or not isinstance(ranges[0], tuple):
                        by = np.lexsort((columns[1], columns[0]))
                        columns = tuple(c[by] for c in columns)
                        ranges = [columns]
                else:
                    columns = None
                yield from _texts(unpacked(packet), columns, work, only_ranged)

    return run


def _texts(packet, columns, work, only_ranged):
    id_, tk, size, body = packet
    lo = np.zeros(len(id_), np.int64)
    hi = np.zeros(len(id_), np.int64)
    if columns is not None:
        # a document is found by both numbers: ids first, then digests among rows of that id
        key = np.rec.fromarrays([columns[0], columns[1]], names="i,t")
        want = np.rec.fromarrays([id_, tk], names="i,t").astype(key.dtype)
        lo, hi = np.searchsorted(key, want, side="left"), np.searchsorted(key, want, side="right")
    keep = np.flatnonzero(hi > lo) if only_ranged else np.arange(len(id_))
    end = np.cumsum(size)
    data = np.frombuffer(body, np.uint8)
    while len(keep):
        n = max(1, int(np.searchsorted(np.cumsum(size[keep]), CHUNK_BYTES, side="right")))
        part, keep = keep[:n], keep[n:]
        offsets = np.concatenate([[0], np.cumsum(size[part])])
        text = np.concatenate([data[end[i] - size[i] : end[i]] for i in part])
        cuts = np.concatenate([[0], np.cumsum(hi[part] - lo[part])])
        own = np.concatenate([np.arange(a, b) for a, b in zip(lo[part].tolist(), hi[part].tolist(), strict=True)]).astype(np.int64)
        values_ = [c[own] for c in columns[2:]] if columns is not None else None
        yield from work(id_[part], tk[part], text, offsets, values_, cuts)


def meet(rows: DataFrame, ranges: DataFrame, work: Callable, schema: str, only_ranged: bool = False) -> DataFrame:
    """Run ``work`` on the texts of ``rows (id, tk, text)`` with their ``ranges (id, tk, ...numbers)``.

    ``work(id, tk, bytes, offsets, values, cuts)`` gets some texts at once; ``values`` are the further
    columns of their ranges (None if there are none at all) and those of text i are at ``cuts[i]:cuts[i + 1]``.
    It yields batches of ``schema``. With ``only_ranged`` texts without ranges are left out.
    """
    n = partitions_of(rows.sparkSession)
    texts = rows.select("id", "tk", "text").mapInArrow(_send_texts(n), SCHEMA)
    sent = ranges.mapInArrow(_send_ranges(n, ranges.columns), SCHEMA)
    met = texts.unionByName(sent).repartition(n, F.col("target")).sortWithinPartitions("target", "kind")
    return met.mapInArrow(_meet(work, only_ranged), schema)
