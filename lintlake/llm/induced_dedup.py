"""Suffix-array dedup: every byte of a 400-byte string that stands at two places is removed.

The corpus is cut into shards that can be sorted apart. Each window of 400 bytes has a minimiser (the
least hash among its runs of 16 bytes), and consecutive windows with one minimiser are a run, about 190
windows long. Equal windows have equal minimisers, and they lie equally far from them. So:

1. runs are counted by minimiser and digest (map-side sums, no text moves). A run whose digest stands at
   two places is removed whole; a minimiser with one digest has nothing else to compare.
2. where a minimiser has several digests, one run of each is cut by distance from the minimiser, and a
   piece goes to the shard of the bytes that all its windows share. This splits the groups of hot
   minimisers by their surroundings; equal pieces travel once.
3. a shard sorts the suffixes of the pieces whose shared bytes stand in several of them, by induction
   (:mod:`lintlake.llm.induced`). Its queues go to disk beyond a size, but pieces, text and order are in memory:
   a shard must fit in the memory of a task, and a shared core that stands in very many surroundings is not
   split further. Windows whose neighbour in the order shares 400 bytes are removed.

Defined results: a null is an empty text; texts under 400 bytes lose nothing. Matches never cross texts.
Rows that repeat doc_id and text count as one document, and each gets the same row. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import doc_id_of, keyed, packed, partitions_of, unpacked, written
from lintlake.llm.induced import suffix_lcp
from lintlake.llm.packets import meet
from lintlake.llm.text_arrays import Sums, chunks, mix, ranges, sliding_min, texts_of, values

WINDOW, SEED = 400, 16
#: Distances from the minimiser that a piece spans.
REACH = 97


def _runs(window: int, seed: int):
    """Runs of windows with one minimiser: place, number of windows, distance of the minimiser, key, digest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, offsets = texts_of(batch.column("text"))
            n = len(data) - window + 1
            if n <= 0:
                continue
            sums = Sums(data)
            at = np.arange(len(data) - seed + 1)
            grams = sums.hash(at, at + seed)
            least = sliding_min((grams >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64), window - seed + 1)
            where = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            del least
            size = np.maximum(np.diff(offsets) - window + 1, 0)
            text = np.flatnonzero(size)
            valid = np.zeros(n + 1, np.int8)
            valid[offsets[text]] += 1
            np.add.at(valid, np.minimum(offsets[text] + size[text], n), -1)
            valid = np.cumsum(valid[:n]) > 0
            new = np.ones(n, bool)
            new[1:] = where[1:] != where[:-1]
            new[offsets[text]] = True
            begin = np.flatnonzero(new & valid)
            label = np.cumsum(new)[valid]
            count = np.bincount(label)
            count = count[count > 0]
            owner = np.searchsorted(offsets, begin, side="right") - 1
            hi = begin + count + window - 1
            yield pa.record_batch(
                [pa.array(values(batch, "id")[owner]), pa.array(values(batch, "tk")[owner]), pa.array(begin - offsets[owner], pa.int32()),
                 pa.array(count, pa.int32()), pa.array(where[begin] - begin, pa.int32()), pa.array(grams[where[begin]].view(np.int64)),
                 pa.array((sums.hash(begin, hi) + (hi - begin).astype(np.uint64)).view(np.int64))],
                ["id", "tk", "at", "n", "ahead", "key", "digest"],
            )

    return run


RUNS = "id long, tk long, at int, n int, ahead int, key long, digest long"


def _ordered(id_, tk, at, known, key, digest) -> np.ndarray:
    """Pieces by key and digest, known ones first; a place that comes twice, with a repeated row, counts once."""
    order = np.lexsort((at, tk, id_, ~known, digest, key))
    again = np.zeros(len(order), bool)
    again[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (at, tk, id_, digest, key)])
    return order[~again]


def _pieces(window: int, reach: int, shards: int):
    """Cut the runs of each text by distance from the minimiser and pack the pieces by shard."""

    def flush(held, strings):
        id_, tk, at, count, known, key, digest = held
        order = _ordered(id_, tk, at, known, key, digest)
        id_, tk, at, count, known, key, digest = (x[order] for x in (id_, tk, at, count, known, key, digest))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
        group = np.cumsum(new) - 1
        twice = np.bincount(group)[group] > 1  # equal pieces of different runs: all their windows stand twice
        shard = (key % np.uint64(shards)).astype(np.int64)
        whole = np.flatnonzero(twice & ~known)
        if len(whole):
            yield int(shard[whole[0]]), packed((id_[whole], tk[whole], at[whole], count[whole], None, None, None, None))
        sent = np.flatnonzero(new)
        sent = sent[np.argsort(shard[sent], kind="stable")]
        for part in np.split(sent, np.flatnonzero(np.diff(shard[sent])) + 1):
            done = known[part] | twice[part]
            yield int(shard[part[0]]), packed((id_[part], tk[part], at[part], count[part], done, key[part], digest[part], b"".join([strings[i] for i in order[part]])))

    def work(id_, tk, data, offsets, found, cuts) -> Iterator[pa.RecordBatch]:
        sums = Sums(data)
        at, n, ahead, key, known = found
        owner = np.repeat(np.arange(len(id_)), np.diff(cuts))
        # windows of a run lie from `ahead` down to `ahead - n + 1` before the minimiser
        low, high = (ahead - n + 1) // reach, ahead // reach
        parts = high - low + 1
        which = np.repeat(np.arange(len(at)), parts)
        block = ranges(low, parts)
        far = np.minimum(ahead[which], block * reach + reach - 1)
        near = np.maximum((ahead - n + 1)[which], block * reach)
        owner = owner[which]
        middle = offsets[owner] + (at + ahead)[which]
        lo = middle - far  # first window of the piece
        hi = lo + (far - near) + window
        core = sums.hash(middle - block * reach, middle - block * reach - reach + 1 + window)
        shared = mix(core ^ mix(key[which].view(np.uint64) + block.astype(np.uint64)))
        digest = sums.hash(lo, hi) + (hi - lo).astype(np.uint64)
        held = id_[owner], tk[owner], lo - offsets[owner], far - near + 1, known[which].astype(bool), shared, digest
        body = data.tobytes()
        rows = list(flush(held, [body[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]))
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "packed"])

    return work


def repeated_windows(metas, bodies: list[bytes], window: int):
    """Byte ranges of windows that stand twice among the pieces of a shard, for pieces that aren't known to."""
    id_, tk, at, count, known, key, digest = (np.concatenate(x) for x in zip(*metas, strict=True))
    size = count + window - 1
    lo = np.cumsum(size) - size
    data = np.frombuffer(b"".join(bodies), np.uint8)
    order = _ordered(id_, tk, at, known, key, digest)
    id_, tk, at, count, known, key, digest, size, lo = (x[order] for x in (id_, tk, at, count, known, key, digest, size, lo))
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    new = new_key.copy()
    new[1:] |= digest[1:] != digest[:-1]
    same = np.cumsum(new) - 1
    twice = np.bincount(same)[same] > 1
    kinds = np.bincount(np.cumsum(new_key) - 1, new)[np.cumsum(new_key) - 1]
    whole = np.flatnonzero(twice & ~known)
    out = [(id_[whole], tk[whole], at[whole], at[whole] + count[whole] + window - 1)]
    sort = np.flatnonzero(new & (kinds > 1))
    if len(sort):
        done = (known | twice)[sort]
        base = np.cumsum(size[sort] + 1) - size[sort] - 1
        text = np.ones(int((size[sort] + 1).sum()) + 1, np.uint16)
        text[ranges(base, size[sort])] = data[ranges(lo[sort], size[sort])].astype(np.uint16) + 2
        text[-1] = 0
        suffix, lcp = suffix_lcp(text, window)
        long = lcp >= window
        long[:-1] |= long[1:]
        repeated = np.zeros(len(text) + 1, bool)
        repeated[suffix[long]] = True
        piece = np.repeat(np.arange(len(sort)), size[sort] + 1)
        inside = np.arange(len(piece)) - base[piece] < count[sort][piece]  # a match may go on behind the end of a piece
        repeated[:-2] &= inside & ~done[piece]
        first, last = repeated.copy(), repeated.copy()
        first[1:] &= ~repeated[:-1]
        last[:-1] &= ~repeated[1:]
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        p = piece[a]
        q = sort[p]
        out.append((id_[q], tk[q], at[q] + a - base[p], at[q] + b - base[p] + window))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sort(window: int):
    def rows(id_, tk, lo, hi):
        return pa.record_batch([pa.array(id_, pa.int64()), pa.array(tk, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["id", "tk", "lo", "hi"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, metas, bodies = None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                s = batch.column(0)[i].as_py()
                if s != shard and metas:
                    yield rows(*repeated_windows(metas, bodies, window))
                    metas, bodies = [], []
                shard = s
                *meta, body = unpacked(batch.column(1)[i].as_py())
                if body is None:
                    yield rows(meta[0], meta[1], meta[2], meta[2] + meta[3] + window - 1)
                else:
                    metas.append(meta)
                    bodies.append(body)
        if metas:
            yield rows(*repeated_windows(metas, bodies, window))

    return run


def repeated_ranges(rows: DataFrame, window: int = WINDOW, seed: int = SEED, reach: int = REACH) -> DataFrame:
    """``(id, tk, lo, hi)``: byte ranges of ``rows`` covered by windows that stand at two places."""
    n = partitions_of(rows.sparkSession)
    runs = written(rows.mapInArrow(_runs(window, seed), RUNS))
    place = F.struct("id", "tk", "at")
    kinds = runs.groupBy("key", "digest").agg(
        F.min(F.struct("id", "tk", "at", "n", "ahead")).alias("p"), (F.min(place) != F.max(place)).alias("known")
    )
    kinds = written(kinds)
    whole = runs.join(kinds.where("known").select("key", "digest"), ["key", "digest"], "left_semi").select("id", "tk", F.col("at").alias("lo"), (F.col("at") + F.col("n") + window - 1).alias("hi"))
    several = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key")
    compared = kinds.join(several, "key").select("p.*", "key", F.col("known").cast("int").alias("known"))
    sent = meet(rows, compared, _pieces(window, reach, 2 * n), "shard int, packed binary", only_ranged=True)
    part = sent.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_sort(window), "id long, tk long, lo int, hi int")
    return whole.unionByName(part)


def _kept(id_, tk, data, offsets, found, cuts) -> Iterator[pa.RecordBatch]:
    edge = np.zeros(len(data) + 1, np.int32)
    if found is not None:
        base = np.repeat(offsets[:-1], np.diff(cuts))
        np.add.at(edge, base + found[0], 1)
        np.add.at(edge, base + found[1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts] = gone[starts]
    spans = np.concatenate([[0], np.cumsum(first)])
    stay = np.concatenate([[0], np.cumsum(~gone)])[offsets].astype(np.int32)
    kept = pa.BinaryArray.from_buffers(pa.binary(), len(id_), [None, pa.py_buffer(stay.tobytes()), pa.py_buffer(data[~gone].tobytes())])
    counts = [pa.array(np.diff(x).astype(np.int64)) for x in (offsets, total[offsets], spans[offsets])]
    yield pa.record_batch([pa.array(id_), *counts, kept], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup_bytes(docs: DataFrame, window: int = WINDOW, seed: int = SEED, reach: int = REACH) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``: each text without repeated windows; ``kept`` is binary."""
    rows = keyed(docs)
    kept = meet(rows, repeated_ranges(rows, window, seed, reach), _kept, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return kept.select(doc_id_of(F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    """Per document the bytes, the removed ones, the removed spans, and the digest of what is kept."""
    out = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
