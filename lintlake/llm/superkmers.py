"""Substring dedup by words: windows that share a minimiser travel as one packed string to its bucket.

Every window of ``window`` words has a minimiser: the least hash among its runs of ``seed`` words.
Consecutive windows with the same minimiser form a super-k-mer, which is sent once, as a string, to
the bucket of the minimiser; equal windows meet there, since they have equal minimisers. A bucket
sorts its windows (by 128 bits of their words) and keeps the earliest of each. Only the word ranges
to remove go back to the documents.

Hot minimisers: a first pass finds those that hold more than ``1 / HOT_SHARE`` of all super-k-mers
(each task reports at most ``4 * HOT_SHARE`` of its own, so the list is bounded whatever the input).
Their windows travel one by one under a hash of their own, so a passage that a third of all documents
share meets in many buckets, and what is equal within a task is sent once.

Defined results: a null or empty text, or one shorter than a window, loses nothing. Rows that repeat
doc_id and text count as one document and get equal rows; a missing doc_id comes before all others.
Extra columns of any name are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import doc_id_of, keyed, packed, partitions_of, unpacked
from lintlake.llm.packets import meet
from lintlake.llm.text_arrays import (
    BASE, BASE_2, NOT_SPACE, Sums, chunks, ngrams, ranges, sliding_min, split, texts_of, values, word_hashes,
)

WINDOW, SEED = 20, 3
#: A minimiser with more than 1 / HOT_SHARE of all super-k-mers is split.
HOT_SHARE = 1024
#: Bytes of packed strings that a task gathers before it sends them.
SEND_BYTES = 16 << 20
BUCKETS_PER_PARTITION = 4


def normal_words(data: np.ndarray, offsets: np.ndarray):
    """The words, each followed by one space or by the next text: bytes, starts, ends, first word of each text."""
    starts, ends, first = split(data, offsets, NOT_SPACE)
    word = NOT_SPACE[data]
    keep = word.copy()
    keep[1:] |= word[:-1]
    at = np.cumsum(keep) - 1
    lo = at[starts] if len(starts) else starts
    flat = np.where(word, data, np.uint8(0x20))[keep]
    return flat, lo, lo + (ends - starts), first


def superkmers(flat, starts, ends, first, window: int, seed: int):
    """Runs of windows with one minimiser: text, first window (word of the text), windows, byte range, key, digest."""
    n = len(starts)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = Sums(flat)
    grams = ngrams(sums.hash(starts, ends), seed)
    bits = np.uint64(32)  # the upper half of a hash ranks, the first of equal ones wins
    ranked = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(ranked, window - seed + 1)
    where = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(first, np.arange(len(where)), side="right") - 1
    valid = np.arange(len(where)) + window <= first[text + 1]
    new = np.ones(len(where), bool)
    new[1:] = (where[1:] != where[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new & valid)
    run = np.cumsum(new)[valid]
    count = np.bincount(run - run[0], minlength=0) if len(run) else np.zeros(0, np.int64)
    count = count[count > 0]
    lo, hi = starts[begin], ends[begin + count + window - 2]
    return text[begin], begin - first[text[begin]], count, lo, hi, grams[where[begin]], sums.hash(lo, hi) ^ (hi - lo).astype(np.uint64)


def _heavy(window: int, seed: int, share: int):
    """Per task the minimisers with at least a ``4 * share``-th of its super-k-mers, and the number of all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, counts = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in chunks(batches):
            found = superkmers(*normal_words(*texts_of(batch.column("text"))), window, seed)
            key, n = np.unique(found[5], return_counts=True)
            total += int(n.sum())
            every = np.concatenate([held, key])
            held, at = np.unique(every, return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(held)).astype(np.int64)
            if len(held) > 64 * share:  # a key that falls out here held less than the bound so far
                keep = counts * 16 * share >= total
                held, counts = held[keep], counts[keep]
        keep = counts * 4 * share >= max(total, 1)
        yield pa.record_batch(
            [pa.array(np.append(held[keep].view(np.int64), 0)), pa.array(np.append(counts[keep], total)),
             pa.array(np.append(np.zeros(int(keep.sum()), bool), True))], ["key", "n", "all"],
        )

    return run


def heavy_minimisers(rows: DataFrame, window: int = WINDOW, seed: int = SEED, share: int = HOT_SHARE) -> np.ndarray:
    """Minimisers of more than one ``share``-th of all super-k-mers: at most ``4 / 3 * share`` of them."""
    counted = rows.select("text").mapInArrow(_heavy(window, seed, share), "key long, n long, all boolean")
    summed = counted.groupBy("key", "all").agg(F.sum("n").alias("n"))
    ranked = summed.orderBy(F.col("all").desc(), F.col("n").desc()).limit(2 * share + 1).collect()
    total = next((r.n for r in ranked if r["all"]), 0)
    return np.sort(np.array([r.key for r in ranked if not r["all"] and 4 * share * r.n >= 3 * total], np.int64).view(np.uint64))


def _send(window: int, seed: int, hot: np.ndarray, buckets: int):
    """Super-k-mers of a task, equal ones once, packed by bucket."""

    def singles(found, starts, ends, first, sums):
        text, at, count, lo, hi, key, digest = found
        if not len(hot) or not len(key):
            return found
        place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        is_hot = hot[place] == key
        if not is_hot.any():
            return found
        one = ranges(at[is_hot], count[is_hot])
        owner = np.repeat(text[is_hot], count[is_hot])
        word = first[owner] + one
        own_lo, own_hi = starts[word], ends[word + window - 1]
        own = sums.hash(own_lo, own_hi) ^ (own_hi - own_lo).astype(np.uint64)
        cold = ~is_hot
        return tuple(
            np.concatenate([a[cold], b]) for a, b in zip(found, (owner, one, np.ones(len(one), np.int64), own_lo, own_hi, own, own), strict=True)
        )

    def flush(held, strings):
        id_, tk, at, count, key, digest = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, tk, id_, digest, key))
        id_, tk, at, count, key, digest = (x[order] for x in (id_, tk, at, count, key, digest))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        later = ~((id_ == id_[head]) & (tk == tk[head]) & (at == at[head]))  # the same place of a repeated row isn't later
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        for group in (new, later & ~new):
            by = np.argsort(bucket[group], kind="stable")
            chosen = np.flatnonzero(group)[by]
            cuts = np.flatnonzero(np.diff(bucket[chosen])) + 1
            for part in np.split(chosen, cuts) if len(chosen) else []:
                meta = (id_[part], tk[part], at[part], count[part])
                joined = b" ".join([strings[i] for i in order[part]]) if group is new else None
                yield int(bucket[part[0]]), packed((meta, joined))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, strings, size = [], [], 0

        def out():
            rows = list(flush(held, strings))
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "packed"])

        for batch in chunks(batches):
            flat, starts, ends, first = normal_words(*texts_of(batch.column("text")))
            found = superkmers(flat, starts, ends, first, window, seed)
            text, at, count, lo, hi, key, digest = singles(found, starts, ends, first, Sums(flat) if len(hot) else None)
            if not len(text):
                continue
            held.append((values(batch, "id")[text], values(batch, "tk")[text], at, count, key, digest))
            body = flat.tobytes()
            strings += [body[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            size += int((hi - lo).sum()) + 64 * len(lo)
            if size >= SEND_BYTES:
                yield out()
                held, strings, size = [], [], 0
        if held:
            yield out()

    return run


def later_windows(metas, bodies: list[bytes], window: int):
    """Word ranges of windows that also start earlier, among the super-k-mers of one bucket."""
    id_, tk, at, count = (np.concatenate(x) for x in zip(*metas, strict=True))
    data = np.frombuffer(b" ".join(bodies), np.uint8)
    starts, ends, _ = split(data, np.array([0, len(data)]), NOT_SPACE)
    words = count + window - 1
    base = np.cumsum(words) - words
    order = np.lexsort((at, tk, id_))  # earliest first: a stable sort of windows then puts the earliest ahead
    same = np.zeros(len(order), bool)
    same[1:] = (np.diff(id_[order]) == 0) & (np.diff(tk[order]) == 0) & (np.diff(at[order]) == 0)
    order = order[~same]  # one place that two tasks sent, because its row is repeated
    id_, tk, at, count, base = (x[order] for x in (id_, tk, at, count, base))
    index = ranges(base, count)
    digests = [ngrams(word_hashes(data, starts, ends, b), window, b)[index] for b in (BASE, BASE_2)]
    by = np.lexsort(digests[::-1])
    again = np.zeros(len(by), bool)
    again[1:] = (digests[0][by][1:] == digests[0][by][:-1]) & (digests[1][by][1:] == digests[1][by][:-1])
    later = np.zeros(len(by), bool)
    later[by] = again
    piece = np.repeat(np.arange(len(count)), count)
    word = ranges(at, count)
    before, after = later.copy(), later.copy()
    before[1:] &= ~(later[:-1] & (piece[1:] == piece[:-1]))
    after[:-1] &= ~(later[1:] & (piece[1:] == piece[:-1]))
    lo, hi = np.flatnonzero(before), np.flatnonzero(after)
    return id_[piece[lo]], tk[piece[lo]], word[lo], word[hi] + window


def _sort(window: int):
    """Sort the windows of each bucket; the rows of a partition come by bucket."""

    def rows(id_, tk, lo, hi):
        return pa.record_batch([pa.array(id_, pa.int64()), pa.array(tk, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["id", "tk", "lo", "hi"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, metas, bodies = None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.column(0)[i].as_py()
                if b != bucket and metas:
                    yield rows(*later_windows(metas, bodies, window))
                    metas, bodies = [], []
                bucket = b
                meta, body = unpacked(batch.column(1)[i].as_py())
                if body is None:
                    yield rows(meta[0], meta[1], meta[2], meta[2] + meta[3] + window - 1)
                else:
                    metas.append(meta)
                    bodies.append(body)
        if metas:
            yield rows(*later_windows(metas, bodies, window))

    return run


def repeated_ranges(rows: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``(id, tk, lo, hi)``: word ranges covered by windows that also start earlier."""
    n = partitions_of(rows.sparkSession)
    hot = heavy_minimisers(rows, window, seed)
    sent = rows.mapInArrow(_send(window, seed, hot, n * BUCKETS_PER_PARTITION), "bucket int, packed binary")
    met = sent.repartition(n, "bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(_sort(window), "id long, tk long, lo int, hi int")


def _kept(id_, tk, data, offsets, found, cuts) -> Iterator[pa.RecordBatch]:
    flat, starts, ends, first = normal_words(data, offsets)
    edge = np.zeros(len(starts) + 1, np.int64)
    if found is not None:
        base = np.repeat(first[:-1], np.diff(cuts))
        np.add.at(edge, base + found[0], 1)
        np.add.at(edge, base + found[1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    texts, body = [], flat.tobytes()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if a == b:
            texts.append("")
        elif total[b] == total[a]:
            texts.append(body[starts[a] : ends[b - 1]].decode())
        else:
            stay = np.flatnonzero(~gone[a:b]) + a
            texts.append(b" ".join([body[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]).decode())
    yield pa.record_batch([pa.array(id_), pa.array(np.diff(first)), pa.array(np.diff(total[first])), pa.array(texts, pa.string())], ["id", "n_words", "n_removed", "kept"])


def dedup_substrings(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: each document without the words of windows seen earlier."""
    rows = keyed(docs)
    kept = meet(rows, repeated_ranges(rows, window, seed), _kept, "id long, n_words long, n_removed long, kept string")
    return kept.select(doc_id_of(F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    """Per document the words, the removed ones and the digest of what is kept."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
