"""Benchmark decontamination: an FM-index per training shard, searched backwards for the test phrases.

A task takes its documents in shards of ``SHARD_BYTES``. Words that no phrase has can't take part in a
match, so a shard keeps the runs of phrase words that are long enough to hold a phrase, with separators
between them; suffixes of that sequence are sorted, its Burrows-Wheeler transform goes into a wavelet
matrix, and every 16th suffix position is kept. All phrases are searched at once, last word first, by
ranks of the matrix; the rows that match walk back to a sampled position, and the spans found are merged
per document. Nothing is shuffled.

Phrases are the windows of 10 words of each benchmark item, or the whole item if it has fewer. They go to
the tasks in blocks of at most ``BLOCK_BYTES`` of item text: their number follows the benchmark, each
block's size is bounded, and every block meets all documents in the same pass over them. One Python worker a task
takes all blocks in turn, and cuts the spans out: texts go to Python once.

Defined results: nulls and empty texts have no words and no hits; items without words, or without an id,
match nothing; repeated items count once; repeated documents are judged each for itself; extra columns
pass through untouched. Empty tables give no rows or no hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import small_batches
from lintlake.llm.text_arrays import ALNUM, LOWER, Sums, chunks, lists_of, ranges, split, texts_of

WINDOW = 10
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 8 << 20
SAMPLE = 16
#: First symbols: the end of the sequence, the end of a run, then words.
END, GAP, WORDS = 0, 1, 2


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """All suffixes of a sequence that ends with its only least symbol, sorted by doubling the compared length."""
    n = len(seq)
    _, rank = np.unique(seq, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[1:] = np.diff(key[order]) != 0
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Rank of any symbol before any position in as many steps as symbols have bits."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            padded = np.zeros((len(seq) // 64 + 1) * 64, bool)
            padded[: len(seq)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((level, packed, before, int(len(seq) - bit.sum())))
            seq = np.concatenate([seq[~bit], seq[bit]])

    @staticmethod
    def ones(packed, before, at):
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << rest) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        start = np.zeros(len(at), np.int64)
        for level, packed, before, zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            a, s = self.ones(packed, before, at), self.ones(packed, before, start)
            at = np.where(one, zeros + a, at - a)
            start = np.where(one, zeros + s, start - s)
        return at - start

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for level, packed, before, zeros in self.levels:
            one = packed[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1
            a = self.ones(packed, before, at)
            at = np.where(one, zeros + a, at - a)
            out |= one.astype(np.int64) << level
        return out


class FMIndex:
    """Counts and places of phrases in a sequence of small numbers that ends with :data:`END`."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = SAMPLE):
        order = suffix_order(seq)
        self.size = len(seq)
        self.matrix = WaveletMatrix(seq[order - 1], max(1, int(symbols - 1).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        kept = order % sample == 0
        self.kept, self.places = kept, order[kept]
        self.before = np.concatenate([[0], np.cumsum(kept)])

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``[lo, hi)`` of suffixes that start with each phrase (one per line of the array)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        for c in phrases.T[::-1]:
            lo, hi = self.first[c] + self.matrix.rank(c, lo), self.first[c] + self.matrix.rank(c, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, left, row, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows, 0
        while len(left):
            done = self.kept[row]
            out[left[done]] = self.places[self.before[row[done]]] + steps
            left, row = left[~done], row[~done]
            c = self.matrix.symbol(row)
            row, steps = self.first[c] + self.matrix.rank(c, row), steps + 1
        return out


class Phrases:
    """The windows of a block of items: vocabulary, distinct windows by length, and the items that have each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        bodies = [text.encode() for _, text in items]
        data = LOWER[np.frombuffer(b"".join(bodies), np.uint8)]
        offsets = np.cumsum([0, *map(len, bodies)])
        starts, ends, first = split(data, offsets, ALNUM)
        words = Sums(data).hash(starts, ends)
        self.vocabulary, symbol = np.unique(words, return_inverse=True)
        symbol += WORDS
        found: dict[tuple, set[str]] = {}
        for (name, _), a, b in zip(items, first[:-1].tolist(), first[1:].tolist(), strict=True):
            for i in range(a, max(b - window, a) + 1 if b > a else a):
                found.setdefault(tuple(symbol[i : min(i + window, b)].tolist()), set()).add(name)
        self.by_length = {}
        for size in sorted({len(k) for k in found}):
            keys = [k for k in found if len(k) == size]
            self.by_length[size] = (np.array(keys, np.int64), [sorted(found[k]) for k in keys])
        self.least = min(self.by_length, default=0)


def find(phrases: Phrases, data: np.ndarray, offsets: np.ndarray):
    """Words hit, the first word of each text, and ``(text, item)`` pairs of items with occurring phrases."""
    lowered = LOWER[data]
    starts, ends, first = split(lowered, offsets, ALNUM)
    edge = np.zeros(len(starts) + 1, np.int64)
    pairs: set[tuple[int, str]] = set()
    if not phrases.least or not len(starts):
        return edge[:-1] > 0, first, pairs
    words = Sums(lowered).hash(starts, ends)
    place = np.minimum(np.searchsorted(phrases.vocabulary, words), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[place] == words
    text = np.searchsorted(first, np.arange(len(words)), side="right") - 1
    new = np.ones(len(words), bool)
    new[1:] = (known[1:] != known[:-1]) | (text[1:] != text[:-1])
    run = np.flatnonzero(new)
    size = np.diff(np.append(run, len(words)))
    keep = known[run] & (size >= phrases.least)
    run, size = run[keep], size[keep]
    if not len(run):
        return edge[:-1] > 0, first, pairs
    # each run and the gap after it; the last symbol is the end
    at = ranges(run, size + 1)
    gap = np.cumsum(size + 1) - 1
    seq = place[np.minimum(at, len(words) - 1)] + WORDS
    seq[gap] = GAP
    index = FMIndex(np.append(seq, END), len(phrases.vocabulary) + WORDS)
    for length, (keys, names) in phrases.by_length.items():
        lo, hi = index.search(keys)
        hit = np.flatnonzero(hi > lo)
        which = np.repeat(hit, hi[hit] - lo[hit])
        word = at[index.locate(ranges(lo[hit], hi[hit] - lo[hit]))]
        np.add.at(edge, word, 1)
        np.add.at(edge, word + length, -1)
        seen = np.unique(text[word] * len(keys) + which)
        pairs.update((t, n) for t, k in zip((seen // len(keys)).tolist(), (seen % len(keys)).tolist(), strict=True) for n in names[k])
    return np.cumsum(edge[:-1]) > 0, first, pairs


def _search(phrases, column: int, schema: pa.Schema):
    """Add what one block of phrases hits to the word ranges and items found so far."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, column, SHARD_BYTES):
            hit, first, pairs = find(phrases.value, *texts_of(batch.column(column)))
            n = batch.num_columns
            lo, at = lists_of(batch.column(n - 3))
            hi, _ = lists_of(batch.column(n - 2))
            base = np.repeat(first[:-1], np.diff(at))
            edge = np.bincount(base + lo, minlength=len(hit) + 1) - np.bincount(base + hi, minlength=len(hit) + 1)
            hit |= np.cumsum(edge)[: len(hit)] > 0
            text = np.searchsorted(first, np.arange(len(hit)), side="right") - 1
            begin, end = hit.copy(), hit.copy()
            begin[1:] &= ~(hit[:-1] & (text[1:] == text[:-1]))
            end[:-1] &= ~(hit[1:] & (text[1:] == text[:-1]))
            lo, hi = np.flatnonzero(begin), np.flatnonzero(end)
            sizes = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[lo], minlength=batch.num_rows))]), pa.int32())
            spans = [pa.ListArray.from_arrays(sizes, pa.array(x - first[text[lo]] + d, pa.int32())) for x, d in ((lo, 0), (hi, 1))]
            names = [set(x or ()) for x in batch.column(n - 1).to_pylist()]
            for t, name in pairs:
                names[t].add(name)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: n - 4], pa.array(np.diff(first), pa.int64()), *spans, pa.array([sorted(x) for x in names], pa.list_(pa.string()))], schema=schema
            )

    return run


#: Columns that are added; their names are kept apart from those of any table.
N_WORDS, LO, HI, ITEMS = "__leak_words", "__leak_lo", "__leak_hi", "__leak_items"
FOUND = [(N_WORDS, "bigint"), (LO, "array<int>"), (HI, "array<int>"), (ITEMS, "array<string>")]


def _in_turn(steps: list):
    """All steps in one Python worker: each takes the batches of its predecessor as they come."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        yield from batches

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, last=None) -> DataFrame:
    """``docs`` with the columns of :data:`FOUND` at the end: words, merged ranges of hit words, items that occur.

    With ``last``, that function of batches, which gives the columns of ``docs``, follows in the same worker.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(benchmark["item_id"].cast("string").alias("item"), benchmark["text"].cast("string").alias("text")).where("item is not null and text is not null")
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    column = docs.columns.index("text")
    found = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in FOUND]
    schema = T.StructType([*docs.schema.fields, *found])
    out = docs.select("*", *[(F.lit(0) if k == "bigint" else F.array()).cast(k).alias(n) for n, k in FOUND])
    steps = []
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        phrases = spark.sparkContext.broadcast(Phrases([(r.item, r.text) for r in part], window))
        steps.append(_search(phrases, column, to_arrow_schema(schema)))
    return out.mapInArrow(_in_turn([*steps, last] if last else steps), docs.schema if last else schema)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items, contaminated)`` of every document."""
    found = find_leaks(docs.select("doc_id", docs["text"].cast("string").alias("text")), benchmark, window)
    n_hit = F.aggregate(F.zip_with(LO, HI, lambda a, b: (b - a).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(N_WORDS).alias("n_words"), n_hit.alias("n_hit"),
        F.size(ITEMS).cast("long").alias("n_items"), F.array_sort(ITEMS).alias("items"), (n_hit > 0).alias("contaminated"),
    )


def _cut(column: int, columns: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, column):
            data, offsets = texts_of(batch.column(column))
            starts, ends, first = split(LOWER[data], offsets, ALNUM)
            lo, at = lists_of(batch.column(columns + 1))
            hi, _ = lists_of(batch.column(columns + 2))
            base = np.repeat(first[:-1], np.diff(at))
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, starts[base + lo], 1)
            np.add.at(edge, ends[base + hi - 1], -1)
            stay = np.cumsum(edge[:-1]) == 0
            sizes = np.concatenate([[0], np.cumsum(stay)])[offsets]
            text = pa.StringArray.from_buffers(batch.num_rows, pa.py_buffer(sizes.astype(np.int32).tobytes()), pa.py_buffer(data[stay].tobytes()))
            text = pa.array([t if v else None for t, v in zip(text.to_pylist(), batch.column(column).is_valid().to_pylist(), strict=True)], pa.string())
            hit = np.concatenate([[0], np.cumsum(hi - lo)])[at]
            whole = (np.diff(hit) == np.diff(first)) & (np.diff(first) > 0)
            rows = [text if i == column else c for i, c in enumerate(batch.columns[:columns])]
            yield pa.RecordBatch.from_arrays(rows, schema=schema).filter(pa.array(~whole))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the spans of benchmark phrases; a document all of whose words are hit goes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return find_leaks(docs, benchmark, window, last=_cut(docs.columns.index("text"), len(docs.columns), to_arrow_schema(docs.schema)))


def query(spark, sf_dir: str) -> DataFrame:
    """Per document the words, the hit ones, and the items that occur."""
    out = report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    joined = F.array_join("items", ",").cast("binary")
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(joined, 256).alias("items_sha256"), "contaminated")
