"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector is its cell's centre plus a rest. The rest is padded with zeros to ``bits`` dimensions, rotated at
random, and kept as the signs of its coordinates, packed in 64-bit words, with three scalars: its length, the
cosine between it and its code, and its inner product with the centre. From these the inner product with any
query is estimated: the query's rotated difference from the centre is rounded to ``PLANES`` bits a coordinate,
so the estimate is a few AND and popcount operations on words, and its error is bounded by ``DEVIATIONS``
standard deviations of a random rotation (plus the rounding). Whatever may reach the query's ``k``-th best exact
score by that bound is ranked anew by exact inner products; the rest is never looked at. Cells whose best
possible score is below it are passed over whole.

Centres are fitted to at most ``FIT_ROWS`` vectors (least hashes of vec_id); every vector is indexed. Vectors
are dealt by hash into shards of about ``SHARD_ROWS``, so no cell is one task; queries go to every shard, which
streams them past its index, and the best of all shards are merged.

Defined results: a vector that is null, empty or zero, or holds null or non-finite components, takes no part,
neither as query nor as candidate. Shorter vectors count as if filled up with zeros. Rows equal in vec_id and
vector count once; rows that share only the vec_id are queries of their own, and a query takes none of the rows of its vec_id. Rows without vec_id are candidates (with a
null vec_id, before all others in ties) and no queries. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import NO_ID, doc_id_of, partitions_of, written
from lintlake.llm.text_arrays import lists_of, values

K, EVERY = 20, 20
BITS, PLANES, DEVIATIONS = 256, 4, 3.0
FIT_ROWS, CELLS, ROUNDS = 20_000, 64, 8
#: Vectors of a shard, queries that pass it at once, and pairs that are estimated at once.
SHARD_ROWS, QUERY_ROWS, PAIRS = 1 << 14, 2048, 1 << 18


def usable(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``(id, tk, v)``: the rows that take part, each once; ``tk`` digests the vector."""
    narrow = table.schema[vector].dataType.simpleString() == "array<float>"
    v = table[vector] if narrow else table[vector].cast("array<double>")
    real = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.coalesce(table[id_column].cast("long"), F.lit(NO_ID)).alias("id"), v.alias("v")).where(F.coalesce(real, F.lit(False)))
    return rows.distinct().select("id", F.xxhash64("v").alias("tk"), "v")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat, at = lists_of(column)
    out = np.zeros((len(column), dims))
    sizes = np.diff(at)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def centres(x: np.ndarray, cells: int = CELLS, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Means of groups of near vectors; fewer than ``cells`` if there are few vectors."""
    rng = np.random.default_rng(seed)
    found = x[rng.choice(len(x), max(1, min(cells, len(x) // 40)), replace=False)] if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        cell = nearest(x, found)
        for c in range(len(found)):
            if (cell == c).any():
                found[c] = x[cell == c].mean(0)
    return found


def nearest(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    return (x @ found.T - (found * found).sum(1) / 2).argmax(1)


def rotation(bits: int, dims: int, seed: int = 1) -> np.ndarray:
    """``dims`` orthonormal rows of a random rotation of ``bits`` dimensions: padding and rotating in one product."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    return (q * np.sign(np.diag(r)))[:dims]


@dataclass
class Model:
    """What the codes rest on: centres and rotation; of fixed size."""

    centres: np.ndarray
    rotation: np.ndarray

    @property
    def dims(self) -> int:
        return self.rotation.shape[0]

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]


def words_of(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans packed in 64-bit words."""
    return np.packbits(signs, axis=1, bitorder="little").view(np.uint64)


@dataclass
class Index:
    """The codes of some vectors, cell by cell."""

    model: Model
    ids: np.ndarray
    vectors: np.ndarray
    codes: np.ndarray
    rest: np.ndarray  # length of the rest
    cosine: np.ndarray  # between the rest and its code
    along: np.ndarray  # inner product of rest and centre
    first: np.ndarray  # of every cell


def index_of(model: Model, ids: np.ndarray, vectors: np.ndarray) -> Index:
    cell = nearest(vectors, model.centres)
    by = np.lexsort((ids, cell))
    ids, vectors, cell = ids[by], vectors[by], cell[by]
    rest = vectors - model.centres[cell]
    length = np.sqrt((rest * rest).sum(1))
    turned = rest @ model.rotation
    cosine = np.abs(turned).sum(1) / np.where(length > 0, length, 1) / np.sqrt(model.bits)
    return Index(
        model, ids, vectors, words_of(turned > 0), length, np.where(length > 0, np.maximum(cosine, model.bits**-0.5), 1.0), (rest * model.centres[cell]).sum(1),
        np.searchsorted(cell, np.arange(len(model.centres) + 1)),
    )


def estimates(index: Index, queries: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries with the vectors of a cell, and bounds of the errors."""
    model, at = index.model, slice(index.first[cell], index.first[cell + 1])
    centre, codes = model.centres[cell], index.codes[at]
    apart = queries - centre
    turned = apart @ model.rotation
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / (2**PLANES - 1), 1e-300)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    shared = np.zeros((len(queries), len(codes)), np.int32)
    for bit in range(PLANES):
        plane = words_of((level >> bit & 1).astype(bool))
        for w in range(codes.shape[1]):
            shared += np.bitwise_count(plane[:, w, None] & codes[:, w]).astype(np.int32) << bit
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    signed = low[:, None] * (2 * ones - model.bits) + step[:, None] * (2 * shared - level.sum(1, dtype=np.int64)[:, None])
    scale = index.rest[at] / index.cosine[at] / np.sqrt(model.bits)
    found = (queries @ centre)[:, None] + index.along[at] + signed * scale
    spread = index.rest[at] * np.sqrt(np.maximum(1 - index.cosine[at] ** 2, 0)) / index.cosine[at] / np.sqrt(model.bits - 1)
    distance = np.sqrt((apart * apart).sum(1))
    rounding = step[:, None] * scale * np.sqrt(model.bits / 12)
    bound = DEVIATIONS * np.hypot(distance[:, None] * spread, rounding)
    return found, bound + 1e-12 * (np.abs(found) + 1)


class Best:
    """The ``k`` best exact scores of every query so far."""

    def __init__(self, ids: np.ndarray, digests: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.digests, self.queries, self.k = ids, digests, queries, k
        self.owner, self.found, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(ids), -np.inf)

    def rank(self, index: Index, query: np.ndarray, vector: np.ndarray) -> None:
        """Exact scores of chosen pairs of a query and a vector."""
        other = self.ids[query] != index.ids[vector]
        query, vector = query[other], vector[other]
        score = np.concatenate([(self.queries[query[i : i + PAIRS]] * index.vectors[vector[i : i + PAIRS]]).sum(1) for i in range(0, len(query), PAIRS)] or [np.zeros(0)])
        owner = np.concatenate([self.owner, query])
        found, score = np.concatenate([self.found, index.ids[vector]]), np.concatenate([self.score, score])
        by = np.lexsort((found, -score, owner))
        owner, found, score = owner[by], found[by], score[by]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = place < self.k
        last = place == self.k - 1
        self.least[owner[last]] = score[last]
        self.owner, self.found, self.score = owner[keep], found[keep], score[keep]


def search(index: Index, ids: np.ndarray, digests: np.ndarray, queries: np.ndarray, k: int = K) -> Best:
    """The ``k`` best vectors of the index for every query (more precisely: all that the bounds let through, ranked)."""
    model, best = index.model, Best(ids, digests, queries, k)
    home = nearest(queries, model.centres)
    reach = np.array([index.rest[a:b].max(initial=0) for a, b in zip(index.first[:-1], index.first[1:], strict=True)])
    along = np.array([index.along[a:b].max(initial=-np.inf) for a, b in zip(index.first[:-1], index.first[1:], strict=True)])
    apart = np.sqrt(np.maximum((queries * queries).sum(1)[:, None] - 2 * queries @ model.centres.T + (model.centres**2).sum(1), 0))
    ceiling = (queries @ model.centres.T + along + apart * reach) * (1 + 1e-12) + 1e-9
    for own in (True, False):  # first the cell of the query itself: what it holds closes most others
        for cell in range(len(model.centres)):
            size = int(index.first[cell + 1] - index.first[cell])
            if not size:
                continue
            asked = np.flatnonzero((home == cell) if own else (home != cell) & (ceiling[:, cell] >= best.least))
            rows = max(1, PAIRS // size)
            for i in range(0, len(asked), rows):
                part = asked[i : i + rows]
                found, bound = estimates(index, queries[part], cell)
                least = best.least[part]
                if own and size > k:  # one more than k, as the query may be among them
                    least = np.maximum(least, np.partition(found - bound, size - k - 1, axis=1)[:, size - k - 1])
                q, v = np.nonzero(found + bound >= least[:, None])
                best.rank(index, part[q], v + index.first[cell])
    return best


def _search(model, k: int):
    """A shard's vectors come first and are indexed, then queries pass in blocks."""

    def out(best: Best) -> pa.RecordBatch:
        return pa.record_batch([pa.array(best.ids[best.owner]), pa.array(best.digests[best.owner]), pa.array(best.found), pa.array(best.score)], ["query", "digest", "id", "score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, index, waiting = None, [], None, []

        def passed():
            nonlocal waiting
            block = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            waiting = []
            return out(search(index, *block, k))

        for batch in batches:
            shards, kinds = values(batch, "shard"), values(batch, "kind")
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if shards[lo] != shard:
                    if waiting:
                        yield passed()
                    shard, held, index = shards[lo], [], None
                part = batch.slice(lo, hi - lo)
                rows = values(part, "id"), values(part, "tk"), matrix(part.column("v"), model.value.dims)
                if kinds[lo] == 0:
                    held.append((rows[0], rows[2]))
                    continue
                if index is None and held:
                    index = index_of(model.value, *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                if index is None:  # a shard without vectors
                    continue
                waiting.append(rows)
                if sum(len(w[0]) for w in waiting) >= QUERY_ROWS:
                    yield passed()
        if waiting:
            yield passed()

    return run


def fit(rows: DataFrame, bits: int = BITS, cells: int = CELLS, fit_rows: int = FIT_ROWS) -> Model:
    """Centres of a bounded sample, and a rotation wide enough for the longest vector."""
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 1
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(fit_rows).collect()
    x = np.zeros((len(sample), dims))
    for i, r in enumerate(sample):
        x[i, : len(r.v)] = r.v
    bits = -(-max(bits, dims) // 64) * 64
    return Model(centres(x, cells), rotation(bits, dims))


def neighbours(
    table: DataFrame, is_query: Column, k: int = K, id_column: str = "vec_id", vector: str = "embedding",
    shard_rows: int = SHARD_ROWS, bits: int = BITS, cells: int = CELLS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of the rows where ``is_query`` (on column ``id``) holds."""
    spark = table.sparkSession
    rows = written(usable(table, id_column, vector))
    model = spark.sparkContext.broadcast(fit(rows, bits, cells))
    shards = max(1, -(-rows.count() // shard_rows))
    shard = F.pmod(F.xxhash64("id", "tk"), F.lit(shards)).cast("int")
    # of equal vectors only the k + 1 least ids can be among anybody's k best: ties go to them
    alike = Window.partitionBy("tk", "v").orderBy("id")
    candidates = rows.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= k + 1)
    candidates = candidates.select(shard.alias("shard"), F.lit(0).alias("kind"), "id", "tk", "v")
    asked = rows.where(is_query & (F.col("id") != NO_ID))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "tk", "v")
    met = candidates.unionByName(asked).repartition(max(shards, partitions_of(spark)), "shard").sortWithinPartitions("shard", "kind")
    found = met.mapInArrow(_search(model, k), "query long, digest long, id long, score double")
    order = Window.partitionBy("query", "digest").orderBy(F.col("score").desc(), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("query").alias("query_id"), "rank", doc_id_of(F.col("id")).alias("vec_id"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % EVERY == 0)
