"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word bucket has a sparse index vector (``NONZERO`` places of ``DIMS``, half of them negative), given
by its hash. A word's vector is the sum of the index vectors of its neighbours over all documents; tasks
add up their own counts, partial sums meet in two steps, and a matrix of fixed size reaches the driver.
A document is the mean of its words' vectors, rare words weighing more, with a few measures of its form.

A network with one hidden layer is fitted in numpy on the driver to at most ``FIT_ROWS`` labelled
documents (the least hashes of doc_id, so the choice doesn't depend on partitions); a temperature fitted to
documents that training left out makes its scores probabilities. All documents are scored. Labels, lang,
source and doc_id are no inputs.

Defined results: a null or empty text has the zero vector and gets the network's score for it. Repeated
rows are scored each. Documents without label count for the word vectors only; a missing label is none; of
several labels of a document the greatest counts. Without labels of both kinds the score is the share of
label 1 (0.5 without any). Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import key_columns, packed, partitions_of, unpacked
from lintlake.llm.text_arrays import ALNUM, CHUNK_BYTES, NOT_SPACE, Sums, chunks, mix, split, texts_of

BUCKETS, DIMS, NONZERO, REACH = 1 << 15, 64, 4, 2
BLOCK = 1024
SALT = 16
FIT_ROWS, HIDDEN, EPOCHS, BATCH = 20_000, 32, 40, 256
#: Words whose vectors are held at once, or those of one text.
POOLED = 1 << 15
THRESHOLD = 0.3
HELD_OUT = 5


def tokens_of(data: np.ndarray, offsets: np.ndarray):
    """Words and runs of signs, as buckets in text order, with the first one of each text."""
    parts = [split(data, offsets, kind) for kind in (ALNUM, NOT_SPACE & ~ALNUM)]
    starts, ends = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], ends[by]
    hashes = Sums(data).hash(starts, ends)
    return (hashes >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1), np.searchsorted(starts, offsets), starts, ends


def index_vectors() -> np.ndarray:
    """Places of the index vector of every bucket; the signs take turns, beginning with plus."""
    h = mix(np.arange(1, BUCKETS * NONZERO + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).reshape(BUCKETS, NONZERO)
    return (h % np.uint64(DIMS)).astype(np.int64)


def _gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the index vectors of neighbours, and counts, of the documents of a task."""
    places = index_vectors()
    total = np.zeros(BUCKETS * DIMS, np.int64)
    count = np.zeros(BUCKETS, np.int64)
    for batch in chunks(batches):
        bucket, first, _, _ = tokens_of(*texts_of(batch.column("text")))
        count += np.bincount(bucket, minlength=BUCKETS)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        pairs = []
        for step in range(1, REACH + 1):
            same = text[step:] == text[:-step]
            a, b = bucket[:-step][same], bucket[step:][same]
            pairs += [(a, b), (b, a)]
        for k in range(NONZERO if len(bucket) else 0):  # one place at a time: what a worker holds is a part of the chunk's pairs
            where = np.concatenate([word * DIMS + places[neighbour, k] for word, neighbour in pairs])
            (np.subtract if k % 2 else np.add)(total, np.bincount(where, minlength=BUCKETS * DIMS), out=total)
    salt = TaskContext.get().partitionId() % SALT
    yield _blocks(salt, total.reshape(BUCKETS, DIMS), count)


def _blocks(salt: int, total: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    at = range(0, BUCKETS, BLOCK)
    body = [packed((total[i : i + BLOCK], count[i : i + BLOCK])) for i in at]
    return pa.record_batch([pa.array([i // BLOCK for i in at], pa.int32()), pa.array([salt] * len(body), pa.int32()), pa.array(body, pa.binary())], ["block", "salt", "body"])


def _add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum per block; a task holds at most the whole matrix."""
    sums: dict[tuple, list] = {}
    for batch in batches:
        for block, salt, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = unpacked(body)
            have = sums.setdefault((block, salt), [0, 0])
            have[0], have[1] = have[0] + part[0], have[1] + part[1]
    rows = [(b, s, packed(tuple(x))) for (b, s), x in sums.items()]
    yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["block", "salt", "body"])


BLOCKS = "block int, salt int, body binary"


def word_vectors(docs: DataFrame) -> np.ndarray:
    """A weighted unit vector per bucket, from all documents."""
    n = partitions_of(docs.sparkSession)
    rows = docs.select(key_columns(docs)["text"].alias("text")).mapInArrow(_gather, BLOCKS)
    rows = rows.repartition(n, "block", "salt").mapInArrow(_add, BLOCKS).select("block", F.lit(0).alias("salt"), "body")
    total, count = np.zeros((BUCKETS, DIMS)), np.zeros(BUCKETS)
    for row in rows.repartition(min(n, BUCKETS // BLOCK), "block").mapInArrow(_add, BLOCKS).toLocalIterator():
        total[row.block * BLOCK : (row.block + 1) * BLOCK], count[row.block * BLOCK : (row.block + 1) * BLOCK] = unpacked(bytes(row.body))
    seen = count > 0
    if not seen.any():
        return total.astype(np.float32)
    total -= count[:, None] * (total.sum(0) / count.sum())
    vectors = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    share = count / count.sum()
    return (vectors * (1e-3 / (1e-3 + share))[:, None] * seen[:, None]).astype(np.float32)


def features(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Pooled vector and form of each text."""
    bucket, first, starts, ends = tokens_of(data, offsets)
    n = np.diff(first)
    size = np.maximum(n, 1)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), DIMS + 8), np.float32)
    if not len(full):
        return out
    at = first[full]
    i = 0
    while i < len(full):  # some texts at a time: the vectors of all words of a chunk are much larger than the chunk
        j = max(i + 1, int(np.searchsorted(first[full + 1], at[i] + POOLED, side="right")))
        some = full[i:j]
        out[some, :DIMS] = np.add.reduceat(vectors[bucket[at[i] : first[some[-1] + 1]]], at[i:j] - at[i], axis=0) / size[some, None] * 4
        i = j
    text = np.repeat(np.arange(len(n)), n)
    by = np.lexsort((bucket, text))
    new = np.ones(len(by), bool)
    new[1:] = (np.diff(bucket[by]) != 0) | (np.diff(text[by]) != 0)
    sign = ~ALNUM[data[starts]]
    upper = (data[starts] >= 0x41) & (data[starts] <= 0x5A)
    again = np.zeros(len(bucket), bool)
    again[1:] = (bucket[1:] == bucket[:-1]) & (text[1:] == text[:-1])
    shape = [np.add.reduceat(x.astype(np.float64), at) / size[full] for x in (new, sign, upper, again, ends - starts)]
    out[full, DIMS:DIMS + 5] = np.stack([*shape[:4], np.log1p(shape[4])], 1)
    length = np.diff(offsets)[full]
    out[full, DIMS + 5] = np.log1p(n[full]) / 4
    out[full, DIMS + 6] = np.log1p(length) / 8
    out[full, DIMS + 7] = np.linalg.norm(out[full, :DIMS], axis=1)
    return out


@dataclass
class Network:
    """Two layers over standardised inputs; ``temperature`` divides the last sum."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        return (hidden @ self.w2 + self.b2).astype(np.float64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def constant(share: float, width: int = DIMS + 8) -> Network:
    bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), bias)


def fit(x: np.ndarray, y: np.ndarray, left_out: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> Network:
    """Adam on the logistic loss of the rows that aren't left out, then the temperature on those that are."""
    if len(y) < 10 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5, x.shape[1] if len(y) else DIMS + 8)
    rng = np.random.default_rng(seed)
    train = np.flatnonzero(~left_out)
    mean, scale = x[train].mean(0), x[train].std(0) + 1e-3
    z = ((x - mean) / scale).astype(np.float32)
    p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-5
        order = rng.permutation(train)
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            a = z[rows]
            h = a @ p[0] + p[1]
            r = np.maximum(h, 0)
            out = 1 / (1 + np.exp(-np.clip(r @ p[2] + p[3], -30, 30)))
            d = (out - y[rows]) / len(rows)
            dh = d[:, None] * p[2] * (h > 0)
            step += 1
            for k, g in enumerate((a.T @ dh + 1e-4 * p[0], dh.sum(0), r.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    network = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if left_out.any():
        logits, target = network.logits(x[left_out]), y[left_out]
        loss = {t: np.mean(np.logaddexp(0, logits / t) - target * logits / t) for t in np.geomspace(0.25, 16, 60)}
        network.temperature = float(min(loss, key=loss.get))
    return network


def held_out(doc_id):
    """Whether labels of a document are kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def _features(vectors):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            x = features(*texts_of(batch.column("text")), vectors.value)
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "label", "x"])

    return run


@dataclass
class Model:
    vectors: object  # broadcast
    network: Network


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Word vectors from all of ``docs``; the network from a bounded sample of labelled ones."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    key = key_columns(docs)
    usable = labels.select(labels["doc_id"].cast("long").alias("id"), labels["quality"].cast("int").alias("label")).where("id is not null and label in (0, 1)")
    usable = usable.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(fit_rows)  # at most fit_rows pairs of numbers, so broadcast
    rows = docs.select(key["id"].alias("id"), key["text"].alias("text")).join(F.broadcast(sample), "id")
    found = rows.mapInArrow(_features(vectors), "id long, label int, x binary").orderBy("id", "x").limit(2 * fit_rows).collect()
    x = np.array([np.frombuffer(r.x, np.float32) for r in found], np.float32).reshape(len(found), DIMS + 8)
    y = np.array([r.label for r in found], np.float64)
    left_out = np.array([zlib.crc32(f"t{r.id}".encode()) % 5 == 0 for r in found], bool)
    return Model(vectors, fit(x, y, left_out))


def _score(vectors, network: Network, column: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, column, CHUNK_BYTES):
            score = network(features(*texts_of(batch.column(column)), vectors.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], schema=schema)

    return run


SCORE = "__quality_score"


def score_name(docs: DataFrame) -> str:
    """:data:`SCORE`, or a longer name if the table has that one."""
    taken, name = {c.lower() for c in docs.columns}, SCORE
    while name.lower() in taken:
        name = f"_{name}"
    return name


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the probability of label 1 in a last column, named by :func:`score_name`."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*docs.schema.fields, T.StructField(score_name(docs), T.DoubleType())])
    return docs.mapInArrow(_score(model.vectors, model.network, docs.columns.index("text"), to_arrow_schema(schema)), schema)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that the classifier rejects."""
    return scored(docs, learn(docs, labels)).where(F.col(score_name(docs)) >= threshold).drop(score_name(docs))


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    out = scored(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    """Score and decision of every document."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
