import zlib

import numpy as np

from lintlake.llm import random_index as ri

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1, n0 = label.sum(), (1 - label).sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n0 * n1)


def test_held_out_documents_are_judged_well(spark):
    rows = {r.doc_id: r for r in ri.query(spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for k, r in rows.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = [(rows[k].score, rows[k].predicted, y) for k, y in labels.items() if rows[k].held_out]
    score, predicted, label = (np.array(x) for x in zip(*out, strict=True))
    assert auc(score, label) > 0.97 and (predicted == label).mean() > 0.9
    assert abs(score.mean() - label.mean()) < 0.08


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(ri.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in ri.report(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_edge_cases(spark, docs_of):
    good = "The quick fox runs over a lazy dog and then it sleeps."
    rows = [(i, f"{good} {good[i:]}") for i in range(60)] + [(100 + i, "buy *** now $$$ " * (3 + i)) for i in range(60)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, good), (7, rows[7][1]), (203, "w " * 400_000)]
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)] + [(7, None), (None, 1), (999, 0)], "doc_id long, quality int")
    docs = docs_of(rows, score="string", quality="int", label="int")
    out = ri.report(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    assert min(by[i] for i in range(60)) > 0.5 > max(by[100 + i] for i in range(60)) and by[200] == by[201] == by[202]
    kept = ri.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(60))
    assert {r.score for r in ri.report(docs, labels.limit(0)).collect()} == {0.5}
    assert ri.report(docs_of({}), labels).collect() == []


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6)).astype(np.float32)
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(np.float64)
    left_out = np.arange(4000) % 4 == 0
    p = ri.fit(x, y, left_out)(x[left_out])
    for lo in (0.0, 0.25, 0.5, 0.75):
        m = (p >= lo) & (p < lo + 0.25)
        assert abs(p[m].mean() - y[left_out][m].mean()) < 0.08


def test_clashing_score_column(spark, docs_of):
    docs = docs_of({i: "good words here" for i in range(6)}, __quality_score="double")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    kept = ri.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == 6


def test_a_chunk_takes_little_memory(monkeypatch):
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from lintlake.llm.text_arrays import texts_of

    monkeypatch.setattr(ri, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}," for x in rng.integers(0, 3000, 150)) for _ in range(1000)]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    vectors = rng.random((ri.BUCKETS, ri.DIMS)).astype(np.float32)
    list(ri._gather([batch]))  # tables that a worker keeps
    for work, most in ((lambda: list(ri._gather([batch])), 110), (lambda: ri.features(*texts_of(batch.column("text")), vectors), 60)):
        tracemalloc.start()
        work()
        assert tracemalloc.get_traced_memory()[1] < most << 20
        tracemalloc.stop()


def test_texts_are_pooled_alike_alone_and_together():
    rng = np.random.default_rng(6)
    bodies = [" ".join(f"w{x}" for x in rng.integers(0, 50, n)).encode() for n in (0, 3, 2 * ri.POOLED, 1, 0, ri.POOLED - 2, 5, 900, 0)]
    vectors = rng.random((ri.BUCKETS, ri.DIMS)).astype(np.float32)
    alone = [ri.features(np.frombuffer(b, np.uint8), np.array([0, len(b)]), vectors)[0] for b in bodies]
    data, offsets = np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([0, *map(len, bodies)])
    assert (ri.features(data, offsets, vectors) == np.array(alone)).all()
