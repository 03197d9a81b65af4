"""One-bit codes against plain inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import bit_codes

SF = "/root/testdata/sf0.001"

EVERY, K = bit_codes.EVERY, bit_codes.K


def plain(rows, k=K, every=EVERY):
    """``{query_id: [(vec_id, score), ...]}`` by looking at all pairs."""
    real = [(i, np.array(v, float)) for i, v in rows if v and None not in v and all(map(math.isfinite, v)) and any(v)]
    width = max((len(v) for _, v in real), default=0)
    real = [(i, np.pad(v, (0, width - len(v)))) for i, v in real]
    out = {}
    for i, q in real:
        if i is not None and i % every == 0:
            scores = [(-float((q * v).sum()), j) for j, v in real if j != i]
            out[i] = [(j, -s) for s, j in sorted(scores, key=lambda x: (x[0], -(2**63) if x[1] is None else x[1]))[:k]]
    return out


def found_in(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def same(got, want, least=0.99):
    assert set(got) == {q for q, rows in want.items() if rows}
    hits = total = 0
    for q, rows in want.items():
        assert [r[0] for r in got.get(q, [])] == list(range(1, len(rows) + 1))
        assert [(-s, i) for _, i, s in got.get(q, [])] == sorted((-s, i) for _, i, s in got.get(q, []))
        hits += len({i for _, i, _ in got.get(q, [])} & {i for i, _ in rows})
        total += len(rows)
    assert hits >= least * total


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got, want = found_in(bit_codes.query(spark, SF)), plain(rows)
    same(got, want)
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        for _, i, score in found:
            assert score == pytest.approx(float((vectors[q] * vectors[i]).sum()), abs=1e-14)


def test_shards_and_groups_of_near_and_equal_vectors(spark):
    rng = np.random.default_rng(5)
    spread = rng.normal(size=(1200, 24)) * rng.uniform(0.1, 3, (1200, 1))
    group = rng.normal(size=24) + rng.normal(size=(700, 24)) * 1e-3
    x = np.concatenate([spread, group, np.repeat(rng.normal(size=(1, 24)), 400, axis=0)])
    x = x[rng.permutation(len(x))]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = found_in(bit_codes.neighbours(table, F.col("id") % EVERY == 0, shard_rows=500))
    want = plain(rows)
    same(got, want)
    exact = sum([i for _, i, _ in got[q]] == [i for i, _ in want[q]] for q in want)
    assert exact >= 0.95 * len(want)


def test_bounds_hold_for_estimates():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 40))
    model = bit_codes.Model(bit_codes.centres(x, 8), bit_codes.rotation(256, 40))
    index = bit_codes.index_of(model, np.arange(3000), x)
    q = rng.normal(size=(50, 40))
    inside = total = 0
    for cell in range(len(model.centres)):
        at = slice(index.first[cell], index.first[cell + 1])
        found, bound = bit_codes.estimates(index, q, cell)
        error = np.abs(found - q @ index.vectors[at].T)
        inside, total = inside + int((error <= bound).sum()), total + error.size
    assert inside >= 0.99 * total


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
        (7, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [2.0, 0.0]), (9, [0.5]), (20, None), (40, [-1.0, 0.0]), (-20, [0.0, 3.0]),
    ]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, id string, tk int")
    got = found_in(bit_codes.neighbours(table, F.col("id") % EVERY == 0))
    unique = list({(i, tuple(v) if v is not None else None) for i, v in rows})
    assert {q: [(i, s) for _, i, s in f] for q, f in got.items()} == plain(unique)
    assert [i for _, i, _ in got[0]][:3] == [None, 7, 8]


def test_empty_and_lonely(spark):
    schema = "vec_id long, embedding array<float>"
    assert bit_codes.neighbours(spark.createDataFrame([], schema), F.col("id") % EVERY == 0).collect() == []
    assert bit_codes.neighbours(spark.createDataFrame([(0, [1.0])], schema), F.col("id") % EVERY == 0).collect() == []
