import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import bloom_sketch

SF = "/root/testdata/sf0.001"


def units(text):
    return {line[i : i + 160] for line in text.split("\n") for i in range(0, len(line), 160)}


def likeness(a, b):
    a, b = units(a), units(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(docs):
    order = sorted(docs, reverse=True)
    out = {}
    for i, k in enumerate(order):
        text, following = docs[k], docs[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out[k] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(text, edited), 9), round(likeness(text, following), 9))
    return out


def result(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()}


def test_query_equals_brute_force(spark, corpus):
    rows = bloom_sketch.query(spark, SF).collect()
    want = brute(corpus)
    assert {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows} == want
    prints = {}
    for r in rows:
        prints.setdefault(corpus[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert np.mean([w[2] > w[3] for w in want.values()]) > 0.8


@pytest.mark.parametrize("slices", [1, 2, 5, 40])
def test_next_document_across_slices(docs_of, slices):
    from lintlake.llm.common import keyed

    rng = np.random.default_rng(slices)
    ids = sorted(rng.choice(10**9, 37, replace=False).tolist())
    docs = {i: f"t{i}" for i in ids}
    got = {r.id: r.next for r in bloom_sketch.with_next(keyed(docs_of(docs)), slices).collect()}
    assert got == {i: f"t{ids[k - 1]}" for k, i in enumerate(ids)}


def test_difference_is_recovered(spark):
    a, b = list(range(100, 400)), [*range(130, 400), *range(1000, 1040)]
    df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    size = F.lit(60)
    both = bloom_sketch.subtracted(bloom_sketch.sketch(F.col("a"), size), bloom_sketch.sketch(F.col("b"), size))
    found = df.select(bloom_sketch.peeled(both, size).alias("x")).first().x
    assert sorted((r["key"], r["count"]) for r in found) == sorted([(i, 1) for i in range(100, 130)] + [(i, -1) for i in range(1000, 1040)])
    small = bloom_sketch.subtracted(bloom_sketch.sketch(F.col("a"), F.lit(6)), bloom_sketch.sketch(F.col("b"), F.lit(6)))
    assert df.select(bloom_sketch.peeled(small, F.lit(6)).alias("x")).first().x is None


def test_edge_cases(docs_of):
    long = "\n".join(f"paragraph {i} é" for i in range(600))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "a\nb"), (4, "a\nb"), (5, "b\n\na"), (6, long), (7, long + "\nmore"), (None, "é" * 500)]
    got = {}
    for r in bloom_sketch.report(docs_of(rows, slice="int", id="string", next="string", ghost="int")).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].fingerprint == got[2][0].fingerprint == got[3][0].fingerprint == "0:"
    assert got[2][0].near_next == 1.0 and got[4][0].fingerprint == got[5][0].fingerprint and len(got[4]) == 2
    assert got[5][0].near_next == 1.0 and got[7][0].near_next == 600 / 601 and got[None][0].n_chars == 500
    alone = bloom_sketch.report(docs_of({9: "abcd"})).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone.near_next == 1.0
    assert bloom_sketch.report(docs_of({})).collect() == []
