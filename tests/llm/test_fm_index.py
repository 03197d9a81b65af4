import hashlib
import re

import numpy as np
import pytest

from lintlake.llm import fm_index

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    phrases = {}
    for name, text in items:
        w = words(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(str(name))
    sizes = sorted({len(p) for p in phrases})
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                key = tuple(w[i : i + size])
                if key in phrases:
                    hit.update(range(i, i + size))
                    names |= phrases[key]
        out.append((doc_id, len(w), len(hit), len(names), sorted(names), bool(hit)))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, corpus):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [(*r[:4], hashlib.sha256(",".join(r[4]).encode()).hexdigest(), r[5]) for r in brute(corpus.items(), items)]
    assert rows(fm_index.query(spark, SF)) == sorted(want, key=str) and any(r[5] for r in want)


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_random_texts(spark, docs_of, block):
    rng = np.random.default_rng(7)
    text = lambda n: " ".join(f"W{x}" for x in rng.integers(0, 3, n))
    docs = [(i, text(rng.integers(0, 200))) for i in range(30)]
    items = [(i, text(n)) for i, n in enumerate([0, 1, 4, 5, 6, 7, 9, 12])] + [(3, docs[0][1][:60]), (77, "W9 W9")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = fm_index.find_leaks(docs_of(docs).select("doc_id", "text"), bench, 5, block)
    got = sorted((r[0], r[2], sum(b - a for a, b in zip(r[3], r[4], strict=True)), sorted(r[5])) for r in found.collect())
    assert got == [(r[0], r[1], r[2], r[4]) for r in brute(docs, items, 5)]


def test_edge_cases(spark, docs_of):
    phrase = " ".join(f"w{i}" for i in range(12))
    rows_ = [(1, None), (2, ""), (3, "... !!"), (4, phrase.upper()), (4, phrase.upper()), (None, "x, " + phrase), (5, "É0 é0"), (6, "w1 " * 400_000)]
    docs = docs_of(rows_, n_words="long", items="string", lo="int", hi="int")
    bench = spark.createDataFrame([(1, phrase), (1, phrase), (None, "x"), (2, None), (3, "--"), (4, "é0")], "item_id long, text string")
    items = [(1, phrase), (4, "é0")]
    want = brute(rows_, items)
    assert rows(fm_index.report(docs, bench)) == sorted(want, key=str)
    assert rows(fm_index.report(docs_of({}), bench)) == []
    assert {r.n_hit for r in fm_index.report(docs, bench.limit(0)).collect()} == {0}
    left = {r.doc_id: r.text for r in fm_index.decontaminate(docs, bench).collect()}
    assert 4 not in left and left[1] is None and left[2] == "" and left[3] == "... !!" and left[None] == "x, " and left[5] == "É0 "
    assert fm_index.decontaminate(docs, bench).columns == docs.columns


@pytest.mark.parametrize("block", [20, 1 << 20])
def test_blocks_and_cut_share_a_worker(spark, docs_of, block):
    from pyspark.sql.pandas.types import to_arrow_schema

    items = [(1, "a b c d e f g h i j"), (2, "k l m n o p"), (3, "q r")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of([(1, "x a b c d e f g h i j y k l m n o p"), (2, "q r"), (3, None), (4, "z q. r z")])
    for df in (fm_index.decontaminate(docs, bench), fm_index.find_leaks(docs, bench, 10, block), fm_index.find_leaks(docs, bench, 10, block, fm_index._cut(1, 5, to_arrow_schema(docs.schema)))):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert df.columns == docs.columns
    assert {r.doc_id: r.text for r in df.collect()} == {1: "x  y ", 3: None, 4: "z  z"}


def test_index_ranks_and_places():
    rng = np.random.default_rng(3)
    seq = np.append(rng.integers(1, 5, 700), 0)
    index = fm_index.FMIndex(seq, 5, 4)
    phrase = np.array([[1, 2], [3, 3], [4, 1]])
    lo, hi = index.search(phrase)
    for p, a, b in zip(phrase, lo, hi, strict=True):
        want = [i for i in range(700) if tuple(seq[i : i + 2]) == tuple(p)]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want
