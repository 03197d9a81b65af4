import hashlib

import numpy as np
import pytest

from lintlake.llm import induced_dedup

SF = "/root/testdata/sf0.001"


def brute(docs, window):
    places = {}
    for doc_id, text in docs.items():
        data = (text or "").encode()
        for i in range(len(data) - window + 1):
            places.setdefault(data[i : i + window], []).append((doc_id, i))
    gone = {k: np.zeros(len((t or "").encode()), bool) for k, t in docs.items()}
    for at in places.values():
        if len(at) > 1:
            for doc_id, i in at:
                gone[doc_id][i : i + window] = True
    out = {}
    for doc_id, text in docs.items():
        data, g = np.frombuffer((text or "").encode(), np.uint8), gone[doc_id]
        spans = int((g & ~np.concatenate([[False], g[:-1]])).sum()) if len(g) else 0
        out[doc_id] = (len(data), int(g.sum()), spans, bytes(data[~g]))
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()}


def test_query_equals_brute_force(spark, corpus):
    want = {k: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for k, v in brute(corpus, 400).items()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in induced_dedup.query(spark, SF).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0


@pytest.mark.parametrize("seed", range(3))
def test_shared_passages_at_any_place(docs_of, seed):
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(rng.choice(list("abé \n"), n))
    passages = [word(n) for n in (25, 39, 40, 41, 60, 130)]
    docs = {i: word(rng.integers(0, 80)) + passages[rng.integers(6)] + word(rng.integers(0, 50)) + passages[rng.integers(6)][3:] for i in range(40)}
    docs |= {100 + i: docs[i] for i in range(6)}
    docs |= {200 + i: docs[0][:50] + word(2) + docs[0][50:] for i in range(10)}
    got = result(induced_dedup.dedup_bytes(docs_of(docs), 40, 5, 9))
    assert got == brute(docs, 40) and any(v[1] for v in got.values())


def test_periodic_and_long_texts(docs_of):
    docs = {1: "ab" * 900, 2: "q" * 401, 3: "x" * 400, 4: "y" * 399, 5: "".join(chr(97 + i * i % 26) for i in range(2_500_000))}
    got = result(induced_dedup.dedup_bytes(docs_of(docs)))
    for k in (1, 2, 3, 4):
        assert got[k] == brute({k: docs[k]}, 400)[k]
    assert got[5][:3] == (2_500_000, 2_500_000, 1)


def test_edge_cases(docs_of):
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(list("abcdefgh "), 450))
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "zz" + text[:420] + "yy"), (None, "short"), (5, text[40:] + "k" * 30)]
    docs = docs_of(rows, id="int", tk="string", at="string", kept="int")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans) for r in induced_dedup.dedup_bytes(docs).collect())
    assert got == [(-1, 5, 0, 0), (1, 450, 450, 1), (1, 450, 450, 1), (2, 0, 0, 0), (3, 0, 0, 0), (4, 424, 420, 1), (5, 440, 410, 1)]
    alone = induced_dedup.dedup_bytes(docs_of([(1, text), (1, text)])).collect()
    assert [r.n_removed for r in alone] == [0, 0]


def test_empty_table(docs_of):
    assert induced_dedup.dedup_bytes(docs_of({})).collect() == []
