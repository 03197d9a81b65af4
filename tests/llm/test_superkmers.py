import hashlib
import re

import numpy as np
import pytest

from lintlake.llm import superkmers

SF = "/root/testdata/sf0.001"


def brute(docs, window):
    out, seen = {}, set()
    for doc_id, text in sorted(docs.items()):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id] = (len(words), sum(gone), kept.decode())
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in df.collect()}


def test_query_equals_brute_force(spark, corpus):
    want = {k: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for k, (n, gone, kept) in brute(corpus, 20).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in superkmers.query(spark, SF).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0


@pytest.mark.parametrize("share", [1, 4, 1024])
def test_hot_minimisers_do_not_change_results(docs_of, monkeypatch, share):
    rng = np.random.default_rng(share)
    hot = " ".join(f"h{i}" for i in range(14))
    docs = {}
    for i in range(60):
        own = [f"w{rng.integers(40)}" for _ in range(rng.integers(0, 60))]
        at = rng.integers(len(own) + 1)
        docs[i] = " ".join([*own[:at], hot, *own[at:], *(["z"] * int(rng.integers(0, 30)))])
    docs |= {100 + i: docs[i % 7] for i in range(20)}
    plain = superkmers.heavy_minimisers
    monkeypatch.setattr(superkmers, "heavy_minimisers", lambda rows, w, s: plain(rows, w, s, share))
    assert result(superkmers.dedup_substrings(docs_of(docs), 8, 2)) == brute(docs, 8)


def test_hot_minimisers_are_found(docs_of):
    text = " ".join(f"w{i}" for i in range(400))
    rows = superkmers.keyed(docs_of({i: text for i in range(30)}))
    assert len(superkmers.heavy_minimisers(rows)) > 20
    assert len(superkmers.heavy_minimisers(rows, share=4)) == 0


def test_edge_cases(docs_of):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, " \n\t"), (5, f" é\n{text}\r\nx"), (None, text), (6, "short")]
    got = sorted(superkmers.dedup_substrings(docs_of(rows, id="int", tk="string", lo="string")).collect(), key=str)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept))
    assert by[None] == [(30, 0, text)] and by[1] == [(30, 30, "")] * 2
    assert by[2] == by[3] == by[4] == [(0, 0, "")] and by[6] == [(1, 0, "short")]
    assert by[5] == [(32, 30, " é x")]


def test_long_and_periodic_texts(docs_of):
    docs = {1: "a " * 5000, 2: "x" * 3_000_000, 3: " ".join(["a b"] * 40)}
    assert result(superkmers.dedup_substrings(docs_of(docs))) == brute(docs, 20)


def test_empty_table(docs_of):
    assert superkmers.dedup_substrings(docs_of({})).collect() == []
