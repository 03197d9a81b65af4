import re

import numpy as np

from lintlake.llm import tensor_minhash
from lintlake.llm.components import components

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 0))} or ({tuple(words)} if words else set())


def brute(docs):
    sets = {k: shingles(t) for k, t in docs.items()}
    comp = {k: k for k in docs}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    owners = {}
    for k, s in sets.items():
        for x in s:
            owners.setdefault(x, []).append(k)
    seen = {(min(a, b), max(a, b)) for o in owners.values() for a in o for b in o if a != b}
    for a, b in seen:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return {k: (len(sets[k]), root(k), root(k) == k) for k in docs}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_query_equals_brute_force(spark, corpus):
    want = brute(corpus)
    assert result(tensor_minhash.query(spark, SF)) == want and not all(k for *_, k in want.values())


def test_chains_stars_and_boilerplate(docs_of):
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(10**6)}"
    docs = {}
    for g in range(4):  # chains: each text differs from the last one in a word or two, so the ends are far apart
        words = [word() for _ in range(120)]
        for k in range(14):
            docs[1000 * g + 7 * k + int(rng.integers(5))] = " ".join(words)
            for _ in range(2):
                words[int(rng.integers(120))] = word()
    common = [f"license{i}" for i in range(40)]
    for k in range(40):  # one passage in unlike texts
        own = [word() for _ in range(int(rng.integers(30, 90)))]
        docs[10_000 + k] = " ".join([*own[:20], *common, *own[20:]])
    docs |= {20_000: "A b C", 20_001: "a B c", 20_002: "a b", 20_003: None, 20_004: "  ", 20_005: None}
    assert result(tensor_minhash.report(docs_of(docs))) == brute(docs)


def test_pairs_at_the_bound(docs_of):
    base = [f"x{i}" for i in range(400)]
    docs = {}
    for k in range(30):  # 396 shingles; one edit loses five of them
        words = list(base)
        for j in range(k % 15):
            words[6 + 13 * ((k + 3 * j) % 29)] = f"y{k}_{j}"
        docs[k] = " ".join(words)
    assert result(tensor_minhash.report(docs_of(docs))) == brute(docs)


def near_group(docs, rng, n, edits):
    base = [f"x{i}" for i in range(150)]
    for k in range(n):  # up to `edits` words are replaced: some texts are linked with many others, some with none
        words = list(base)
        for j in rng.choice(150, int(rng.integers(0, edits)), replace=False):
            words[j] = f"y{rng.integers(6)}_{j}"
        docs[k] = " ".join(words)


def test_large_groups_in_blocks_equal_brute_force(docs_of, monkeypatch):
    docs, rng = {}, np.random.default_rng(8)
    near_group(docs, rng, 160, 12)
    want = brute(docs)
    for slice_, part, last in ((512, 8192, 200_000_000), (30, 40, 0)):  # one block; several, and rounds of first nodes
        for name, value in (("SLICE", slice_), ("PART", part), ("LAST_ROUND", last)):
            monkeypatch.setattr(tensor_minhash, name, value)
        assert result(tensor_minhash.report(docs_of(docs))) == want


def test_pairs_of_a_large_group_are_no_rows(docs_of, monkeypatch):
    docs, rng = {}, np.random.default_rng(8)
    near_group(docs, rng, 160, 14)
    rows = []
    verified = tensor_minhash._verified
    monkeypatch.setattr(tensor_minhash, "_verified", lambda pairs, bodies: (rows.append(pairs.count()), verified(pairs, bodies))[1])
    assert result(tensor_minhash.report(docs_of(docs))) == brute(docs)
    assert sum(rows[1:]) < 10 * 160, rows  # the first ones are stars


def test_edge_cases(docs_of):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (5, text), (None, text.upper()), (6, "one"), (7, "one"), (8, "zz " * 300_000), (9, "ZZ " * 200_000)]
    got = tensor_minhash.report(docs_of(rows, node="int", comp="string", id="int")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (5, -1, False), (5, -1, False), (6, 6, True), (7, 6, False), (8, 8, True), (9, 8, False)]
    kept = tensor_minhash.keep_first(docs_of([(5, text), (5, text), (4, "a b"), (3, None), (2, text + " end")], tk="int"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, text + " end"), (3, None), (4, "a b")] or sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert "tk" in kept.columns


def test_rows_of_one_id_with_several_texts(docs_of):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    got = tensor_minhash.report(docs_of([(1, a), (2, a), (2, b), (3, b), (4, "c d")])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_rows_without_an_id_or_with_a_repeated_one_lose_no_text(docs_of):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    # unlike texts without an id, near and exact copies of them, unlike texts under one id, texts without words
    rows = [(None, a), (None, b), (None, b), (None, b + " end"), (4, a + " end"), (5, c), (6, c + " end"), (7, d), (7, e), (8, d + " end"), (None, ""), (9, None), (9, "x y")]
    kept = tensor_minhash.keep_first(docs_of(rows)).collect()
    sets = [shingles(r.text) for r in kept]
    for text in {t for _, t in rows if t}:  # every text has itself or one near copy among the kept
        own = shingles(text)
        assert sum(own == s or 100 * len(own & s) >= 75 * len(own | s) for s in sets) == 1
    assert sorted((r.doc_id or 0, (r.text or "")[:1]) for r in kept) == [(0, ""), (0, "a"), (0, "b"), (5, "c"), (7, "d"), (7, "e"), (9, ""), (9, "x")]
    got = {(r.doc_id, r.component_id) for r in tensor_minhash.report(docs_of(rows)).collect()}
    assert got == {(None, None), (4, None), (5, 5), (6, 5), (7, 7), (8, 7), (9, 9)}


def test_empty_table(docs_of):
    assert tensor_minhash.report(docs_of({})).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (7, 7), (103, 100), (100, 105)]
    rng = np.random.default_rng(6)  # a path whose nodes are in no order, and a star whose centre is the greatest
    path = [int(i) for i in 200 + rng.permutation(300)]
    edges += [*zip(path[:-1], path[1:], strict=True), *((1000, 900 + i) for i in range(50))]
    want = {i: 0 for i in range(61)} | {100: 100, 103: 100, 105: 100} | {i: 200 for i in path} | {i: 900 for i in (*range(900, 950), 1000)}
    table = spark.createDataFrame(edges, "a long, b long")
    for one_task in (len(edges), 10, 0):  # in one task, and in rounds
        rows = components(table, one_task).collect()
        assert {r.node: r.comp for r in rows} == want and len(rows) == len(want)
    for one_task in (10, 0):
        assert components(spark.createDataFrame([], "a long, b long"), one_task).collect() == []


def test_clashing_columns_stay(spark, docs_of):
    docs = docs_of({1: "one two three four five six", 2: "one two three four five six", 3: "x"}, id="string", tk="int", at="long", row="string", _llm_id="string", node="int")
    kept = tensor_minhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
