"""Spelling variants against plain edit distances; the registered query is held against its SQL too."""

import random
import re
import zlib
from collections import Counter

import pytest

from lintlake.llm import position_index

SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(docs, slip=97, min_count=3):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slip == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= min_count}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    base = ["".join(rng.choice("abcéÿz×") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    words = list(base)
    for w in base:
        for _ in range(4):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcéÿz") + w[i:], w[:i] + rng.choice("abcéÿz") + w[i + 1 :]]))
    weights = [1 / (1 + rng.random() * 40) for _ in words]
    docs = [(i, " ".join(rng.choices(words, weights, k=60))) for i in range(200)]
    docs += [(None, "Abcdef abcdef ABCDEF abcdeg"), (1, None), (2, ""), (3, "ÀÉÎÕÜ àéîõü ÀÉÎÕÜ ÀÉÎÕÜ"), (4, "日本語" * 9), (5, ("q" * 3000 + " ") * 3 + ("q" * 3001 + " ") * 7)]
    return docs + docs[:30]


@pytest.mark.parametrize("block", [position_index.BLOCK, 16])
def test_equals_plain_distances(spark, docs, block):
    table = spark.createDataFrame(docs, SCHEMA).repartition(4)
    for slip, min_count in ((97, 3), (5, 2)):
        assert rows_of(position_index.variants(table, slip=slip, min_count=min_count, block=block)) == plain(docs, slip, min_count)


def test_one_edit_finds_all_pairs():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(400)})
    queries = words[::2] + ["", "abcx", "xyz"]
    got = sorted(zip(*(x.tolist() for x in position_index.one_edit(words, queries)), strict=True))
    assert got == [(i, j) for i, q in enumerate(queries) for j, w in enumerate(words) if q and one_edit(q, w)]


def test_long_chains_reach_their_root(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(29)], "word string, form string")
    got = position_index.roots(forms, 3 * 2**29).collect()
    assert {r.root for r in got} == {"w29"}


def test_clashing_columns_and_empty_table(spark):
    table = spark.createDataFrame([(7, "hello hello hello hallo hello hello hallo hallo", 1, "x", 2)], SCHEMA + ", n int, word string, key int")
    assert rows_of(position_index.variants(table)) == plain([(7, "hello hello hello hallo hello hello hallo hallo")])
    assert position_index.variants(table.limit(0)).collect() == []
