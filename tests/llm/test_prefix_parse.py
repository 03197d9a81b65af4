"""Phrases by prefix-free parsing against plain counting; the registered query is held against its SQL too."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lintlake.llm import prefix_parse

SCHEMA = "doc_id long, text string, lang string"


def plain(docs, max_words=3, min_count=10, drop_percent=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        dropped = set()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if 100 * a >= drop_percent * found[p[i : i + size]]:
                        dropped.add(p[i : i + size])
        rows = []
        for p, a in found.items():
            if p not in dropped:
                score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(3)
    vocabulary = ["a", "B", "cc", "dé", "E5", "日本", "f-g", " ", "x\x1fy", "of", "the"]
    signs = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", " \x0b", ";", "\r\n"]
    out = []
    for i in range(300):
        words = rng.choice(vocabulary, rng.integers(0, 60), p=rng.dirichlet(np.ones(len(vocabulary))))
        out.append((i, "".join(w + signs[k] for w, k in zip(words, rng.integers(0, len(signs), len(words)), strict=True)), ["en", "de", None, "", "und"][i % 5]))
    out += out[:40] + [(None, None, "en"), (1, "", None), (2, " .,;\n", "de"), (3, "one", "fr"), (4, "the of " * 4000, "en"), (5, "zz " * 3000, "xx")]
    return out


@pytest.mark.parametrize(("max_words", "min_count", "drop"), [(3, 10, 50), (2, 3, 50), (5, 4, 70)])
def test_equals_plain_counting(spark, docs, max_words, min_count, drop):
    table = spark.createDataFrame(docs, SCHEMA).repartition(5)
    got = prefix_parse.collocations(table, max_words, min_count, drop, top=200)
    assert rows_of(got) == plain(docs, max_words, min_count, drop, top=200)


def test_whole_without_top(spark, docs):
    got = prefix_parse.collocations(spark.createDataFrame(docs, SCHEMA), top=None)
    assert rows_of(got) == plain(docs, top=10**9)


def test_chunks_share_their_overlap(docs):
    texts = [t or "" for _, t, _ in docs]
    body = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in body])]).astype(np.int64)
    flat, owner, lo, hi, final = prefix_parse.parse(np.frombuffer(b"".join(body), np.uint8), offsets, 2)
    chunks = [flat[a:b].tobytes().split() for a, b in zip(lo, hi, strict=True)]
    for i, words in enumerate(chunks):
        if not final[i]:
            assert owner[i + 1] == owner[i]
            assert words[-2:] == chunks[i + 1][:2]
    together = defaultdict(list)
    for o, words, end in zip(owner, chunks, final, strict=True):
        together[o] += words if end else words[:-2]
    for i, text in enumerate(texts):
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text)
        assert [w.decode() for w in together[i]] == re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", lowered)


def test_clashing_columns_and_empty_table(spark):
    rows = [(1, "new york city " * 12, "en", "x", 1, b"z")]
    table = spark.createDataFrame(rows, SCHEMA + ", phrase string, bucket int, packed binary")
    assert rows_of(prefix_parse.collocations(table)) == plain([r[:3] for r in rows])
    assert prefix_parse.collocations(table.limit(0)).collect() == []


def test_digest_planes_round_trip():
    digests = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (prefix_parse.unplaned(*prefix_parse.planes(digests)) == digests).all()
