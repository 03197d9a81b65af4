import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import line_dedup

SF = "/root/testdata/sf0.001"


def edits(a, b):
    """Edit distance of two lists of words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def brute(docs):
    seen, out = [], {}
    for doc_id, text in sorted(docs.items()):
        kept, lines = [], (text or "").split("\n")
        for line in lines:
            words = line.split()
            n = len(words)
            near = [w for w in seen if abs(len(w) - n) <= 1 and (w == words or n >= 8 and len(w) >= 8 and edits(w, words) <= 1)] if n >= 5 else []
            if not near:
                kept.append(line)
            if n >= 5:
                seen.append(words)
        out[doc_id] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def result(df):
    return {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in df.collect()}


def test_sql_equals_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = {r[0]: tuple(r[1:]) for r in con.execute(line_dedup.SQL).fetchall()}
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.query(spark, SF).collect()}
    assert got == want and sum(x[1] for x in got.values()) > 0


@pytest.mark.parametrize("seed", range(3))
def test_random_edits_equal_brute_force(docs_of, seed):
    rng = np.random.default_rng(seed)
    base = [[f"w{rng.integers(6)}" for _ in range(n)] for n in (4, 5, 7, 8, 9, 10, 15, 16, 17, 18, 31, 33)]
    docs = {}
    for k in range(40):
        lines = []
        for _ in range(rng.integers(1, 6)):
            words = list(base[rng.integers(len(base))])
            for _ in range(rng.integers(0, 3)):
                at = int(rng.integers(len(words) + 1))
                kind = rng.integers(3)
                if kind == 0:
                    words.insert(at, f"w{rng.integers(6)}")
                elif at < len(words) and kind == 1:
                    del words[at]
                elif at < len(words):
                    words[at] = f"n{rng.integers(3)}"
            lines.append("  ".join(words) if rng.integers(2) else " ".join(words) + "\t")
        docs[k] = "\n".join(lines)
    assert result(line_dedup.report(docs_of(docs))) == brute(docs)


def test_within_one_word(spark):
    rows = [("a b c", "a b c"), ("a b c", "a x c"), ("a b", "a b c"), ("a a", "a"), ("a b c", "c a b"), ("a", "b"), ("a b c d", "a b"), ("a b", "b a")]
    df = spark.createDataFrame(rows, "x string, y string")
    got = [r[0] for r in df.select(line_dedup.within_one_word(F.col("x"), F.col("y"))).collect()]
    assert got == [edits(x.split(), y.split()) <= 1 for x, y in rows]


def test_edge_cases(docs_of):
    line = "one two three four five six seven eight nine"
    rows = [(1, line + "\n\nshort\n" + line), (1, line + "\n\nshort\n" + line), (2, None), (3, ""), (4, line + "\nshort\n"), (5, line.replace("five", "5")), (None, "ten " + line)]
    docs = docs_of(rows, at="int", h="string", line="string")
    got = sorted((r.doc_id or 0, r.n_lines, r.n_removed, r.kept) for r in line_dedup.report(docs).collect())
    assert got == [(0, 1, 0, "ten " + line), (1, 4, 2, "\nshort"), (1, 4, 2, "\nshort"), (2, 1, 0, ""), (3, 1, 0, ""), (4, 3, 1, "short\n"), (5, 1, 1, "")]
    left = line_dedup.dedup_lines(docs_of([(1, line), (2, line), (3, line + "\nmore"), (4, None), (5, "x")], lines="int"))
    assert sorted((r.doc_id, r.text, r.n_chars, r.lang) for r in left.collect()) == [(1, line, len(line), "en"), (3, "more", 4, "en"), (4, None, 0, "en"), (5, "x", 1, "en")]
    assert left.columns == docs_of({}, lines="int").columns


def test_long_texts_and_many_lines(docs_of):
    long = " ".join(f"w{i}" for i in range(20_000))
    many = "\n".join(f"line {i % 700} of a page with words that stay {i % 700}" for i in range(3000))
    docs = {1: long, 2: long.replace("w777 ", ""), 3: many, 4: "x" * 1_000_000}
    got = result(line_dedup.report(docs_of(docs)))
    assert got[1][:2] == (1, 0) and got[2] == (1, 1, "") and got[4][:2] == (1, 0)
    want = hashlib.sha256("\n".join(many.split("\n")[:700]).encode()).hexdigest()
    assert hashlib.sha256(got[3][2].encode()).hexdigest() == want


def test_empty_table(docs_of):
    assert line_dedup.report(docs_of({})).collect() == []
    assert line_dedup.dedup_lines(docs_of({})).collect() == []
