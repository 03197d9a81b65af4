"""Names inside words, by the index of pieces, against a plain search."""

import random

from lintlake.operators import cross


def test_names_inside_words_equal_a_plain_search(spark):
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abA_1") for _ in range(n))
    long = some(700)
    words, names = [], []
    for repo in ("r", "s"):
        for k in range(120):
            words.append((repo, some(rng.randint(1, 12)) if k else long, f"p{rng.randint(0, 9)}", f"q{rng.randint(0, 9)}"))
        names += [(repo, some(n)) for n in range(1, 7) for _ in range(8)]
        names += [(repo, long[a : a + n]) for a, n in ((0, 300), (250, 10), (255, 2), (511, 4), (400, 300), (699, 1))]
    names += [("t", "a"), ("r", "absent"), ("r", "a")]
    got = cross.words_around(spark.createDataFrame(words, "repo string, word string, lo string, hi string"), spark.createDataFrame(names, "repo string, symbol string"))
    want = {}
    for repo, name in names:
        around = [(lo, hi) for of, word, lo, hi in words if of == repo and name in word]
        if around:
            want[repo, name] = (min(lo for lo, _ in around), max(hi for _, hi in around))
    assert {(r.repo, r.symbol): (r.lo, r.hi) for r in got.collect()} == want
    assert got.count() == len(want)


def test_nothing_to_look_for(spark):
    words = spark.createDataFrame([("r", "word", "a", "a")], "repo string, word string, lo string, hi string")
    assert cross.words_around(words, spark.createDataFrame([], "repo string, symbol string")).collect() == []


def test_texts_are_read_only_while_names_and_words_are_written(spark, files_of):
    files = files_of(("r", {"src/a.ts": "export const getUser = 1;\nexport const lonely = 2;", "src/b.ts": "getUserName()"}))
    dead = cross.dead_exports(files)
    assert "content" not in dead._jdf.queryExecution().optimizedPlan().toString()
    assert [r.evidence[0].snippet.split()[-1] for r in dead.collect()] == ["lonely"]
