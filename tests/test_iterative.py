"""Operators that run in rounds, against plain Python on random input."""

import random

import pytest

from lintlake.operators import cross, evaluate, findings, imports
from lintlake.policy import Alias, Policy

RUN = ("f", "A", 1)
TRUTH_DDL = (
    "fixture string, ord bigint, id string, severity string, domain string, title string, file string, "
    "line int, tool_detectable boolean, root_cause string"
)
PRED_DDL = (
    "fixture string, tier string, run int, ord bigint, id string, domain string, rule string, title string, "
    "evidence array<struct<file:string,line:int>>"
)
TITLES = ["missing null check", "null check missing here", "slow query in loop", "loop with slow query", "ok"]


def words(t):
    return {w for w in "".join(ch if ch.isalnum() else " " for ch in t.lower()).split() if len(w) > 2}


def alike(a, b):
    a, b = words(a), words(b)
    return bool(a and b) and len(a & b) / len(a | b) >= 0.4


def greedy(truth, preds):
    used, out = set(), {}
    for t in truth:
        best = None
        for level in (1, 2, 3):
            for p in preds:
                if p["id"] in used:
                    continue
                if level == 1:
                    hit = any(f == t["file"] and l is not None and abs(l - t["line"]) <= 5 for f, l in p["evidence"])
                elif level == 2:
                    hit = p["domain"] == t["domain"] and any(f == t["file"] for f, _ in p["evidence"])
                else:
                    hit = p["domain"] == t["domain"] and alike(t["title"], p["title"])
                if hit:
                    best = p["id"]
                    break
            if best:
                break
        if best:
            used.add(best)
        out[t["id"]] = best
    return out


def random_case(rng, n_truth, n_pred, files, domains, spread):
    truth = [
        dict(id=f"G{i}", ord=i, file=f"a{rng.randrange(files)}", line=rng.randrange(1, spread), domain=f"d{rng.randrange(domains)}", title=rng.choice(TITLES))
        for i in range(n_truth)
    ]
    preds = [
        dict(
            id=f"P{i if rng.random() > 0.1 else max(i - 1, 0)}", ord=i, domain=f"d{rng.randrange(domains)}", rule=f"r{rng.randrange(3)}", title=rng.choice(TITLES),
            evidence=[(f"a{rng.randrange(files)}", rng.choice([None, rng.randrange(1, spread)])) for _ in range(rng.choice([1, 1, 1, 2, 3]))],
        )
        for i in range(n_pred)
    ]
    return truth, preds


def frames(spark, truth, preds):
    t = spark.createDataFrame(
        [(RUN[0], x["ord"], x["id"], "high", x["domain"], x["title"], x["file"], x["line"], True, None) for x in truth], TRUTH_DDL
    )
    p = spark.createDataFrame(
        [(*RUN, x["ord"], x["id"], x["domain"], x["rule"], x["title"], x["evidence"]) for x in preds], PRED_DDL
    )
    return t, p


@pytest.mark.parametrize(
    "seed,shape",
    [(2, (14, 10, 1, 1, 6)), (3, (20, 40, 2, 3, 12)), (4, (8, 8, 1, 2, 9))],
)
def test_matching_equals_greedy(spark, seed, shape):
    rng = random.Random(seed)
    truth, preds = random_case(rng, *shape)
    t, p = frames(spark, truth, preds)
    got = {r.truth_id: r.finding_id for r in evaluate.match_findings(t, p).collect()}
    assert got == greedy(truth, preds)


@pytest.mark.parametrize("block_rows", [0, 25])
def test_components_and_rounds_equal_greedy(spark, block_rows):
    """Runs larger than a block: components that fit are settled at once, the others in rounds."""
    rng = random.Random(9)
    truth, preds = random_case(rng, 24, 40, 9, 6, 8)
    t, p = frames(spark, truth, preds)
    got = {r.truth_id: r.finding_id for r in evaluate.match_findings(t, p, block_rows=block_rows).collect()}
    assert got == greedy(truth, preds)


def test_slices_do_not_follow_long_lists(spark):
    """Late rows whose list is long and gone but for its end: a few slices, not a round per entry."""
    truth = [dict(id=f"G{i}", ord=i, file=f"a{i}" if i < 30 else "none", line=1, domain="d", title="ok then" if i < 30 else TITLES[0]) for i in range(40)]
    preds = [dict(id=f"P{i}", ord=i, domain="d", rule="r", title=TITLES[0], evidence=[(f"a{i}", 1)]) for i in range(38)]
    t, p = frames(spark, truth, preds)
    sc = spark.sparkContext
    sc.setJobGroup("slices", "matching")
    try:
        got = {r.truth_id: r.finding_id for r in evaluate.match_findings(t, p, block_rows=32).collect()}
        jobs = len(sc.statusTracker().getJobIdsForGroup("slices"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == greedy(truth, preds)
    assert jobs < 250


def test_choices_out_of_reach_are_left_out(spark):
    """Two rows share a list of six: the second finding of no other list ends it, whatever comes between."""
    rows = spark.createDataFrame([("f", "A", 1, i, ["x", "y", "t"]) for i in (1, 2)] + [("f", "A", 1, 3, ["x", "z", "u"])], "fixture string, tier string, run int, t_ord bigint, keys array<string>")
    lists = [(3, "t", f"P{i}", i) for i in range(6)] + [(2, "z", "P1", 1), (2, "y", "P9", 9)]
    choices = spark.createDataFrame([("f", "A", 1, *x) for x in lists], "fixture string, tier string, run int, level int, key string, id string, ord bigint")
    got = {(r.key, r.id) for r in evaluate._within_reach(rows, choices).collect()}
    assert got == {("t", "P0"), ("t", "P1"), ("t", "P2"), ("z", "P1"), ("y", "P9")}


@pytest.mark.parametrize("seed", [4, 5])
def test_duplicate_pairs_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    _, preds = random_case(rng, 0, 60, 3, 2, 15)
    expected = 0
    for i, a in enumerate(preds):
        for b in preds[i + 1 :]:
            expected += any(
                fa == fb and ((la is not None and lb is not None and abs(la - lb) <= 3) or a["rule"] == b["rule"])
                for fa, la in a["evidence"]
                for fb, lb in b["evidence"]
            )
    _, p = frames(spark, [dict(id="x", ord=0, file="a", line=1, domain="d", title="t")], preds)
    assert evaluate.duplicate_pairs(p).collect()[0].duplicate_pairs == expected


def components(edges):
    nodes = sorted({n for e in edges for n in e})
    reach = {n: {d for s, d in edges if s == n} for n in nodes}
    for _ in nodes:
        for n in nodes:
            reach[n] |= {x for m in list(reach[n]) for x in reach[m]}
    return {
        frozenset(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]
    }


@pytest.mark.parametrize(
    "edges",
    [
        [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("x", "x"), ("y", "z")],
        [("a", "b"), ("b", "c"), ("c", "d")],
        sorted({(f"n{random.Random(7 * i).randrange(9)}", f"n{random.Random(11 * i + 1).randrange(9)}") for i in range(14)}),
    ],
)
@pytest.mark.parametrize("block", [imports.BLOCK_EDGES, 0])
def test_strong_components(spark, edges, block):
    df = spark.createDataFrame([("r", s, d) for s, d in edges], "repo string, src string, dst string")
    got = {}
    for r in imports.strong_components(df, block).collect():
        got.setdefault(r.scc, set()).add(r.node)
    assert {frozenset(v) for v in got.values()} == components(edges)
    assert all(scc == min(v) for scc, v in got.items())
    for r in imports.circular_dependencies(df).collect():
        places = [e.file for e in r.evidence]
        assert places[0] in got and len(places) <= 3


@pytest.mark.parametrize("block", [imports.BLOCK_EDGES, 0])
def test_shortest_cycle_is_shortest(spark, block):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "d"), ("d", "a"), ("k", "k"), ("p", "q"), ("q", "r"), ("r", "s"), ("s", "t"), ("t", "p"), ("r", "x"), ("x", "s")]
    df = spark.createDataFrame([("r", s, d) for s, d in edges], "repo string, src string, dst string")
    cycles = imports.shortest_cycles(df, imports.strong_components(df), block).collect()
    assert {r.scc: (list(r.cycle), r.length) for r in cycles} == {"a": (["a", "b"], 2), "k": (["k"], 1), "p": (["p", "q", "r"], 5)}


def test_long_chain_and_ring_in_few_rounds(spark, monkeypatch):
    """A repository too large for one task: rounds grow with the logarithm of its longest path."""
    n, rounds = 10_000, []
    plain = imports.cut_lineage
    monkeypatch.setattr(imports, "cut_lineage", lambda df: rounds.append(1) or plain(df))
    node = "concat('{0}', lpad(cast({1} as string), 6, '0'))"
    chain = spark.range(n).selectExpr("'r' AS repo", f"{node.format('c', 'id')} AS src", f"{node.format('c', 'id + 1')} AS dst")
    ring = spark.range(n).selectExpr("'r' AS repo", f"{node.format('o', 'id')} AS src", f"{node.format('o', f'(id + 1) % {n}')} AS dst")
    edges = chain.unionByName(ring)
    found = plain(imports.strong_components(edges, 0))
    assert found.count() == n
    assert found.selectExpr("min(scc)", "max(scc)", "min(node)", "max(node)").collect()[0][:] == ("o000000", "o000000", "o000000", f"o{n - 1:06}")
    cycle = imports.shortest_cycles(edges, found, 0).collect()
    assert [(list(r.cycle), r.length) for r in cycle] == [(["o000000", "o000001", "o000002"], n)]
    assert len(rounds) < 80  # tables written by both, two or three a round


def test_dead_exports_equal_substring_search(spark, files_of):
    rng = random.Random(3)
    names = ["get", "getUser", "User", "save_all", "x1", "handler", "render"]
    texts = {
        f"src/m{i}.ts": f"export const {rng.choice(names)} = 1;\nexport {{ {rng.choice(names)}, {rng.choice(names)} as {rng.choice(names)} }};\n"
        + "\n".join(rng.choice(["getUserName()", "saving", "renders(x1)", "a" * 600 + "User" + "b" * 300, "done"]) for _ in range(3))
        for i in range(6)
    }
    files = files_of(("r", texts))
    got = {(r.evidence[0].file, r.evidence[0].snippet.split()[-1]) for r in cross.dead_exports(files).collect()}
    symbols = {(r.path, r.symbol) for r in cross.exports(files).collect()}
    expected = {
        (path, s)
        for path, s in symbols
        if s not in ("default", "main", "handler") and not any(s in text for other, text in texts.items() if other != path)
    }
    assert got == expected


def test_dedup_with_aliases_that_do_not_contain_their_canonical_rule(spark):
    rows = [
        ("r", 1, "low", "conventions", "canon", 0.5),
        ("r", 2, "low", "security", "other", 0.9),
        ("r", 3, "low", "tests", "canon", 0.7),
    ]
    df = spark.createDataFrame(rows, "repo string, seq bigint, severity string, domain string, rule string, confidence double")
    df = df.selectExpr("*", "array(named_struct('file', 'a', 'line', 1, 'snippet', cast(null as string))) AS evidence")
    policy = Policy(aliases=(Alias(("other",), "canon", "security"),))
    # The first row of the key is not an alias, so no domain is preferred.
    assert [r.seq for r in findings.deduplicate(df, policy).collect()] == [2]
    swapped = df.withColumn("seq", -df.seq).withColumn("confidence", 1 - df.confidence)
    preferred = findings.deduplicate(swapped.where("rule <> 'canon' or seq > -3"), policy).collect()
    assert [r.seq for r in preferred] == [-2]
