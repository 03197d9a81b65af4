"""Digest trees of two snapshots against a plain comparison."""

from collections import defaultdict

from lintlake.operators.changes import changed_files, changed_folders, changed_paths, digest_tree, file_digests

BEFORE = {"a.ts": "1", "src/a.ts": "1", "src/b.ts": "2", "src/deep/er/c.ts": "3", "lib/x.ts": "9", "gone/y.ts": "7"}
AFTER = {"a.ts": "1", "src/a.ts": "1", "src/b.ts": "changed", "src/deep/er/c.ts": "3", "lib/x.ts": "9", "new/z/y.ts": "7", "src/deep/d.ts": ""}


def plain(before, after):
    kinds = {p: "removed" for p in before.keys() - after.keys()} | {p: "added" for p in after.keys() - before.keys()}
    return kinds | {p: "changed" for p in before.keys() & after.keys() if before[p] != after[p]}


def paths(before, after):
    rows = changed_paths(file_digests(before), file_digests(after)).collect()
    out = {(r.repo, r.path): r.change for r in rows}
    assert len(out) == len(rows)
    return out


def test_paths_equal_plain_comparison(files_of):
    got = paths(files_of(one=BEFORE, two=AFTER, same=BEFORE), files_of(one=AFTER, two=BEFORE, same=BEFORE))
    want = {("one", p): k for p, k in plain(BEFORE, AFTER).items()} | {("two", p): k for p, k in plain(AFTER, BEFORE).items()}
    assert got == want


def test_folders_hold_all_below_them(files_of):
    trees = [digest_tree(file_digests(files_of(one=s, same=BEFORE))) for s in (BEFORE, AFTER)]
    got = {r.folder: (r.change, r.files_before, r.files_after) for r in changed_folders(*trees).collect() if r.repo == "one"}
    counts = []
    for side in (BEFORE, AFTER):
        n = defaultdict(int)
        for path in side:
            parts = path.split("/")[:-1]
            for k in range(len(parts) + 1):
                n["/".join(parts[:k])] += 1
        counts.append(n)
    assert got == {
        "": ("changed", 6, 7), "src": ("changed", 3, 4), "src/deep": ("changed", 1, 2), "gone": ("removed", 1, 0),
        "new": ("added", 0, 1), "new/z": ("added", 0, 1),
    }
    assert all(counts[0][f] == b and counts[1][f] == a for f, (_, b, a) in got.items())
    assert {r.repo for r in changed_folders(*trees).collect()} == {"one"}


def test_only_new_and_edited_files_are_looked_at(files_of):
    got = changed_files(files_of(one=BEFORE), files_of(one=AFTER)).collect()
    assert {(r.path, r.content) for r in got} == {("src/b.ts", "changed"), ("new/z/y.ts", "7"), ("src/deep/d.ts", "")}


def test_null_empty_and_repeated_contents(spark, files_of):
    ddl = "repo string, path string, ext string, content string"
    before = spark.createDataFrame([("r", "n", "", None), ("r", "e", "", ""), ("r", "t", "", "1"), ("r", "t", "", "2")], ddl)
    after = spark.createDataFrame([("r", "n", "", ""), ("r", "e", "", ""), ("r", "t", "", "2"), ("r", "t", "", "1")], ddl)
    assert paths(before, after) == {("r", "n"): "changed"}  # contents of a repeated path are a set without order
    assert paths(before, after.where("content = '' or content = '2'")) == {("r", "n"): "changed", ("r", "t"): "changed"}
    assert paths(before, before) == {}


def test_empty_snapshots(files_of):
    none = files_of(one=BEFORE).where("false")
    assert set(paths(none, files_of(one=BEFORE)).values()) == {"added"}
    assert set(paths(files_of(one=BEFORE), none).values()) == {"removed"}
    assert paths(none, none) == {}
    assert changed_files(files_of(one=BEFORE), none).count() == 0
