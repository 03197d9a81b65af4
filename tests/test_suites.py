"""Nested suites of browser tests, and orders that must not depend on the order of rows."""

import json

from lintlake.operators.findings import assign_ids
from lintlake.schema import ACTIVITY
from lintlake.sources import reports as SR
from lintlake.sources import stores


def test(title, *statuses):
    return {"title": title, "results": [{"status": s} for s in statuses]}


test.__test__ = False


def read(files_of, **contents):
    files = files_of(*[(repo, {"test-results.json": text}) for repo, text in contents.items()])
    return sorted((r.repo, r.suite, r.title, tuple(r.statuses)) for r in SR.playwright_tests(files).collect())


def test_suites_of_any_depth(files_of):
    depth = 40
    suite = {"title": f"s{depth}", "tests": [test("last", "passed")]}
    for k in range(depth - 1, 0, -1):
        suite = {"title": f"s{k}", "tests": [test(f"t{k}", "failed", "passed")], "suites": [suite]}
    got = read(files_of, r=json.dumps({"suites": [suite, {"title": "other", "tests": [test("x")]}]}))
    path = lambda n: " > ".join(f"s{k}" for k in range(1, n + 1))
    want = [("r", path(k), f"t{k}", ("failed", "passed")) for k in range(1, depth)]
    assert got == sorted([*want, ("r", path(depth), "last", ("passed",)), ("r", "other", "x", ())])


def test_suites_without_lists_titles_or_tests(files_of):
    odd = {"suites": [{"tests": [test("a", "failed")]}, {"title": "[[", "suites": [{"title": "b"}, {"title": "c", "tests": [{"title": "d"}]}]}, "text", None]}
    got = read(files_of, none="{}", empty='{"suites": []}', word='{"suites": "no"}', broken='{"suites": [', odd=json.dumps(odd))
    assert got == [("odd", "[[ > c", "d", ()), ("odd", "undefined", "a", ("failed",))]


def test_suites_are_read_in_one_query(spark, files_of, monkeypatch):
    def refuse(*_):
        raise AssertionError("a table is written")

    monkeypatch.setattr("pyspark.sql.DataFrameWriter.parquet", refuse)
    files = files_of(("r", {"test-results.json": json.dumps({"suites": [{"title": "a", "tests": [test("t", "failed")]}]})}))
    assert [r.title for r in SR.playwright_failures(SR.playwright_tests(files)).select("title").collect()] == ["Failing browser test: t"]


def test_ids_follow_the_findings_not_their_order(spark):
    schema = "repo string, rule string, severity string, title string, evidence array<struct<file: string, line: int, snippet: string>>"
    rows = [("r", "x", s, t, [("a.ts", 3, n)]) for s in ("high", "low") for t in ("one", "two") for n in ("p", None)]
    ids = [{(f.severity, f.title, f.evidence[0].snippet): f.id for f in assign_ids(spark.createDataFrame(o, schema), "SEC").collect()} for o in (rows, rows[::-1], rows[3:] + rows[:3])]
    assert ids[0] == ids[1] == ids[2] and sorted(ids[0].values()) == [f"SEC-{k:03d}" for k in range(1, 9)]


def test_log_limit_is_stable(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("2024-01-01T00:00:00Z", agent, f"run {k}", [], [], "success", None) for agent in ("audit-tests", "audit-security") for k in range(3)]
    for row in rows:
        stores.append_activity(spark.createDataFrame([row], ACTIVITY), path)
    got = [(r.agent, tuple(r)[2]) for r in stores.read_activity(spark, path, limit=4).collect()]
    assert got == [("audit-security", f"run {k}") for k in range(3)] + [("audit-tests", "run 0")]
