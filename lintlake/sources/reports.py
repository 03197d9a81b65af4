"""Reports of external checkers as findings.

Input is a table of files ``(repo, path, content)``; a report is one row, so parsing
and exploding it needs no shuffle. Where several paths may hold a report, the first
that exists and parses is taken per repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.catalog import EXTERNAL, RULES
from lintlake.functions.scalars import NPM_SEVERITY, SEMGREP_SEVERITY, format_bytes, lookup, snippet
from lintlake.functions.text import found
from lintlake.operators.detect import c, emit, finding, graded, one, text
from lintlake.policy import DEFAULT_POLICY, Policy

# --- Fixed values: report places, schemas, limits ---------------------------------------
NPM_AUDIT, SEMGREP = ["npm-audit.json"], ["semgrep.json"]
ESLINT = ["eslint-report.json", ".eslint-report.json", "reports/eslint.json"]
CHECKSTYLE = ["target/checkstyle-result.xml", "build/reports/checkstyle/main.xml", "checkstyle-result.xml"]
COVERAGE = ["coverage/coverage-summary.json", "coverage/coverage-final.json"]
JUNIT = ["test-results/junit.xml"]
PLAYWRIGHT = ["playwright-report/results.json", "test-results/results.json", "test-results.json"]
BUNDLE = ["dist/stats.json", "bundle-stats.json"]
BUILD_METRICS = ["build-metrics.json", "build-timings.json"]
LOCK_FILE = "package-lock.json"

NPM_DDL = "vulnerabilities MAP<STRING, STRUCT<severity: STRING>>"
SEMGREP_DDL = (
    "results ARRAY<STRUCT<check_id: STRING, path: STRING, start: STRUCT<line: INT>, "
    "extra: STRUCT<severity: STRING, message: STRING, lines: STRING>>>"
)
ESLINT_DDL = (
    "ARRAY<STRUCT<filePath: STRING, messages: ARRAY<STRUCT<ruleId: STRING, severity: INT, "
    "message: STRING, line: INT, source: STRING>>>>"
)
CHECKSTYLE_DDL = (
    "file ARRAY<STRUCT<_name: STRING, error: ARRAY<STRUCT<_line: INT, _severity: STRING, "
    "_message: STRING, _source: STRING>>>>"
)
COVERAGE_DDL = "total STRUCT<lines: STRUCT<pct: DOUBLE>, branches: STRUCT<pct: DOUBLE>, functions: STRUCT<pct: DOUBLE>>"
_PROBLEM = "ARRAY<STRUCT<_message: STRING, _type: STRING, _VALUE: STRING>>"
_CASES = f"ARRAY<STRUCT<_name: STRING, failure: {_PROBLEM}, error: {_PROBLEM}>>"
JUNIT_DDL = f"testsuite ARRAY<STRUCT<testcase: {_CASES}>>, testcase {_CASES}"
BUNDLE_DDL = "assets ARRAY<STRUCT<name: STRING, size: DOUBLE>>"
BUILD_DDL = "average_build_ms DOUBLE, p95_build_ms DOUBLE"

JUNIT_RERUN = (
    r"<testcase\s[^>]*?\bname=\"([^\"]*)\"[^>]*>[\s\S]*?<(?:rerunFailure|flakyFailure)[^/][\s\S]*?</testcase>"
)
PLAYWRIGHT_FLAKY_CONFIDENCE = 0.85
COVERAGE_GAP = 20
LARGE_ASSET, HUGE_ASSET = 500 * 1024, 1000 * 1024
SLOW_BUILD_MS, VERY_SLOW_BUILD_MS, SLOW_TAIL_MS = 120_000, 300_000, 180_000
EXCERPT = 80
# ------------------------------------------------------------------------------------------


def first_of(reports: DataFrame, places: list[str]) -> DataFrame:
    """Per repository, the row of the first of ``places`` that is left."""
    if len(places) == 1:
        return reports
    order = lookup(c.path, {p: i for i, p in enumerate(places)})
    columns = [n for n in reports.columns if n != "repo"]
    return reports.groupBy("repo").agg(F.min_by(F.struct(*columns), order).alias("r")).select("repo", "r.*")


def json_report(files: DataFrame, places: list[str], ddl: str) -> DataFrame:
    """``(repo, path, r)``: the first report of each repository that parses, parsed once."""
    is_list = ddl.startswith("ARRAY")
    parsed = F.from_json("content", ddl if is_list else f"{ddl}, _corrupt_record STRING")
    reports = files.where(c.path.isin(places)).select("repo", "path", parsed.alias("r"))
    valid = c.r.isNotNull() if is_list else c.r["_corrupt_record"].isNull()
    return first_of(reports.where(valid), places)


def text_report(files: DataFrame, places: list[str]) -> DataFrame:
    return first_of(files.where(c.path.isin(places)).select("repo", "path", "content"), places)


def below(path: Column, root: str | None) -> Column:
    """Path relative to the checked-out folder, when that is known."""
    return path if not root else F.regexp_replace(path, "^" + root.rstrip("/").replace(".", r"\.") + "/", "")


# -- dependency and code checkers --------------------------------------------------------------


def npm_audit(files: DataFrame) -> DataFrame:
    r = json_report(files, NPM_AUDIT, NPM_DDL).select("repo", c.r["vulnerabilities"].alias("v"))
    rows = r.select("repo", F.explode("v").alias("package", "v"))
    severity = F.coalesce(lookup(c.v["severity"], NPM_SEVERITY), F.lit("medium"))
    return emit(
        rows,
        finding("no-vulnerable-dependency", severity, text("Vulnerable dependency: ", c.package), one(F.lit(LOCK_FILE))),
    )


def semgrep(files: DataFrame) -> DataFrame:
    r = json_report(files, SEMGREP, SEMGREP_DDL).select("repo", F.explode(c.r["results"]).alias("r"))
    check = c.r["check_id"]
    return emit(
        r,
        finding(
            F.concat(F.lit("semgrep/"), check),
            lookup(F.upper(c.r["extra"]["severity"]), SEMGREP_SEVERITY, "low"),
            text("Semgrep: ", F.substring_index(check, ".", -2)),
            one(c.r["path"], c.r["start"]["line"], snippet(c.r["extra"]["lines"])),
            EXTERNAL["semgrep"],
        ),
    )


def eslint(files: DataFrame, root: str | None = None) -> DataFrame:
    r = json_report(files, ESLINT, ESLINT_DDL).select("repo", F.explode("r").alias("f"))
    m = r.select("repo", c.f["filePath"].alias("file"), F.explode(c.f["messages"]).alias("m")).where(
        F.length(c.m["ruleId"]) > 0
    )
    rule = c.m["ruleId"]
    return emit(
        m,
        finding(
            F.concat(F.lit("eslint/"), rule),
            F.when(c.m["severity"] == 2, F.lit("medium")).otherwise(F.lit("low")),
            text("ESLint [", rule, "]: ", F.substring(c.m["message"], 1, EXCERPT)),
            one(below(c.file, root), c.m["line"], snippet(c.m["source"])),
            EXTERNAL["eslint"],
        ),
    )


def checkstyle(files: DataFrame, root: str | None = None) -> DataFrame:
    r = text_report(files, CHECKSTYLE).select(
        "repo", F.explode(F.from_xml("content", CHECKSTYLE_DDL)["file"]).alias("f")
    )
    e = r.select("repo", c.f["_name"].alias("file"), F.explode(c.f["error"]).alias("e")).where(
        c.e["_line"].isNotNull()
        & (F.length(c.e["_severity"]) > 0)
        & (F.length(c.e["_message"]) > 0)
        & (F.length(c.e["_source"]) > 0)
    )
    rule = F.substring_index(c.e["_source"], ".", -1)
    return emit(
        e,
        finding(
            F.concat(F.lit("checkstyle/"), rule),
            F.when(c.e["_severity"] == "error", F.lit("medium")).otherwise(F.lit("low")),
            text("Checkstyle [", rule, "]: ", F.substring(c.e["_message"], 1, EXCERPT)),
            one(below(c.file, root), c.e["_line"]),
            EXTERNAL["checkstyle"],
        ),
    )


# -- tests ------------------------------------------------------------------------------------------


def coverage(files: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    r = json_report(files, COVERAGE, COVERAGE_DDL).select("repo", "path", c.r["total"].alias("t"))

    def metric(name: str) -> Column:
        actual, target = c.t[name]["pct"], F.lit(float(policy.coverage_targets[name]))
        return F.when(
            actual < target,
            finding(
                f"low-{name}-coverage",
                F.when(actual < target - COVERAGE_GAP, F.lit("high")).otherwise(F.lit("medium")),
                text(f"{name} coverage below target: ", F.format_string("%.1f", actual), "%"),
                one(c.path),
            ),
        )

    return emit(r, *[metric(m) for m in ("lines", "branches", "functions")])


def junit_failures(files: DataFrame) -> DataFrame:
    """Failing cases; the root may be ``testsuites`` or a single ``testsuite``."""
    x = F.from_xml("content", JUNIT_DDL)
    cases = F.when(
        c.x["testsuite"].isNotNull(),
        F.flatten(F.transform(c.x["testsuite"], lambda s: F.coalesce(s["testcase"], F.array().cast(_CASES)))),
    ).otherwise(F.coalesce(c.x["testcase"], F.array().cast(_CASES)))

    def has(problem: Column) -> Column:
        return F.coalesce(
            F.exists(
                problem,
                lambda p: p["_message"].isNotNull() | p["_type"].isNotNull() | (F.coalesce(F.length(p["_VALUE"]), F.lit(0)) > 0),
            ),
            F.lit(False),
        )

    r = text_report(files, JUNIT).select("repo", "path", x.alias("x"))
    t = r.select("repo", "path", F.explode(cases).alias("t")).where(has(c.t["failure"]) | has(c.t["error"]))
    return emit(
        t,
        finding(
            "no-failing-test", "high", text("Failing test: ", F.coalesce(c.t["_name"], F.lit("(unknown test)"))), one(c.path)
        ),
    )


_SUITE = "struct<suite: string, s: variant>"


def _variants(value: Column, key: str) -> Column:
    """The list under ``key``, empty where there is none."""
    return F.coalesce(F.try_variant_get(value, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))


def _suites(value: Column, parent: Column | None = None) -> Column:
    """The suites right below ``value``, named with their parents."""

    def named(s: Column) -> Column:
        title = F.coalesce(F.try_variant_get(s, "$.title", "string"), F.lit("undefined"))
        suite = title if parent is None else F.concat(parent, F.lit(" > "), title)
        return F.struct(suite.alias("suite"), s.alias("s"))

    return F.transform(_variants(value, "suites"), named)


def _all_suites(report: Column, content: Column) -> Column:
    """Suites of every level of a report, level by level.

    A level lies in a list of its own, so the opening brackets of the text bound the number of levels; steps behind
    the last level leave the state as it is.
    """
    none = F.array().cast(f"array<{_SUITE}>")
    brackets = F.length(content) - F.length(F.replace(content, F.lit("["), F.lit("")))
    deeper = F.aggregate(
        F.array_repeat(F.lit(True), brackets),
        F.struct(none.alias("above"), _suites(report).alias("level")),
        lambda state, _: F.when(F.size(state["level"]) == 0, state).otherwise(
            F.struct(
                F.concat(state["above"], state["level"]).alias("above"),
                F.flatten(F.transform(state["level"], lambda x: _suites(x["s"], x["suite"]))).alias("level"),
            )
        ),
    )
    return deeper["above"]


def playwright_tests(files: DataFrame) -> DataFrame:
    """All tests ``(repo, path, suite, title, statuses)``; suites nest to any depth.

    The levels of a report are folded inside its row, so one query reads all of them.
    """
    parsed = files.where(c.path.isin(PLAYWRIGHT)).select("repo", "path", "content")
    parsed = parsed.where(F.try_parse_json("content").isNotNull())
    reports = first_of(parsed, PLAYWRIGHT).select("repo", "path", "content", F.parse_json("content").alias("v"))
    every = reports.select("repo", "path", F.inline(_all_suites(c.v, c.content)))
    tests = every.select("repo", "path", "suite", F.explode(_variants(c.s, "tests")).alias("t"))
    return tests.select(
        "repo",
        "path",
        "suite",
        F.try_variant_get(c.t, "$.title", "string").alias("title"),
        F.transform(_variants(c.t, "results"), lambda r: F.try_variant_get(r, "$.status", "string")).alias("statuses"),
    )


def _failed(status: Column) -> Column:
    return F.coalesce(status.isin("failed", "timedOut"), F.lit(False))


def playwright_failures(tests: DataFrame) -> DataFrame:
    last = F.try_element_at("statuses", F.lit(-1))
    return emit(
        tests.where(_failed(last)),
        finding(
            "playwright-test-failure", "high", text("Failing browser test: ", c.title),
            one(c.path, None, F.concat(F.lit("Suite: "), c.suite)),
        ),
    )


def flaky_junit(files: DataFrame) -> DataFrame:
    r = text_report(files, JUNIT).select("repo", "path", F.explode(found(c.content, JUNIT_RERUN, 1)).alias("name"))
    return emit(r, finding("flaky-test", "medium", text("Flaky test: ", c.name), one(c.path)))


def flaky_playwright(tests: DataFrame) -> DataFrame:
    passed_at_last = (F.size("statuses") > 1) & (F.try_element_at("statuses", F.lit(-1)) == "passed")
    return emit(
        tests.where(F.exists("statuses", _failed) & passed_at_last),
        finding(
            "flaky-test", "medium", text("Flaky browser test: ", c.title),
            one(c.path, None, F.concat(F.lit("Suite: "), c.suite)),
            (RULES["flaky-test"][0], PLAYWRIGHT_FLAKY_CONFIDENCE),
        ),
    )


# -- performance ----------------------------------------------------------------------------------------


def bundle_stats(files: DataFrame) -> DataFrame:
    r = json_report(files, BUNDLE, BUNDLE_DDL).select("repo", "path", F.explode(c.r["assets"]).alias("a"))
    size, name = c.a["size"], c.a["name"]
    return emit(
        r.where((F.length(name) > 0) & (size > LARGE_ASSET)),
        finding(
            "bundle-size-threshold", graded(size, {"high": HUGE_ASSET}, "medium"),
            text("Large asset: ", name, " (", format_bytes(size), ")"),
            one(c.path, None, text(name, ": ", size.cast("bigint"))),
        ),
    )


def repos_with_bundle_stats(files: DataFrame) -> DataFrame:
    return json_report(files, BUNDLE, BUNDLE_DDL).select("repo").distinct()


def build_metrics(files: DataFrame, places=tuple(BUILD_METRICS)) -> DataFrame:
    r = json_report(files, list(places), BUILD_DDL).select("repo", "path", "r.*")
    average, tail = F.coalesce("average_build_ms", F.lit(0.0)), F.coalesce("p95_build_ms", F.lit(0.0))

    def seconds(ms: Column) -> Column:
        return F.format_string("%.1fs", ms / 1000)

    return emit(
        r,
        F.when(
            average > SLOW_BUILD_MS,
            finding(
                "build-time-average", graded(average, {"high": VERY_SLOW_BUILD_MS}, "medium"),
                text("Slow build: ", seconds(average)), one(c.path, None, text("average_build_ms=", average.cast("bigint"))),
            ),
        ),
        F.when(
            tail > SLOW_TAIL_MS,
            finding(
                "build-time-p95", "medium", text("Slow build tail: ", seconds(tail)),
                one(c.path, None, text("p95_build_ms=", tail.cast("bigint"))),
            ),
        ),
    )


