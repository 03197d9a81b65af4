"""Stored tables, policies, SARIF documents, file reading and streaming."""

import json

import pytest

from lintlake.operators import report
from lintlake.operators.cross import missing_tests
from lintlake.operators.findings import validate_findings
from lintlake.policy import DEFAULT_POLICY, load_policy, policy_from_dict
from lintlake.schema import ACTIVITY, FINDINGS
from lintlake.sources import files as SF
from lintlake.sources import stores
from lintlake.streaming.detect import detect_stream

E1 = [("a.ts", 3, None), ("b.ts", None, "x")]


def finding(seq, rule="r1", title="t", repo="r", **over):
    row = dict(
        repo=repo, seq=seq, id=f"SEC-{seq:03d}", severity="high", title=title, description=None, domain="security", rule=rule,
        confidence=0.5, evidence=E1, recommendation=None, effort=None, tags=[], source="tool",
    )
    return tuple({**row, **over}[n] for n in FINDINGS.fieldNames())


def test_sarif_documents_are_valid_and_bounded(spark):
    df = spark.createDataFrame([finding(i, rule=f"r{i % 3}", title=f"t{i}") for i in range(1, 12)], FINDINGS)
    rows = report.sarif_documents(df, "tool", "1.0", results_per_document=4).orderBy("part").collect()
    logs = [json.loads(r.document) for r in rows]
    assert [len(x["runs"][0]["results"]) for x in logs] == [4, 4, 3]
    first = logs[0]["runs"][0]
    assert first["results"][0]["ruleId"] == "r1" and first["results"][0]["level"] == "error"
    assert [d["id"] for d in first["tool"]["driver"]["rules"]] == ["r1", "r2", "r0"]
    locations = first["results"][0]["locations"]
    assert locations[0]["physicalLocation"]["region"]["startLine"] == 3
    assert "region" not in locations[1]["physicalLocation"]


def test_validation_reasons(spark):
    rows = [finding(1), finding(2, id="sec-1"), finding(3, severity="fatal", confidence=2.0), finding(4, evidence=[]), finding(5, effort="huge", evidence=[("", 0, None)])]
    good, bad = validate_findings(spark.createDataFrame(rows, FINDINGS))
    assert [r.seq for r in good.collect()] == [1]
    assert {r.seq: set(r.reasons) for r in bad.collect()} == {2: {"id"}, 3: {"severity", "confidence"}, 4: {"evidence"}, 5: {"effort", "evidence_item"}}


def test_activity_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(f"2024-01-0{i}T00:00:00Z", "audit-tests" if i % 2 else "audit-security", "run", ["x"], [], "success", None) for i in range(1, 6)]
    stores.append_activity(spark.createDataFrame(rows[:3], ACTIVITY), path)
    stores.append_activity(spark.createDataFrame(rows[3:], ACTIVITY), path)
    assert [r.timestamp[9] for r in stores.read_activity(spark, path, limit=2).collect()] == ["5", "4"]
    assert [r.timestamp[9] for r in stores.read_activity(spark, path, "audit-security").collect()] == ["4", "2"]
    with pytest.raises(ValueError):
        stores.append_activity(spark.createDataFrame([("t", "someone", "run", [], [], "success", None)], ACTIVITY), path)


def test_report_history(spark, tmp_path):
    path = str(tmp_path / "reports")
    df = spark.createDataFrame([("a", 90, "2024-01-01"), ("b", 70, "2024-01-01"), ("a", 80, "2024-02-01")], "repo string, overall_score int, run_date string")
    stores.write_reports(df, path)
    assert stores.read_reports(spark, path, repo="a", since="2024-01-15").count() == 1
    stores.write_json_reports(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_policy_overrides(spark, tmp_path):
    p = tmp_path / "policy.json"
    p.write_text(json.dumps({"minimum_for_report": 0.5, "aliases": [{"rules": ["a"], "canonical": "b"}], "patterns": [{"category": "x", "hotspot_types": ["file"]}]}))
    policy = load_policy(spark, str(p))
    assert policy.minimum_for_report == 0.5 and policy.aliases[0].canonical == "b" and policy.patterns[0].hotspot_types == ("file",)
    assert policy.severity_weights == DEFAULT_POLICY.severity_weights
    with pytest.raises(ValueError):
        policy_from_dict({"unknown": 1})


def test_more_patterns_than_a_word_has_bits(spark):
    from dataclasses import replace

    from lintlake.operators.diagnose import correlate, infer_root_causes
    from lintlake.policy import RootCausePattern

    patterns = tuple(RootCausePattern(f"c{i}", any_rules=(f"rule{i}",)) for i in range(70))
    policy = replace(DEFAULT_POLICY, patterns=patterns)
    rows = [finding(10 * i + k, rule=f"rule{i}", evidence=[(f"d{i}/f{k}.ts", 1, None)]) for i in (3, 63, 69) for k in range(6)]
    found = infer_root_causes(correlate(spark.createDataFrame(rows, FINDINGS), policy), policy)
    got = {r.key: r.category for r in found.where("type = 'pattern'").collect()}
    assert got == {f"rule{i}": f"c{i}" for i in (3, 63, 69)}


def test_matches_with_lines_in_long_files(spark):
    from pyspark.sql import functions as F

    from lintlake.functions.text import matches_with_lines

    content = "".join(f"x{i}\n" if i % 3 else f"x{i} y\n\n" for i in range(100_000))
    df = spark.createDataFrame([(content,), ("",), ("none",)], "content string")
    rows = df.select(matches_with_lines(F.col("content"), r"x\d+").alias("m")).collect()
    lines, line = [], 1
    for i in range(100_000):
        lines.append(line)
        line += 1 if i % 3 else 2
    assert [m.line for m in rows[0].m] == lines and rows[1].m == rows[2].m == []


def test_reading_folders(spark, tmp_path):
    for name, text in {"p1/src/a.ts": "x", "p1/node_modules/b.ts": "x", "p1/c.md": "y", "p2/d.java": "é"}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    got = {(r.repo, r.path, r.ext, r.content) for r in SF.read_files(spark, str(tmp_path)).collect()}
    assert got == {("p1", "src/a.ts", ".ts", "x"), ("p2", "d.java", ".java", "é")}
    assert SF.read_all_files(spark, str(tmp_path)).count() == 3


def test_folders_lose_no_name_and_report_bad_files(spark, tmp_path):
    names = ["p/src/a.ts", "p/src/__tests__/a.test.ts", "p/styles/_vars.scss", "p/.env", "p/.hidden/b.ts", "p/node_modules/c.ts", "p/with space/ü.ts"]
    for name in names:
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("const a = 1;")
    (tmp_path / "p/logo.png").write_bytes(b"\x89PNG\xff\xfe\x00")
    every = {r.path: r.error for r in SF.read_checked_files(spark, str(tmp_path), dot=True).collect()}
    assert every == {n[2:]: None for n in names if "node_modules" not in n} | {"logo.png": "not UTF-8"}
    plain = SF.read_all_files(spark, str(tmp_path))
    assert sorted(r.path for r in plain.collect()) == ["src/__tests__/a.test.ts", "src/a.ts", "styles/_vars.scss", "with space/ü.ts"]
    assert missing_tests(SF.read_files(spark, str(tmp_path))).where("title like '%src/a.ts%'").count() == 0
    assert SF.list_files(spark, str(tmp_path), dot=True).where("path like '%node_modules%'").count() == 0


def test_line_rules_on_a_stream(spark, tmp_path, files_of):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    files_of(("r", {"src/a.ts": "// FIXME now\nreadFileSync(x)"})).write.parquet(source)
    query = detect_stream(spark, source, sink, str(tmp_path / "state"))
    query.awaitTermination(60)
    assert sorted(r.rule for r in spark.read.parquet(sink).collect()) == ["sync-fs-usage", "unresolved-todo"]
