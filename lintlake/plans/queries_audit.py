"""Registered queries of the whole audit: files in, findings and reports out."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.catalog import ADVICE, ID_PREFIX
from lintlake.operators.findings import primary_file, primary_line
from lintlake.plans import oracle_findings as OF
from lintlake.plans.audit import audit, complete, detect_all
from lintlake.plans.oracle_code import ORACLE as CODE
from lintlake.plans.queries_code import CUSTOM, SHORT, as_of
from lintlake.sources import views as V


def files(spark, sf):
    """Scripts, Java classes and pages in one table."""
    return V.code_files(spark, sf).unionByName(V.java_files(spark, sf)).unionByName(V.page_files(spark, sf))


def audit_findings(spark, sf):
    return complete(detect_all(files(spark, sf), SHORT, as_of(), CUSTOM)).select(
        "repo", "seq", "id", "domain", "rule", "severity", "confidence", primary_file().alias("file"), primary_line().alias("line"),
        F.get("evidence", F.lit(0))["snippet"].alias("snippet"), F.size("evidence").alias("places"), "recommendation", "effort",
    )


def audit_report(spark, sf):
    """Score, grade, statistics and summary of every repository."""
    summaries = audit(files(spark, sf), SHORT, as_of(), CUSTOM).report.summaries
    counts = F.transform(F.array_sort(F.map_entries("by_domain")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return summaries.withColumn("by_domain", F.array_join(counts, ","))


def audit_sarif(spark, sf):
    """One row per SARIF result of the cleaned findings."""
    result = F.col("result")
    first = F.get(result["locations"], F.lit(0))["physicalLocation"]
    return audit(files(spark, sf), SHORT, as_of(), CUSTOM).sarif.select(
        "repo", "seq", result["ruleId"].alias("rule_id"), result["level"].alias("level"),
        F.size(result["locations"]).alias("locations"), first["artifactLocation"]["uri"].alias("uri"), first["region"]["startLine"].alias("start_line"),
        result["properties"]["severity"].alias("severity"), result["properties"]["domain"].alias("domain"),
        result["properties"]["confidence"].alias("confidence"), result["properties"]["recommendation"].alias("recommendation"), result["properties"]["effort"].alias("effort"),
    )


QUERIES = {f.__name__: f for f in (audit_findings, audit_report, audit_sarif)}

_COLUMNS = "repo, rule, domain, severity, confidence, file, line, snippet, places"
_PARTS = ("line_rules", "line_rules_java", "file_rules", "many_parameters", "a11y_pages")
_FOUND = " UNION ALL ".join(f"SELECT {_COLUMNS} FROM ({CODE[n]})" for n in _PARTS)
_ORDER = "coalesce(file, ''), coalesce(line, 0), rule, severity, coalesce(snippet, '')"
_CASES = {
    "prefix": " ".join(f"WHEN '{d}' THEN '{p}'" for d, p in ID_PREFIX.items()),
    "advice": " ".join(f"WHEN '{d}' THEN '{a[0]}'" for d, a in ADVICE.items()),
    "effort": " ".join(f"WHEN '{d}' THEN '{a[1]}'" for d, a in ADVICE.items()),
}

#: The findings of the audit, numbered and with ids and advice.
_AUDIT = f"""
found AS ({_FOUND}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY domain, {_ORDER}) AS seq,
   row_number() OVER (PARTITION BY repo, domain ORDER BY {_ORDER}) AS k FROM found),
fv AS (SELECT {_COLUMNS}, seq, (CASE domain {_CASES["prefix"]} END) || '-' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS id,
   CASE domain {_CASES["advice"]} END AS recommendation, CASE domain {_CASES["effort"]} END AS effort FROM numbered)"""
#: Several places raise the confidence, generated and test files lower it.
_ADJUSTED = """
adj AS (SELECT * REPLACE (greatest(0.0, least(1.0, confidence
    + (CASE WHEN snippet IS NOT NULL THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)
    + (CASE WHEN places >= 2 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)
    + (CASE WHEN regexp_matches(file, '(?i)generated|vendor|dist|node_modules') THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END)
    + (CASE WHEN regexp_matches(file, '(?i)fixture|mock|stub|fake|__tests__|test-data') THEN -0.15::DOUBLE ELSE 0.0::DOUBLE END)
  )) AS confidence) FROM kept)"""
_GROUPS = (
    ("excessive-file-length", "file-too-long", "conventions"), ("missing-unit-test", "untested-source-file", "tests"),
    ("aged-todo", "unresolved-todo", "tech-debt"), ("no-hardcoded-secret", "hardcoded-secret", "security"),
)
_ALIASED = (
    "ali AS (SELECT * REPLACE (CASE " + " ".join(f"WHEN rule IN ('{a}', '{b}') THEN '{a}'" for a, b, _ in _GROUPS) + " ELSE rule END AS rule), CASE "
    + " ".join(f"WHEN rule IN ('{a}', '{b}') THEN '{d}'" for a, b, d in _GROUPS) + " END AS keep_domain FROM adj)"
)
_CLEAN = ", ".join([_AUDIT, OF.FILTERED, _ADJUSTED, _ALIASED, OF.dedup()])

ORACLE = {
    "audit_findings": f"WITH {_AUDIT} SELECT * FROM fv",
    "audit_report": OF.q(
        ", ".join([_CLEAN, OF.scores("fv"), OF.overall(), OF.WORST, OF.STATS, OF.SUMMARY]),
        """SELECT mt.*, coalesce(by_domain, '') AS by_domain FROM mt LEFT JOIN (SELECT repo, string_agg(domain || '=' || n, ',' ORDER BY domain) AS by_domain
             FROM (SELECT repo, domain, count(*) AS n FROM cf GROUP BY repo, domain) GROUP BY repo) USING (repo)""",
    ),
    "audit_sarif": OF.q(
        _CLEAN,
        """SELECT repo, seq, rule AS rule_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning'
             WHEN 'low' THEN 'note' ELSE 'none' END AS level, places AS locations, file AS uri, CASE WHEN line > 0 THEN line END AS start_line,
             severity, domain, confidence, recommendation, effort FROM cf""",
    ),
}
