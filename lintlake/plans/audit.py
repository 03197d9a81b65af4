"""End to end: from files to complete findings, and on to the report of each repository."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.catalog import ADVICE, ID_PREFIX
from lintlake.functions.scalars import lookup
from lintlake.operators import rules_file as RF
from lintlake.operators import rules_line as RL
from lintlake.operators.detect import union_all
from lintlake.operators.findings import primary_file, primary_line
from lintlake.operators.positions import numbered_positions
from lintlake.operators.report import sarif_results
from lintlake.plans.merge import MergedReport, merge_reports
from lintlake.policy import DEFAULT_POLICY, Policy
from lintlake.schema import FINDINGS
from lintlake.session import cut_lineage


@dataclass(frozen=True)
class Audit:
    """Complete findings, the merged report and its SARIF rows; each table is keyed by ``repo``."""

    findings: DataFrame
    report: MergedReport
    sarif: DataFrame


def detect_all(files: DataFrame, policy: Policy = DEFAULT_POLICY, as_of: Column | None = None, patterns=()) -> DataFrame:
    """What the rules find that look at one file at a time, in five passes over the texts: lines, framework files,
    code, parameter lists, markup."""
    return union_all(
        [
            RL.line_rules(files, as_of, patterns),
            RF.file_rules(files, policy),
            RF.parameter_counts(files, policy),
            RF.accessibility(files),
        ]
    )


def complete(found: DataFrame) -> DataFrame:
    """Detected rows as complete findings, with ``seq``, ``id`` and advice.

    The order of a repository is domain, place, rule, severity, snippet and title, so equal input gives equal ids;
    rows that tie in all of them are the same finding. ``id`` counts within a domain: its number is the ``seq``
    less what earlier domains of the repository have, of which there are few per repository.
    """
    snippet = F.coalesce(F.get("evidence", F.lit(0))["snippet"], F.lit(""))
    order = ["domain", primary_file(""), primary_line(0), "rule", "severity", snippet, "title"]
    found = cut_lineage(found)  # a range shuffle reads its input twice, so texts would be searched twice
    numbered = cut_lineage(numbered_positions(found, ["repo"], order, "seq"))
    sizes = numbered.groupBy("repo", "domain").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("repo").orderBy("domain").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("repo", "domain", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    number = (F.col("seq") - F.col("_before")).cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)

    def advice(k: int) -> Column:
        return lookup(F.col("domain"), {d: a[k] for d, a in ADVICE.items()})

    full = numbered.join(before, ["repo", "domain"]).withColumns(
        {
            "seq": F.col("seq").cast("bigint"),
            "id": F.concat(lookup(F.col("domain"), ID_PREFIX), F.lit("-"), padded),
            "description": F.lit(None).cast("string"),
            "recommendation": advice(0),
            "effort": advice(1),
            "tags": F.array("domain", "rule"),
            "source": F.lit("tool"),
        }
    )
    return full.select(*FINDINGS.fieldNames())


def audit(files: DataFrame, policy: Policy = DEFAULT_POLICY, as_of: Column | None = None, patterns=(), ignore=None) -> Audit:
    """Detect, complete, merge and score all repositories of ``files``."""
    findings = cut_lineage(complete(detect_all(files, policy, as_of, patterns)))
    report = merge_reports(findings, policy, ignore)
    return Audit(findings, report, sarif_results(report.findings))
