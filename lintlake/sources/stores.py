"""Stored tables: reports with their history, SARIF exports, the activity log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.report import sarif_documents
from lintlake.schema import ACTIVITY

# --- Fixed values ---------------------------------------------------------------------
AGENTS = [
    "audit-orchestrator",
    "audit-security",
    "audit-tests",
    "audit-architecture",
    "audit-conventions",
    "audit-performance",
    "audit-documentation",
    "audit-tech-debt",
]
OUTCOMES = ["success", "failure", "partial"]
LOG_LIMIT = 50
# ----------------------------------------------------------------------------------------


def write_reports(reports: DataFrame, path: str, mode: str = "append") -> None:
    """Append report rows as Parquet, one folder per run date.

    Repositories are too many and too uneven for folders of their own: rows are sorted
    by repository inside a file instead, so that a filter on ``repo`` skips row groups.
    """
    reports.sortWithinPartitions("repo").write.mode(mode).partitionBy("run_date").parquet(path)


def read_reports(spark: SparkSession, path: str, repo: str | None = None, since=None) -> DataFrame:
    reports = spark.read.parquet(path)
    if since is not None:
        reports = reports.where(F.col("run_date") >= F.lit(since))
    return reports if repo is None else reports.where(F.col("repo") == repo)


def write_json_reports(reports: DataFrame, path: str) -> None:
    """One JSON document per report row."""
    reports.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_sarif(findings: DataFrame, path: str, tool_name: str, tool_version: str) -> None:
    """SARIF logs as text, one document per line."""
    sarif_documents(findings, tool_name, tool_version).select(F.col("document").alias("value")).write.mode(
        "overwrite"
    ).text(path)


def split_activity(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of known agents with a known outcome, and the others."""
    known = F.coalesce(F.col("agent").isin(AGENTS) & F.col("outcome").isin(OUTCOMES), F.lit(False))
    return entries.where(known), entries.where(~known)


def append_activity(entries: DataFrame, path: str) -> None:
    """Append to the log; an unknown agent or outcome rejects the whole call."""
    good, bad = split_activity(entries)
    if bad.limit(1).count():
        raise ValueError(f"activity of unknown agents or outcomes; agents are {AGENTS}")
    good.select(*ACTIVITY.fieldNames()).write.mode("append").json(path)


def read_activity(spark: SparkSession, path: str, agent: str | None = None, limit: int = LOG_LIMIT) -> DataFrame:
    """Newest entries first, of one agent if given; entries of one time follow agent and text, so the limit is stable."""
    log = spark.read.schema(ACTIVITY).json(path)
    if agent is not None:
        log = log.where(F.col("agent") == agent)
    return log.orderBy(F.col("timestamp").desc(), "agent", F.to_json(F.struct(*log.columns))).limit(limit)
