"""Data model: enumerations, ranks and the schemas of the canonical tables."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: enumerations in rank order -------------------------------
SEVERITIES = ["critical", "high", "medium", "low", "info"]
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
DOMAINS = [
    "security",
    "tests",
    "architecture",
    "conventions",
    "performance",
    "documentation",
    "tech-debt",
    "accessibility",
    "api-design",
    "observability",
    "i18n",
    "ux-consistency",
]
EFFORTS = ["trivial", "small", "medium", "large", "epic"]
GRADES = ["A", "B", "C", "D", "F"]
HOTSPOT_TYPES = ["file", "module", "dependency", "pattern"]
SOURCES = ["tool", "llm"]
BATCHES = ["fix_now", "next_sprint", "backlog"]
# ----------------------------------------------------------------------------

EVIDENCE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("snippet", T.StringType()),
    ]
)

FILES = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("ext", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

#: What every detector and report reader returns.
DETECTED = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("title", T.StringType()),
        T.StructField("evidence", T.ArrayType(EVIDENCE)),
    ]
)

#: A complete finding as it is stored and exchanged.
FINDINGS = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("evidence", T.ArrayType(EVIDENCE)),
        T.StructField("recommendation", T.StringType()),
        T.StructField("effort", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("source", T.StringType()),
    ]
)

ACTIVITY = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("agent", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("tools_used", T.ArrayType(T.StringType())),
        T.StructField("files_touched", T.ArrayType(T.StringType())),
        T.StructField("outcome", T.StringType()),
        T.StructField("detail", T.StringType()),
    ]
)
