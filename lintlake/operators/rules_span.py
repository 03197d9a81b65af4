"""Rules on functions, classes and catch blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.spans import catch_blocks, class_spans, function_spans
from lintlake.operators.detect import (
    CODE_EXTS,
    SOURCE_EXTS,
    c,
    emit,
    finding,
    graded,
    one,
    repo_samples,
    scope,
    text,
)
from lintlake.policy import DEFAULT_POLICY, Policy

# --- Fixed values -------------------------------------------------------------------
GOD_CLASS_METHODS, GOD_CLASS_LINES = 10, 500
LOGGER_CALL = r"(?i)(?:logger|log|console|this\.log|this\.logger|winston|bunyan|pino)\s*\.\s*(?:error|warn|info|debug|log|fatal)\s*\("
THROW = r"\bthrow\b"
MANY_SWALLOWED = 5
# --------------------------------------------------------------------------------------


def functions(files: DataFrame) -> DataFrame:
    """Every function with its first line and length."""
    f = scope(files, CODE_EXTS, skip_tests=True).select("repo", "path", F.explode(function_spans(c.content)).alias("s"))
    return f.select("repo", "path", "s.name", "s.start", "s.lines")


def function_lengths(files: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    warning, error = policy.function_lengths
    long = functions(files).where(c.lines > warning)
    return emit(
        long,
        finding(
            "function-too-long", graded(c.lines, {"high": error}, "medium"),
            text("Long function: ", c.name, " (", c.lines, " lines)"),
            one(c.path, c.start, text(c.name, "() — ", c.lines, " lines")),
        ),
    )


def classes(files: DataFrame) -> DataFrame:
    f = scope(files, CODE_EXTS, skip_tests=True).where(F.contains("content", F.lit("class ")) | c.content.rlike(r"class\s"))
    f = f.select("repo", "path", F.explode(class_spans(c.content)).alias("s"))
    return f.select("repo", "path", "s.name", "s.start", "s.lines", "s.methods")


def god_classes(files: DataFrame, methods: int = GOD_CLASS_METHODS, lines: int = GOD_CLASS_LINES) -> DataFrame:
    many, long = c.methods > methods, c.lines > lines
    reason = (
        F.when(many & long, text(c.methods, " methods and ", c.lines, " lines"))
        .when(many, text(c.methods, " methods"))
        .otherwise(text(c.lines, " lines"))
    )
    return emit(
        classes(files).where(many | long),
        finding(
            "god-class", F.when(many & long, F.lit("high")).otherwise(F.lit("medium")),
            text("Class does too much: ", c.name, " (", reason, ")"),
            one(c.path, c.start, text("class ", c.name, " — ", reason)),
        ),
    )


def swallowed_by_file(files: DataFrame) -> DataFrame:
    """Per file: how many catch blocks neither log nor throw, and the first of them."""
    silent = F.filter("blocks", lambda b: ~b["body"].rlike(LOGGER_CALL) & ~b["body"].rlike(THROW))
    f = scope(files, SOURCE_EXTS).where(F.contains("content", F.lit("catch")))
    f = f.select("repo", "path", catch_blocks(c.content).alias("blocks"))
    return f.select(
        "repo", "path", F.transform(silent, lambda b: b["line"]).alias("at")
    ).select(
        "repo", "path", F.size("at").alias("n"),
        F.transform("at", lambda l: F.struct(l.alias("line"), F.lit(None).cast("string").alias("snippet"))).alias("samples"),
    )


def swallowed_exceptions(files: DataFrame) -> DataFrame:
    """One finding per repository with the total and the first five places."""
    return emit(
        repo_samples(swallowed_by_file(files)),
        finding(
            "swallowed-exception", F.when(c.n >= MANY_SWALLOWED, F.lit("high")).otherwise(F.lit("medium")),
            text(c.n, " catch blocks neither log nor rethrow"), c.evidence,
        ),
    )
