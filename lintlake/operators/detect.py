"""What all detectors share: file scopes, finding structs and bounded samples."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.catalog import RULES
from lintlake.functions.scalars import snippet as cut_snippet
from lintlake.operators.positions import first_k

# --- Fixed values: file scopes -------------------------------------------------
SOURCE_EXTS = [".ts", ".js", ".java"]
CODE_EXTS = [".ts", ".js", ".java", ".py", ".go", ".kt"]
TEMPLATE_EXTS = [".html", ".tsx", ".jsx"]
STYLE_EXTS = [".css", ".scss", ".less"]
IGNORED_DIRS = ["node_modules", "dist", ".git", "coverage", ".cache"]
TEST_INFRA = r"(?:^|[/\\])(?:__tests__|test__|tests|fixtures|__mocks__|e2e|spec)(?:[/\\]|$)"
SAMPLES = 5
# ---------------------------------------------------------------------------------


class _Columns:
    """``c.path`` for ``F.col("path")``, without needing a session at import time."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


c = _Columns()


def in_ignored_dir(path: Column, extra=()) -> Column:
    names = "|".join(d.replace(".", r"\.") for d in [*IGNORED_DIRS, *extra])
    return path.rlike(rf"(?:^|/)(?:{names})/")


def is_dotted(path: Column) -> Column:
    return path.rlike(r"(?:^|/)\.")


def in_scope(exts=None, dot: bool = False, ignore_dirs=(), skip_tests: bool = False) -> Column:
    """Whether a rule looks at a file: extension, no ignored folder, no dotfile."""
    cond = ~in_ignored_dir(c.path, ignore_dirs)
    if exts is not None:
        cond = c.ext.isin(list(exts)) & cond
    if not dot:
        cond = cond & ~is_dotted(c.path)
    if skip_tests:
        cond = cond & ~c.path.rlike(TEST_INFRA)
    return cond


def scope(files: DataFrame, exts=None, dot: bool = False, ignore_dirs=(), skip_tests: bool = False) -> DataFrame:
    return files.where(in_scope(exts, dot, ignore_dirs, skip_tests))


def place(file: Column, line: Column | None = None, snip: Column | None = None) -> Column:
    """One piece of evidence."""
    return F.struct(
        file.alias("file"),
        (F.lit(None) if line is None else line).cast("int").alias("line"),
        (F.lit(None) if snip is None else snip).cast("string").alias("snippet"),
    )


def finding(rule: str | Column, severity: str | Column, title: Column, evidence: Column, known=None) -> Column:
    """A finding struct; ``evidence`` is one place or an array of places."""
    domain, confidence = known or RULES[rule]
    return F.struct(
        (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"),
        F.lit(domain).alias("domain"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        F.lit(float(confidence)).alias("confidence"),
        title.alias("title"),
        evidence.alias("evidence"),
    )


def text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def emit(df: DataFrame, *hits: Column, each=()) -> DataFrame:
    """One row per finding.

    ``hits`` are single structs (null when a rule does not fire), ``each`` are arrays of
    structs. All rules of a call share one pass over ``df``.
    """
    parts = [F.array_compact(F.array(*hits))] if hits else []
    parts += list(each)
    found = parts[0] if len(parts) == 1 else F.concat(*parts)
    return df.select("repo", F.explode(found).alias("f")).select(
        "repo", "f.rule", "f.domain", "f.severity", "f.confidence", "f.title", "f.evidence"
    )


def let(value: Column, body) -> Column:
    """``body(value)`` as an array, with the value computed once and nulls left out."""
    return F.array_compact(F.transform(F.array(value), body))


@dataclass(frozen=True)
class FileRules:
    """Rules that share a scope: ``hits`` are single structs, ``each`` arrays of structs.

    ``on`` looks at path and extension only and so reaches the scan; ``when`` may look
    at the text.
    """

    on: Column
    hits: tuple = ()
    each: tuple = ()
    when: Column | None = None

    def found(self) -> Column:
        parts = ([F.array_compact(F.array(*self.hits))] if self.hits else []) + list(self.each)
        cond = self.on if self.when is None else self.on & self.when
        return F.when(cond, F.flatten(F.array_compact(F.array(*parts))))


def detect_in_files(files: DataFrame, parts: list[FileRules]) -> DataFrame:
    """All given rules in one pass over the files; ``c.lines`` is the text split once."""
    wanted = reduce(lambda a, b: a | b, [p.on for p in parts])
    lined = files.where(wanted).withColumn("lines", F.split("content", "\n"))
    found = F.flatten(F.array_compact(F.array(*[p.found() for p in parts])))
    return lined.select("repo", F.explode(found).alias("f")).select("repo", "f.*")


def one(file: Column, line: Column | None = None, snip: Column | None = None) -> Column:
    return F.array(place(file, line, snip))


def graded(value: Column, above: dict, otherwise: str) -> Column:
    """Severity by thresholds: the first ``value > limit`` wins."""
    out = F.lit(otherwise)
    for sev, limit in reversed(list(above.items())):
        out = F.when(value > limit, F.lit(sev)).otherwise(out)
    return out


def sample_array(hits: Column, k: int = SAMPLES) -> Column:
    return F.transform(
        F.slice(hits, 1, k),
        lambda h: F.struct(h["line"].alias("line"), cut_snippet(h["text"]).alias("snippet")),
    )


def repo_samples(per_file: DataFrame, k: int = SAMPLES, with_snippet: bool = False) -> DataFrame:
    """Total and first places per repository, from rows ``(repo, path, n, samples)``.

    The per-file rows come from reading file contents. They are small, so they are exchanged once and
    both aggregations read that exchange; nothing runs before the result is asked for. A repository
    contributes at most ``k`` rows per partition to the samples, whatever its size.
    """
    hits = per_file.where(F.col("n") > 0).select("repo", "path", "n", F.slice("samples", 1, k).alias("samples")).repartition("repo", "path")
    totals = hits.groupBy("repo").agg(F.sum("n").alias("n"))
    firsts = first_k(hits, ["repo"], ["path"], k).groupBy("repo").agg(
        F.array_sort(F.collect_list(F.struct("_rank", "path", "samples"))).alias("_files")
    )
    places = F.flatten(
        F.transform(
            "_files",
            lambda f: F.transform(
                f["samples"], lambda s: place(f["path"], s["line"], s["snippet"] if with_snippet else None)
            ),
        )
    )
    return totals.join(firsts, "repo").select("repo", "n", F.slice(places, 1, k).alias("evidence"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def flat(findings: DataFrame) -> DataFrame:
    """Findings with their first place as plain columns."""
    first = F.get("evidence", F.lit(0))
    return findings.select(
        "repo",
        "rule",
        "domain",
        "severity",
        "confidence",
        "title",
        first["file"].alias("file"),
        first["line"].alias("line"),
        first["snippet"].alias("snippet"),
        F.size("evidence").alias("places"),
    )

