"""Findings pipeline: validate, filter, adjust, suppress, de-duplicate, rank, page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.scalars import lookup, severity_rank
from lintlake.operators.positions import first_k, numbered_positions
from lintlake.policy import DEFAULT_POLICY, KEEP_SEVERITY, Policy
from lintlake.schema import DOMAINS, EFFORTS, SEVERITIES, SOURCES

# --- Fixed values: limits and patterns of a valid finding --------------------
ID_PATTERN = r"^[A-Z]{2,5}-[0-9]{3,4}$"
MAX_TITLE, MAX_DESCRIPTION, MAX_RECOMMENDATION, MAX_EVIDENCE_SNIPPET = 200, 2000, 1000, 500
GENERATED_PATH = r"(?i)generated|vendor|dist|node_modules"
FIXTURE_PATH = r"(?i)fixture|mock|stub|fake|__tests__|test-data"
NO_FILE = "no-file"
# ----------------------------------------------------------------------------


def primary_file(default: str | None = None) -> Column:
    file = F.get("evidence", F.lit(0))["file"]
    return file if default is None else F.coalesce(file, F.lit(default))


def primary_line(default: int | None = None) -> Column:
    line = F.get("evidence", F.lit(0))["line"]
    return line if default is None else F.coalesce(line, F.lit(default))


# -- validation ---------------------------------------------------------------


def violations() -> Column:
    """Array of the reasons why a row is not a valid finding; empty when it is."""

    def broken(cond: Column, reason: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(True)), F.lit(reason))

    def optional(col: str, cond: Column, reason: str) -> Column:
        return F.when(F.col(col).isNotNull() & cond, F.lit(reason))

    reasons = [
        broken(~F.col("id").rlike(ID_PATTERN), "id"),
        broken(~F.col("severity").isin(SEVERITIES), "severity"),
        broken((F.length("title") < 1) | (F.length("title") > MAX_TITLE), "title"),
        optional("description", F.length("description") > MAX_DESCRIPTION, "description"),
        broken(~F.col("domain").isin(DOMAINS), "domain"),
        broken(F.length("rule") < 1, "rule"),
        broken((F.col("confidence") < 0) | (F.col("confidence") > 1) | F.isnan("confidence"), "confidence"),
        broken(F.size("evidence") < 1, "evidence"),
        F.when(
            F.exists(
                "evidence",
                lambda e: F.coalesce(F.length(e["file"]) < 1, F.lit(True))
                | F.coalesce(e["line"] <= 0, F.lit(False))
                | F.coalesce(F.length(e["snippet"]) > MAX_EVIDENCE_SNIPPET, F.lit(False)),
            ),
            F.lit("evidence_item"),
        ),
        optional("recommendation", F.length("recommendation") > MAX_RECOMMENDATION, "recommendation"),
        optional("effort", ~F.col("effort").isin(EFFORTS), "effort"),
        optional("source", ~F.col("source").isin(SOURCES), "source"),
    ]
    return F.array_compact(F.array(*reasons))


def validate_findings(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into valid rows and rejected rows (with ``reasons``)."""
    checked = findings.withColumn("reasons", violations())
    return (
        checked.where(F.size("reasons") == 0).drop("reasons"),
        checked.where(F.size("reasons") > 0),
    )


def assign_ids(findings: DataFrame, prefix: str, start: int = 1, keys=("repo",), order=None) -> DataFrame:
    """Sequential ids per repository: ``SEC-001`` and on, longer numbers keep all digits.

    Findings that share file, line and rule follow severity, snippet and title; those that share all of it are the same.
    """
    snippet = F.coalesce(F.get("evidence", F.lit(0))["snippet"], F.lit(""))
    order = order or [primary_file(""), primary_line(0), "rule", "severity", snippet, "title"]
    numbered = numbered_positions(findings, list(keys), order, "_n")
    number = (F.col("_n") + F.lit(start - 1)).cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return numbered.withColumn("id", F.concat(F.lit(f"{prefix}-"), padded)).drop("_n")


# -- filters and adjustments --------------------------------------------------


def confidence_filter(findings: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return findings.where(
        (F.col("confidence") >= policy.auto_dismiss_below) & (F.col("confidence") >= policy.minimum_for_report)
    )


def evidence_condition(name: str) -> Column:
    if name == "evidence_has_snippet":
        return F.exists("evidence", lambda e: e["snippet"].isNotNull())
    if name == "multiple_evidence_locations":
        return F.size("evidence") >= 2
    if name == "evidence_in_generated_code":
        return F.exists("evidence", lambda e: e["file"].rlike(GENERATED_PATH))
    if name == "evidence_in_test_fixtures":
        return F.exists("evidence", lambda e: e["file"].rlike(FIXTURE_PATH))
    return F.lit(False)


def adjust_confidence(findings: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Add the deltas whose condition holds, in policy order, then clamp to 0..1."""
    if not policy.adjustments:
        return findings
    total = reduce(
        lambda acc, adj: acc
        + F.when(F.coalesce(evidence_condition(adj[0]), F.lit(False)), F.lit(float(adj[1]))).otherwise(F.lit(0.0)),
        policy.adjustments,
        F.col("confidence"),
    )
    return findings.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def apply_ignore_rules(findings: DataFrame, rules: DataFrame | list[tuple[str, str]]) -> DataFrame:
    """Drop findings that a suppression covers.

    A list holds ``(rule, path fragment)`` pairs that apply everywhere. A DataFrame
    ``(repo, rule, file)`` holds each repository's own suppressions.
    """
    if isinstance(rules, list):
        if not rules:
            return findings

        def covers(rule: str, fragment: str) -> Column:
            by_rule = F.lit(True) if rule == "*" else F.col("rule") == rule
            if fragment == "*":
                return by_rule
            return by_rule & F.exists("evidence", lambda e: F.contains(e["file"], F.lit(fragment)))

        covered = [covers(rule, fragment) for rule, fragment in rules]
        return findings.where(~F.coalesce(reduce(lambda a, b: a | b, covered), F.lit(False)))
    r = rules.select(
        F.col("repo").alias("_repo"), F.col("rule").alias("_rule"), F.col("file").alias("_file")
    ).distinct()
    anywhere = r.where(F.col("_file") == "*")
    in_path = r.where(F.col("_file") != "*")
    rule_matches = (F.col("_rule") == "*") | (F.col("_rule") == F.col("rule"))
    kept = findings.join(anywhere, (F.col("_repo") == F.col("repo")) & rule_matches, "left_anti")
    return kept.join(
        in_path,
        (F.col("_repo") == F.col("repo"))
        & rule_matches
        & F.exists("evidence", lambda e: F.contains(e["file"], F.col("_file"))),
        "left_anti",
    )


# -- de-duplication -----------------------------------------------------------


def resolve_aliases(findings: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Replace a rule by its canonical name; ``keep_domain`` is the domain to prefer."""
    canonical = {rule: a.canonical for a in policy.aliases for rule in a.rules}
    keep = {rule: a.keep_domain for a in policy.aliases for rule in a.rules if a.keep_domain}
    rule = F.col("rule")
    return findings.withColumn(
        "keep_domain", lookup(rule, keep) if keep else F.lit(None).cast("string")
    ).withColumn("rule", F.coalesce(lookup(rule, canonical), rule) if canonical else rule)


def dedup_keys(policy: Policy) -> list[Column]:
    file = primary_file(NO_FILE).alias("_file")
    line = primary_line(0).alias("_line")
    return {
        "same-rule-same-location": [file, line],
        "same-rule-same-file": [file],
        "same-rule-any-location": [],
    }[policy.strategy]


def deduplicate(findings: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """One finding per key; ``seq`` decides ties in favour of the earliest.

    The preferred domain of a key is that of its first row. When every canonical
    rule belongs to its own alias group, as in the defaults, all rows of a key agree
    on it and one window is enough; else it is looked up per key first.
    """
    key_cols = dedup_keys(policy)
    names = ["repo", "rule"] + ["_file", "_line"][: len(key_cols)]
    resolved = resolve_aliases(findings, policy).select("*", *key_cols)
    groups: dict[str, set] = {}
    for a in policy.aliases:
        groups.setdefault(a.canonical, set()).add(a.keep_domain)
    uniform = all(a.canonical in a.rules for a in policy.aliases) and all(len(g) == 1 for g in groups.values())
    if not uniform:
        firsts = resolved.groupBy(*names).agg(F.min_by("keep_domain", "seq").alias("_first_keep"))
        resolved = (
            resolved.drop("keep_domain").join(firsts, names).withColumnRenamed("_first_keep", "keep_domain")
        )
    preferred = F.coalesce((F.col("domain") == F.col("keep_domain")).cast("int"), F.lit(0))
    order = [preferred.desc()]
    if policy.on_conflict == KEEP_SEVERITY:
        order.append(severity_rank(F.col("severity")).desc())
    order += [F.col("confidence").desc(), F.col("seq").asc()]
    winners = first_k(resolved, names, order, 1)
    return winners.drop("_rank", "keep_domain", "_file", "_line")


# -- ranking and paging -------------------------------------------------------


def finding_order() -> list[Column]:
    return [severity_rank(F.col("severity")).desc(), F.col("confidence").desc(), F.col("seq").asc()]


def top_findings(findings: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most severe findings of each repository, with their rank."""
    return first_k(findings, ["repo"], finding_order(), n, "rank")


def paginate(
    findings: DataFrame, limit: int = 20, offset: int = 0, order: list[Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """A page of rows, and one row with total, count, has_more and next_offset."""
    page = findings.orderBy(*(order or finding_order())).offset(offset).limit(limit)
    total = F.col("total")
    more = total > offset + limit
    meta = findings.agg(F.count(F.lit(1)).alias("total")).select(
        total,
        F.greatest(F.least(total - offset, F.lit(limit)), F.lit(0)).cast("bigint").alias("count"),
        more.alias("has_more"),
        F.when(more, F.lit(offset + limit)).alias("next_offset"),
    )
    return page, meta


def diff_findings(a: DataFrame, b: DataFrame, key: list[str] | None = None) -> dict[str, DataFrame]:
    """Rows only in ``a`` (added), only in ``b`` (removed), and those of ``a`` also in ``b``."""
    key = key or ["repo", "id"]
    ids_a, ids_b = a.select(*key), b.select(*key)
    return {
        "added": a.join(ids_b, key, "left_anti"),
        "removed": b.join(ids_a, key, "left_anti"),
        "unchanged": a.join(ids_b, key, "left_semi"),
    }


def fingerprint() -> Column:
    """Content-based identity, stable when id sequences shift between runs."""
    ev = F.get("evidence", F.lit(0))
    return F.md5(F.concat_ws("\u0001", F.col("rule"), ev["file"], F.coalesce(ev["snippet"], F.lit(""))))


def findings_by_severity(findings: DataFrame) -> DataFrame:
    return (
        findings.groupBy("repo", "severity")
        .agg(F.count(F.lit(1)).alias("findings"), F.min("seq").alias("first_seq"))
        .withColumn("rank", severity_rank(F.col("severity")))
    )


def scope_to_changed(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Keep only changed files; the plan broadcasts ``changed`` when it is small."""
    return files.join(changed.select("repo", "path"), ["repo", "path"], "left_semi")
