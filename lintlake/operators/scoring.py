"""Statistics, domain scores, overall scores and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.scalars import js_round, lookup
from lintlake.policy import DEFAULT_POLICY, Policy
from lintlake.schema import DOMAINS, SEVERITIES

# --- Fixed values ------------------------------------------------------------
UNKNOWN_DOMAIN_WEIGHT = 0.1
CLEAN_SCORE = 100
PRIORITY_AREA_BELOW = 70
SLA_SEVERITIES = ("critical", "high", "medium")
# ----------------------------------------------------------------------------

#: Penalties are added as decimals: a sum of doubles depends on the order of the
#: rows, and the rounding that follows would make that visible.
PENALTY = "decimal(18,6)"


def penalty(policy: Policy = DEFAULT_POLICY) -> Column:
    weight = lookup(F.col("severity"), {k: float(v) for k, v in policy.severity_weights.items()}, 0.0)
    return (weight * F.col("confidence")).cast(PENALTY)


REPO = ("repo",)


def statistics(findings: DataFrame, keys=REPO) -> DataFrame:
    """Per report: total, the five severity counts, and a map of counts per domain."""
    per_domain = findings.groupBy(*keys, "domain").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES],
    )
    return per_domain.groupBy(*keys).agg(
        F.sum("_n").alias("total_findings"),
        *[F.sum(s).alias(s) for s in SEVERITIES],
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("domain", "_n")))).alias("by_domain"),
    )


def domain_scores(
    findings: DataFrame, policy: Policy = DEFAULT_POLICY, audited: DataFrame | None = None, keys=REPO
) -> DataFrame:
    """Score 0..100 per report (``keys``) and domain.

    ``audited(*keys, domain)`` names domains that were looked at: those without
    findings score 100.
    """
    scored = findings.groupBy(*keys, "domain").agg(
        js_round(F.lit(100.0) - F.sum(penalty(policy)).cast("double")).alias("_raw"),
        F.count(F.lit(1)).alias("findings"),
    )
    if audited is not None:
        scored = audited.select(*keys, "domain").distinct().join(scored, [*keys, "domain"], "left")
    return scored.select(
        *keys,
        "domain",
        F.greatest(F.coalesce("_raw", F.lit(CLEAN_SCORE)), F.lit(0)).cast("int").alias("score"),
        F.coalesce("findings", F.lit(0)).cast("bigint").alias("findings"),
    )


def domain_weight(domain: Column, policy: Policy, default: float) -> Column:
    return lookup(domain, {k: float(v) for k, v in policy.domain_weights.items()}, default).cast("decimal(9,4)")


def derive_grade(score: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    ordered = sorted(policy.grades.items(), key=lambda kv: -kv[1])
    grade = F.lit("F")
    for name, minimum in reversed(ordered):
        grade = F.when(score >= minimum, F.lit(name)).otherwise(grade)
    return grade


def overall_scores(scores: DataFrame, policy: Policy = DEFAULT_POLICY, keys=REPO) -> DataFrame:
    """Weighted mean over the audited domains of each report, with its grade."""
    w = domain_weight(F.col("domain"), policy, UNKNOWN_DOMAIN_WEIGHT)
    agg = scores.groupBy(*keys).agg(
        F.sum(F.col("score") * w).alias("_sw"), F.sum(w).alias("_w"), F.sum("findings").alias("total_findings")
    )
    overall = F.when(
        F.col("_w") > 0, js_round(F.col("_sw").cast("double") / F.col("_w").cast("double"))
    ).otherwise(F.lit(0))
    return agg.select(*keys, overall.cast("int").alias("overall_score"), "total_findings").withColumn(
        "grade", derive_grade(F.col("overall_score"), policy)
    )


def domain_order(domain: Column) -> Column:
    return lookup(domain, {d: i for i, d in enumerate(DOMAINS)}, len(DOMAINS))


def worst_domains(scores: DataFrame) -> DataFrame:
    """First lowest-scoring domain of each repository, in domain order."""
    best = F.min(F.struct(F.col("score"), domain_order(F.col("domain")).alias("o"), F.col("domain")))
    return scores.groupBy("repo").agg(best.alias("_w")).select(
        "repo", F.col("_w.domain").alias("worst_domain"), F.col("_w.score").alias("worst_score")
    )


def sla_days(severity: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    known = {k: v for k, v in policy.sla_days.items() if v is not None}
    return lookup(severity, known) if known else F.lit(None).cast("int")


def summary_text(policy: Policy = DEFAULT_POLICY, with_sla: bool = True) -> Column:
    """One sentence per repository from score, grade, severity counts and worst domain."""
    counts = F.array_compact(
        F.array(*[F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in SEVERITIES])
    )
    text = F.concat(
        F.lit("Score "),
        F.col("overall_score").cast("string"),
        F.lit(" of 100, grade "),
        F.col("grade"),
        F.lit("; found: "),
        F.when(F.size(counts) > 0, F.array_join(counts, ", ")).otherwise(F.lit("none")),
        F.lit("."),
        F.when(
            F.col("worst_score") < PRIORITY_AREA_BELOW,
            F.concat(
                F.lit(" Weakest: "),
                F.col("worst_domain"),
                F.lit(" at "),
                F.col("worst_score").cast("string"),
                F.lit("."),
            ),
        ).otherwise(F.lit("")),
    )
    if not with_sla:
        return text
    slas = F.array_compact(
        F.array(
            *[
                F.when(F.col(s) > 0, F.lit(f"{s} in {policy.sla_days[s]} days"))
                for s in SLA_SEVERITIES
                if policy.sla_days.get(s) is not None
            ]
        )
    )
    return F.concat(
        text,
        F.when(F.size(slas) > 0, F.concat(F.lit(" Due: "), F.array_join(slas, ", "), F.lit("."))).otherwise(
            F.lit("")
        ),
    )


def report_summaries(
    findings: DataFrame, scores: DataFrame, policy: Policy = DEFAULT_POLICY, with_sla: bool = True
) -> DataFrame:
    """Score, grade, statistics and summary text, one row per audited repository."""
    stats = statistics(findings).drop("total_findings")
    joined = (
        overall_scores(scores, policy)
        .drop("total_findings")
        .join(worst_domains(scores), "repo")
        .join(stats, "repo", "left")
        .na.fill(0, SEVERITIES)
    )
    total = sum((F.col(s) for s in SEVERITIES[1:]), F.col(SEVERITIES[0]))
    return joined.withColumn("total_findings", total).withColumn("summary", summary_text(policy, with_sla))
