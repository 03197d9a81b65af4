"""Registered queries over findings: merge, diagnose, plan, compare, trend, report."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators import diagnose as D
from lintlake.operators import findings as FN
from lintlake.operators import report as R
from lintlake.operators import scoring as S
from lintlake.plans.merge import clean_findings, diagnose, merge_reports, score_cleaned
from lintlake.policy import DEFAULT_POLICY, KEEP_SEVERITY
from lintlake.sources import views as V

def _flat(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "repo", "seq", "id", "rule", "domain", "severity", "confidence",
        FN.primary_file().alias("file"), FN.primary_line().alias("line"), *extra,
    )


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return V.events_as_findings(spark, sf)


def findings_filtered(spark, sf):
    return _flat(FN.confidence_filter(raw(spark, sf)))


def findings_adjusted(spark, sf):
    return _flat(FN.adjust_confidence(FN.confidence_filter(raw(spark, sf))))


def _suppressions(spark, sf):
    """Each customer's repository suppresses something: a rule, a folder, or both."""
    c = V.table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("repo"), k.cast("string")).alias("repo"),
        F.when(k % 3 == 0, F.lit("magic-number")).when(k % 3 == 1, F.lit("*")).otherwise(F.lit("file-too-long")).alias("rule"),
        F.when(k % 2 == 0, F.lit("src/m1/")).when(k % 5 == 0, F.lit("package.json")).otherwise(F.lit("*")).alias("file"),
    ).where((F.col("rule") != "*") | (F.col("file") != "*"))


def findings_suppressed(spark, sf):
    return _flat(FN.apply_ignore_rules(raw(spark, sf), _suppressions(spark, sf)))


def findings_suppressed_everywhere(spark, sf):
    rules = [("magic-number", "src/m1/"), ("*", "__tests__"), ("hardcoded-secret", "*")]
    return _flat(FN.apply_ignore_rules(raw(spark, sf), rules))


def findings_rejected(spark, sf):
    """Rows of a damaged copy of the findings, with the reasons for their rejection."""
    n = F.col("seq")
    damaged = (
        raw(spark, sf)
        .withColumn("id", F.when(n % 5 == 0, F.lower("id")).otherwise(F.col("id")))
        .withColumn("severity", F.when(n % 7 == 0, F.lit("fatal")).otherwise(F.col("severity")))
        .withColumn("confidence", F.when(n % 11 == 0, F.col("confidence") + 1.5).otherwise(F.col("confidence")))
        .withColumn("title", F.when(n % 3 == 0, F.repeat("title", 12)).otherwise(F.col("title")))
    )
    _, bad = FN.validate_findings(damaged)
    return bad.select("repo", "seq", F.array_join("reasons", ",").alias("reasons"))


def finding_ids(spark, sf):
    numbered = FN.assign_ids(raw(spark, sf), "AUD", 101, order=["seq"])
    return numbered.select("repo", "seq", "id")


def _dedupe(spark, sf, **changes):
    policy = replace(DEFAULT_POLICY, **changes)
    return _flat(clean_findings(raw(spark, sf), policy))


def dedupe_location(spark, sf):
    return _dedupe(spark, sf)


def dedupe_file(spark, sf):
    return _dedupe(spark, sf, strategy="same-rule-same-file")


def dedupe_rule(spark, sf):
    return _dedupe(spark, sf, strategy="same-rule-any-location")


def dedupe_by_severity(spark, sf):
    return _dedupe(spark, sf, on_conflict=KEEP_SEVERITY)


def top10_per_repo(spark, sf):
    return _flat(FN.top_findings(clean_findings(raw(spark, sf)), 10), "rank")


def page_2(spark, sf):
    page, _ = FN.paginate(raw(spark, sf), 20, 20)
    return _flat(page)


def page_2_meta(spark, sf):
    return FN.paginate(raw(spark, sf), 20, 20)[1]


def stats_by_severity(spark, sf):
    return S.statistics(clean_findings(raw(spark, sf))).drop("by_domain")


def stats_by_domain(spark, sf):
    return S.statistics(clean_findings(raw(spark, sf))).select(
        "repo", F.explode("by_domain").alias("domain", "findings")
    )


def findings_by_severity(spark, sf):
    return FN.findings_by_severity(raw(spark, sf))


def domain_scores(spark, sf):
    return S.domain_scores(raw(spark, sf))


def domain_scores_audited(spark, sf):
    """Every repository is audited in all domains, so clean domains score 100."""
    f = raw(spark, sf)
    audited = f.select("repo").distinct().select("repo", F.explode(F.array(*[F.lit(d) for d in S.DOMAINS])).alias("domain"))
    return S.domain_scores(f, audited=audited)


def overall_scores(spark, sf):
    return score_cleaned(raw(spark, sf))


def merged_reports(spark, sf):
    return merge_reports(raw(spark, sf)).summaries.drop("by_domain")


def worst_domain(spark, sf):
    return S.worst_domains(S.domain_scores(raw(spark, sf)))


def _hotspots(spark, sf, kind=None):
    h = D.correlate(raw(spark, sf))
    if kind:
        h = h.where(F.col("type") == kind)
    return h.select(
        "repo", "type", "key", "label", "finding_count", "domain_count",
        F.array_join("domains", ",").alias("domains"), "severity_ceiling",
    )


def hotspots_file(spark, sf):
    return _hotspots(spark, sf, "file")


def hotspots_module(spark, sf):
    return _hotspots(spark, sf, "module")


def hotspots_dependency(spark, sf):
    return _hotspots(spark, sf, "dependency")


def hotspots_pattern(spark, sf):
    return _hotspots(spark, sf, "pattern")


def hotspots_all(spark, sf):
    return D.hotspot_counts(D.correlate(raw(spark, sf)))


def root_causes(spark, sf):
    return diagnose(raw(spark, sf)).inferred.select("repo", "type", "key", "category", "source", "confidence")


def root_cause_clusters(spark, sf):
    return diagnose(raw(spark, sf)).clusters.select(
        "repo", "category", "source", "confidence", "rationale", "hotspot_count", "finding_count",
        "domain_count", F.array_join("domains", ",").alias("domains"), "severity_ceiling",
    )


def prioritized_clusters(spark, sf):
    return diagnose(raw(spark, sf)).prioritized.select(
        "repo", "category", "impact_score", "effort", "batch", "score_delta"
    )


def remediation_plan(spark, sf):
    f = raw(spark, sf)
    return D.remediation_plan(diagnose(f).prioritized, S.overall_scores(S.domain_scores(f)))


def remediation_rows(spark, sf):
    f = raw(spark, sf)
    return R.remediation_rows(diagnose(f).prioritized, f)


def remediation_rows_estimated(spark, sf):
    return R.fallback_rows(clean_findings(raw(spark, sf)))


def projected_scores(spark, sf):
    return R.fallback_fix_now_score(merge_reports(raw(spark, sf)).summaries).select("repo", "projected_score")


def top_root_causes(spark, sf):
    f = raw(spark, sf)
    return R.top_root_causes(diagnose(f).prioritized, f).select(
        "repo", F.array_join("root_causes", ",").alias("root_causes")
    )


def first_actions(spark, sf):
    f = raw(spark, sf)
    return R.first_action(diagnose(f).prioritized, f, f)


def causal_arrows(spark, sf):
    return R.causal_arrows(diagnose(raw(spark, sf)).clusters)


def cluster_view(spark, sf):
    f = raw(spark, sf)
    d = diagnose(f)
    return R.cluster_view(d.clusters, D.contributing_ids(f, d.inferred))


def domain_breakdown(spark, sf):
    f = raw(spark, sf)
    return R.domain_breakdown(f, S.domain_scores(f))


def severity_bars(spark, sf):
    return R.severity_bars(raw(spark, sf))


def _run(spark, sf, run_no):
    return raw(spark, sf).where(F.col("run_no") == run_no)


def compare_domains(spark, sf):
    return R.compare_domains(S.domain_scores(_run(spark, sf, 2)), S.domain_scores(_run(spark, sf, 0)))


def compare_reports(spark, sf):
    a, b = _run(spark, sf, 2), _run(spark, sf, 0)
    return R.compare_reports(a, b, S.overall_scores(S.domain_scores(a)), S.overall_scores(S.domain_scores(b)))


def _diff(spark, sf, kind):
    return _flat(FN.diff_findings(_run(spark, sf, 2), _run(spark, sf, 0))[kind])


def diff_added(spark, sf):
    return _diff(spark, sf, "added")


def diff_removed(spark, sf):
    return _diff(spark, sf, "removed")


def diff_unchanged(spark, sf):
    return _diff(spark, sf, "unchanged")


def diff_by_fingerprint(spark, sf):
    """Added findings when identity is the content, not the id."""
    a = _run(spark, sf, 2).withColumn("fp", FN.fingerprint())
    b = _run(spark, sf, 0).withColumn("fp", FN.fingerprint())
    return _flat(FN.diff_findings(a, b, ["repo", "fp"])["added"])


def _entries(spark, sf):
    keys = ("repo", "run_date")
    scores = S.domain_scores(raw(spark, sf), keys=keys)
    return R.trend_entries(S.overall_scores(scores, keys=keys), scores, list(keys))


def trend_summary(spark, sf):
    return R.trend_summary(_entries(spark, sf))


def trend_history(spark, sf):
    return R.trend_history(_entries(spark, sf)).select(
        "repo", F.col("run_date").cast("string").alias("run_date"), "overall_score", "grade", "total_findings", "rank",
        F.element_at("domain_scores", "security").alias("security_score"),
    )


def sarif_results(spark, sf):
    r = R.sarif_results(raw(spark, sf))
    loc = F.col("result.locations")
    return r.select(
        "repo", "seq", F.col("result.ruleId").alias("rule_id"), F.col("result.level").alias("level"),
        F.col("result.message.text").alias("message"), F.size(loc).alias("locations"),
        loc[0]["physicalLocation"]["artifactLocation"]["uri"].alias("uri"),
        loc[0]["physicalLocation"]["region"]["startLine"].alias("start_line"),
    )


def sarif_rules(spark, sf):
    return R.sarif_rules(raw(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        findings_filtered, findings_adjusted, findings_suppressed, findings_suppressed_everywhere,
        findings_rejected, finding_ids, dedupe_location, dedupe_file, dedupe_rule, dedupe_by_severity,
        top10_per_repo, page_2, page_2_meta, stats_by_severity, stats_by_domain, findings_by_severity,
        domain_scores, domain_scores_audited, overall_scores, merged_reports, worst_domain,
        hotspots_file, hotspots_module, hotspots_dependency, hotspots_pattern, hotspots_all,
        root_causes, root_cause_clusters, prioritized_clusters, remediation_plan, remediation_rows,
        remediation_rows_estimated, projected_scores, top_root_causes, first_actions, causal_arrows,
        cluster_view, domain_breakdown, severity_bars, compare_domains, compare_reports, diff_added,
        diff_removed, diff_unchanged, diff_by_fingerprint, trend_summary, trend_history,
        sarif_results, sarif_rules,
    )
}
