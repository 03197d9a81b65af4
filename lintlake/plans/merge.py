"""Compositions: from raw findings to the merged report, and on to diagnosis and plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from lintlake.operators import diagnose as D
from lintlake.operators import findings as FN
from lintlake.operators import scoring as S
from lintlake.policy import DEFAULT_POLICY, Policy
from lintlake.session import cut_lineage


@dataclass(frozen=True)
class MergedReport:
    """The tables of a merged report; each is keyed by ``repo``."""

    findings: DataFrame
    domain_scores: DataFrame
    summaries: DataFrame
    top_findings: DataFrame


@dataclass(frozen=True)
class Diagnosis:
    hotspots: DataFrame
    inferred: DataFrame
    clusters: DataFrame
    prioritized: DataFrame


def clean_findings(raw: DataFrame, policy: Policy = DEFAULT_POLICY, ignore=None) -> DataFrame:
    """Filter, adjust, suppress, de-duplicate - in this order."""
    kept = FN.adjust_confidence(FN.confidence_filter(raw, policy), policy)
    if ignore is not None:
        kept = FN.apply_ignore_rules(kept, ignore)
    return FN.deduplicate(kept, policy)


def merge_reports(
    raw: DataFrame, policy: Policy = DEFAULT_POLICY, ignore=None, domain_scores: DataFrame | None = None
) -> MergedReport:
    """Merge the findings of all domains.

    The overall score comes from the scores that the domain reports bring along
    (computed from the raw findings when none are given), while statistics and the
    top findings describe the cleaned findings.
    """
    scores = S.domain_scores(raw, policy) if domain_scores is None else domain_scores
    findings = clean_findings(raw, policy, ignore)
    return MergedReport(
        findings, scores, S.report_summaries(findings, scores, policy), FN.top_findings(findings)
    )


def score_cleaned(raw: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Score, grade and size per repository, from the cleaned findings."""
    return S.overall_scores(S.domain_scores(clean_findings(raw, policy), policy), policy)


def diagnose(raw: DataFrame, policy: Policy = DEFAULT_POLICY) -> Diagnosis:
    """Hotspots, causes, clusters and their priorities, from the raw findings.

    Clusters look at the hotspots along two keys. The hotspots are few next to the
    findings, so they are written once instead of being computed for each.
    """
    hotspots = cut_lineage(D.correlate(raw, policy))
    inferred = D.infer_root_causes(hotspots, policy)
    clusters = D.root_cause_clusters(inferred, policy)
    return Diagnosis(hotspots, inferred, clusters, D.prioritize(clusters, policy))
