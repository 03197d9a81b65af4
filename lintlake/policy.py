"""Audit policies: defaults, and reading overrides from a JSON document.

A policy is configuration of a few hundred bytes. It is compiled into literal
expressions (CASE, IN, small literal maps), so no policy lookup needs a join.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession

MAX_POLICY_BYTES = 1 << 20


@dataclass(frozen=True)
class Alias:
    rules: tuple[str, ...]
    canonical: str
    keep_domain: str | None = None


@dataclass(frozen=True)
class RootCausePattern:
    category: str
    confidence: float | None = None
    rationale: str | None = None
    hotspot_types: tuple[str, ...] = ()
    min_findings: int | None = None
    min_domains: int | None = None
    any_domains: tuple[str, ...] = ()
    any_rules: tuple[str, ...] = ()


# --- Fixed values: default policies -----------------------------------------
SEVERITY_WEIGHTS = {"critical": 25, "high": 15, "medium": 8, "low": 3, "info": 0}

DOMAIN_WEIGHTS = {
    "security": 0.24,
    "tests": 0.20,
    "architecture": 0.16,
    "conventions": 0.12,
    "performance": 0.10,
    "documentation": 0.08,
    "tech-debt": 0.10,
    "accessibility": 0.08,
    "api-design": 0.07,
    "observability": 0.06,
    "i18n": 0.05,
    "ux-consistency": 0.06,
}

GRADE_THRESHOLDS = {"A": 90, "B": 75, "C": 60, "D": 40, "F": 0}

CONFIDENCE_ADJUSTMENTS = (
    ("evidence_has_snippet", 0.05),
    ("multiple_evidence_locations", 0.10),
    ("evidence_in_generated_code", -0.20),
    ("evidence_in_test_fixtures", -0.15),
)

ALIASES = (
    Alias(("excessive-file-length", "file-too-long"), "excessive-file-length", "conventions"),
    Alias(("missing-unit-test", "untested-source-file"), "missing-unit-test", "tests"),
    Alias(("unresolved-todo", "aged-todo"), "aged-todo", "tech-debt"),
    Alias(("hardcoded-secret", "no-hardcoded-secret"), "no-hardcoded-secret", "security"),
)

SLA_DAYS = {"critical": 1, "high": 7, "medium": 14, "low": 30, "info": None}

ROOT_CAUSE_PATTERNS = (
    RootCausePattern(
        "security-shortcut",
        0.9,
        "Security findings dominate the same hotspots, indicating shortcuts in threat controls.",
        min_findings=2,
        any_domains=("security",),
    ),
    RootCausePattern(
        "test-gap",
        0.88,
        "Hotspots are clustered around missing or weak tests rather than isolated defects.",
        any_domains=("tests",),
        any_rules=("missing-test-file", "missing-error-path-tests", "shallow-assertions"),
    ),
    RootCausePattern(
        "convention-drift",
        0.85,
        "Repeated naming/style violations indicate a drifting code convention baseline.",
        any_domains=("conventions",),
        any_rules=("non-kebab-case-path", "naming-convention", "function-too-long", "too-many-params"),
    ),
    RootCausePattern(
        "dependency-rot",
        0.87,
        "Dependency manifests and related findings indicate stale or vulnerable dependency governance.",
        hotspot_types=("dependency",),
    ),
    RootCausePattern(
        "missing-abstraction",
        0.84,
        "Cross-domain hotspots in the same module suggest missing reusable abstractions.",
        hotspot_types=("module",),
        min_findings=5,
        min_domains=2,
    ),
    RootCausePattern(
        "god-module",
        0.86,
        "A single file accumulates too many findings across domains and should be split.",
        hotspot_types=("file",),
        min_findings=6,
        min_domains=3,
    ),
    RootCausePattern(
        "misaligned-architecture",
        0.84,
        "Architecture constraints are violated repeatedly across hotspots.",
        any_domains=("architecture",),
    ),
    RootCausePattern(
        "documentation-debt",
        0.82,
        "Documentation findings converge, indicating process debt around docs and ADRs.",
        any_domains=("documentation",),
    ),
)

DEDUP_STRATEGIES = ("same-rule-same-location", "same-rule-same-file", "same-rule-any-location")
KEEP_CONFIDENCE = "keep highest confidence"
KEEP_SEVERITY = "keep highest severity"

COVERAGE_TARGETS = {"lines": 80.0, "branches": 70.0, "functions": 75.0}
FILE_LENGTHS = (400, 800)
FUNCTION_LENGTHS = (30, 60)
PARAM_COUNTS = (3, 5)
COMPLEXITY_THRESHOLD = 35
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Policy:
    severity_weights: dict = field(default_factory=lambda: dict(SEVERITY_WEIGHTS))
    domain_weights: dict = field(default_factory=lambda: dict(DOMAIN_WEIGHTS))
    grades: dict = field(default_factory=lambda: dict(GRADE_THRESHOLDS))
    minimum_for_report: float = 0.3
    auto_dismiss_below: float = 0.2
    adjustments: tuple = CONFIDENCE_ADJUSTMENTS
    aliases: tuple = ALIASES
    strategy: str = DEDUP_STRATEGIES[0]
    on_conflict: str = KEEP_CONFIDENCE
    sla_days: dict = field(default_factory=lambda: dict(SLA_DAYS))
    patterns: tuple = ROOT_CAUSE_PATTERNS
    coverage_targets: dict = field(default_factory=lambda: dict(COVERAGE_TARGETS))
    file_lengths: tuple = FILE_LENGTHS
    function_lengths: tuple = FUNCTION_LENGTHS
    param_counts: tuple = PARAM_COUNTS
    complexity_threshold: int = COMPLEXITY_THRESHOLD
    layers: tuple = ()
    allowed_dependencies: dict | None = None
    custom_patterns: tuple = ()
    naming_suffixes: tuple = ()


DEFAULT_POLICY = Policy()


def policy_from_dict(raw: dict) -> Policy:
    """Overlay the given settings on the defaults; unknown settings are rejected."""
    known = {f.name for f in fields(Policy)}
    unknown = set(raw) - known
    if unknown:
        raise ValueError(f"unknown policy settings: {sorted(unknown)}")
    values = dict(raw)
    if "aliases" in values:
        values["aliases"] = tuple(
            Alias(tuple(a["rules"]), a["canonical"], a.get("keep_domain")) for a in values["aliases"]
        )
    if "patterns" in values:
        values["patterns"] = tuple(
            RootCausePattern(**{k: tuple(v) if isinstance(v, list) else v for k, v in p.items()})
            for p in values["patterns"]
        )
    for name in ("adjustments", "custom_patterns", "naming_suffixes"):
        if name in values:
            values[name] = tuple(tuple(v) for v in values[name])
    for name in ("file_lengths", "function_lengths", "param_counts", "layers"):
        if name in values:
            values[name] = tuple(values[name])
    if values.get("strategy", DEDUP_STRATEGIES[0]) not in DEDUP_STRATEGIES:
        raise ValueError(f"unknown dedup strategy {values['strategy']!r}")
    return Policy(**values)


def load_policy(spark: SparkSession, path: str) -> Policy:
    """Read one JSON policy document; built-in defaults fill what it leaves out."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1 or len(rows[0].value) > MAX_POLICY_BYTES:
        raise ValueError("a policy is one JSON document of at most 1 MiB")
    return policy_from_dict(json.loads(rows[0].value))
