"""Rule catalog: the domain and confidence of every built-in rule."""

from __future__ import annotations

# --- Fixed values: rule -> (domain, confidence) -------------------------------
RULES = {
    # secrets
    "no-hardcoded-secret": ("security", 0.9),
    "no-private-key": ("security", 0.95),
    "no-connection-string": ("security", 0.7),
    "no-hardcoded-secret-unquoted": ("security", 0.45),
    "no-env-file-committed": ("security", 0.9),
    # dependency manifests
    "excessive-maven-dependencies": ("security", 0.9),
    "no-snapshot-dependency": ("security", 0.95),
    "excessive-dependencies": ("architecture", 0.9),
    "potential-duplicate-deps": ("architecture", 0.5),
    "dependency-staleness-risk": ("tech-debt", 0.75),
    # web and framework security
    "no-permit-all": ("security", 0.95),
    "no-csrf-disable": ("security", 0.90),
    "no-commented-auth": ("security", 0.92),
    "no-cors-wildcard-credentials": ("security", 0.92),
    "cors-wildcard-origin": ("security", 0.85),
    "missing-valid-annotation": ("security", 0.88),
    "actuator-expose-all": ("security", 0.90),
    "error-info-leak": ("security", 0.90),
    "file-upload-no-validation": ("security", 0.85),
    # architecture and API design
    "no-layer-violation": ("architecture", 0.8),
    "no-circular-dependency": ("architecture", 0.95),
    "verb-based-resource-name": ("api-design", 0.90),
    "non-kebab-case-path": ("api-design", 0.85),
    "stateful-rest-controller": ("api-design", 0.90),
    "unpaginated-list-endpoint": ("api-design", 0.80),
    "missing-api-versioning": ("api-design", 0.85),
    # conventions
    "file-naming-convention": ("conventions", 0.6),
    "file-too-long": ("conventions", 1.0),
    "unresolved-todo": ("conventions", 1.0),
    "function-too-long": ("conventions", 0.9),
    "too-many-params": ("conventions", 0.9),
    "magic-number": ("conventions", 0.85),
    "dry-violation": ("conventions", 0.7),
    # tests
    "missing-test-file": ("tests", 0.7),
    "empty-assertion": ("tests", 0.75),
    "excessive-mocking": ("tests", 0.60),
    "excessive-assertions": ("tests", 0.75),
    "missing-test-slicing": ("tests", 0.70),
    "no-failing-test": ("tests", 1.0),
    "playwright-test-failure": ("tests", 1.0),
    "flaky-test": ("tests", 0.9),
    "low-lines-coverage": ("tests", 1.0),
    "low-branches-coverage": ("tests", 1.0),
    "low-functions-coverage": ("tests", 1.0),
    # performance
    "bundle-size-threshold": ("performance", 0.95),
    "large-built-asset": ("performance", 0.8),
    "build-time-average": ("performance", 0.9),
    "build-time-p95": ("performance", 0.85),
    "sync-fs-usage": ("performance", 0.8),
    "sync-process-usage": ("performance", 0.8),
    "potential-infinite-loop": ("performance", 0.8),
    "sync-http-in-controller": ("performance", 0.8),
    "sync-mail-in-controller": ("performance", 0.8),
    "runtime-exec-usage": ("performance", 0.8),
    # documentation
    "readme-required": ("documentation", 1.0),
    "readme-section-missing": ("documentation", 0.9),
    "readme-recommended-section-missing": ("documentation", 0.80),
    "adr-missing": ("documentation", 0.9),
    "doc-code-drift": ("documentation", 0.75),
    "env-example-stale-key": ("documentation", 0.65),
    # technical debt
    "high-complexity": ("tech-debt", 0.8),
    "aged-todo": ("tech-debt", 0.95),
    "dead-export": ("tech-debt", 0.8),
    "deprecated-api-usage": ("tech-debt", 0.9),
    "god-class": ("tech-debt", 0.85),
    "deep-nesting": ("tech-debt", 0.85),
    "jpa-data-on-entity": ("tech-debt", 0.95),
    "jpa-cascade-all-many-to-one": ("tech-debt", 0.90),
    "jpa-missing-version": ("tech-debt", 0.80),
    "jpa-missing-modifying": ("tech-debt", 0.90),
    "lazy-self-injection": ("tech-debt", 0.85),
    "jpa-no-migration-tool": ("tech-debt", 0.85),
    # accessibility
    "img-missing-alt": ("accessibility", 0.90),
    "interactive-no-accessible-name": ("accessibility", 0.85),
    "html-missing-lang": ("accessibility", 0.95),
    "input-missing-label": ("accessibility", 0.75),
    # observability
    "swallowed-exception": ("observability", 0.85),
    "missing-health-endpoint": ("observability", 0.80),
    "missing-tracing": ("observability", 0.80),
    # internationalisation
    "hardcoded-template-string": ("i18n", 0.75),
    "missing-i18n-library": ("i18n", 0.80),
    # visual consistency
    "hardcoded-color": ("ux-consistency", 0.85),
    "font-family-proliferation": ("ux-consistency", 0.85),
    "font-size-sprawl": ("ux-consistency", 0.80),
    "inline-style-proliferation": ("ux-consistency", 0.80),
    "magic-zindex": ("ux-consistency", 0.85),
    "shadow-sprawl": ("ux-consistency", 0.80),
    "inconsistent-durations": ("ux-consistency", 0.80),
    "breakpoint-inconsistency": ("ux-consistency", 0.80),
    "missing-reduced-motion": ("ux-consistency", 0.85),
    # external reports
    "no-vulnerable-dependency": ("security", 0.95),
}

#: Confidence of rules that external checkers name themselves.
EXTERNAL = {"semgrep": ("security", 0.9), "eslint": ("conventions", 1.0), "checkstyle": ("conventions", 1.0)}
CUSTOM_PATTERN = ("security", 0.8)
# -------------------------------------------------------------------------------


#: Prefix of finding ids in each domain (fixed values).
ID_PREFIX = {
    "security": "SEC",
    "tests": "TST",
    "architecture": "ARC",
    "conventions": "CNV",
    "performance": "PRF",
    "documentation": "DOC",
    "tech-debt": "DEBT",
    "accessibility": "ACC",
    "api-design": "API",
    "observability": "OBS",
    "i18n": "INT",
    "ux-consistency": "UX",
}

#: What to do about a finding of each domain, and how much work that usually is.
ADVICE = {
    "security": ("Close the hole, then look for the same mistake elsewhere.", "small"),
    "tests": ("Add or repair the test, and run it with every change.", "medium"),
    "architecture": ("Move the code to the layer it belongs to, or turn the dependency round.", "large"),
    "conventions": ("Bring the place in line with the conventions of the repository.", "trivial"),
    "performance": ("Take the slow call off the hot path and measure again.", "medium"),
    "documentation": ("Write down what a reader of the repository misses.", "small"),
    "tech-debt": ("Split or replace the code before it grows further.", "medium"),
    "accessibility": ("Give the element a name or text that assistive software can read.", "trivial"),
    "api-design": ("Rename or version the endpoint with its next release.", "small"),
    "observability": ("Log, count or trace what happens here.", "small"),
    "i18n": ("Move the text to the translation files.", "small"),
    "ux-consistency": ("Use the shared value of the style guide.", "trivial"),
}
