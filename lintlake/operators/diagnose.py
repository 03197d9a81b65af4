"""Hotspots, root-cause clusters and the remediation plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.scalars import basename, dirname, js_round, lookup, severity_of_rank, severity_rank
from lintlake.operators.findings import primary_file
from lintlake.operators.positions import first_k
from lintlake.operators.scoring import domain_weight, penalty
from lintlake.policy import DEFAULT_POLICY, Policy, RootCausePattern
from lintlake.schema import BATCHES, HOTSPOT_TYPES

# --- Fixed values: thresholds -------------------------------------------------
FILE_MIN_FINDINGS, FILE_MIN_DOMAINS = 3, 2
MODULE_MIN_FINDINGS, MODULE_MIN_FILES = 5, 2
DEPENDENCY_MIN_FINDINGS, DEPENDENCY_MIN_DOMAINS = 2, 2
PATTERN_MIN_FINDINGS, PATTERN_MIN_FILES = 5, 2
MANIFEST = r"(?i)(?:package\.json|pom\.xml|build\.gradle(?:\.kts)?|requirements\.txt|go\.mod|Cargo\.toml)$"
FALLBACK_CATEGORY = "isolated"
FALLBACK_CONFIDENCE = 0.6
FALLBACK_RATIONALE = "No known cause fits this group of findings."
DEFAULT_PATTERN_CONFIDENCE, MAX_PATTERN_CONFIDENCE = 0.8, 0.95
EFFORT_UP_TO = {3: "trivial", 8: "small", 15: "medium", 30: "large"}
LARGEST_EFFORT = "epic"
EFFORT_DIVISOR = {"trivial": 1.0, "small": 1.5, "medium": 2.5, "large": 4.0, "epic": 6.0}
FIX_NOW_IMPACT, NEXT_SPRINT_IMPACT = 50, 20
FULL_BLAST_FINDINGS, FULL_BLAST_DOMAINS = 20, 6
UNKNOWN_DOMAIN_WEIGHT = 0.05
CONTRIBUTING_IDS = 4
# ------------------------------------------------------------------------------

HOTSPOT_KEY = ["repo", "type", "key"]


def memberships() -> Column:
    """The hotspot groups a finding belongs to, as ``array<struct<type, key>>``."""
    file = primary_file("")
    folder = dirname(file)

    def member(kind: str, key: Column, cond: Column) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("type"), key.alias("key")))

    return F.array_compact(
        F.array(
            member("file", file, file != ""),
            member("module", folder, (file != "") & (folder != ".")),
            member("dependency", file, file.rlike(MANIFEST)),
            member("pattern", F.col("rule"), F.col("rule") != ""),
        )
    )


WORD_BITS = 62


def _rule_bits(policy: Policy) -> list[Column]:
    """Bit p of the words is set when the finding's rule is one of pattern p's rules; as many words as patterns need."""
    words = [F.lit(0).cast("bigint") for _ in range(0, max(1, len(policy.patterns)), WORD_BITS)]
    for i, p in enumerate(policy.patterns):
        if p.any_rules:
            bit = F.when(F.col("rule").isin(list(p.any_rules)), F.lit(1 << i % WORD_BITS)).otherwise(F.lit(0))
            words[i // WORD_BITS] = words[i // WORD_BITS] + bit
    return [w.alias(f"_bits{k}") for k, w in enumerate(words)]


def hotspot_stats(findings: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """One row per group, all four types in one pass.

    The first aggregation, per group and domain, combines on the map side and leaves
    at most one row per domain and group; a hot file, folder or rule is therefore
    small before it is brought together. File counts are only compared with two, so
    the least and greatest file are enough.
    """
    bits = _rule_bits(policy)
    words = [f"_bits{k}" for k in range(len(bits))]
    exploded = findings.select(
        "repo",
        F.explode(memberships()).alias("_m"),
        "domain",
        "seq",
        primary_file("").alias("_file"),
        severity_rank(F.col("severity")).alias("_sev"),
        penalty(policy).alias("_pen"),
        *bits,
    ).select("repo", "_m.type", "_m.key", "domain", "seq", "_file", "_sev", "_pen", *words)
    per_domain = exploded.groupBy(*HOTSPOT_KEY, "domain").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("seq").alias("_first"),
        F.min("_file").alias("_lo"),
        F.max("_file").alias("_hi"),
        F.max("_sev").alias("_sev"),
        F.sum("_pen").alias("_pen"),
        *[F.bit_or(w).alias(w) for w in words],
    )
    return per_domain.groupBy(*HOTSPOT_KEY).agg(
        F.sum("_n").alias("finding_count"),
        F.count(F.lit(1)).alias("domain_count"),
        F.array_sort(
            F.collect_list(F.struct(F.col("_first").alias("first"), "domain", F.col("_pen").alias("penalty")))
        ).alias("domain_stats"),
        F.max("_sev").alias("sev_rank"),
        F.min("_first").alias("first_seq"),
        (F.min("_lo") != F.max("_hi")).alias("several_files"),
        F.array(*[F.bit_or(w) for w in words]).alias("rule_bits"),
    )


def correlate(findings: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Hotspots of all four types that reach their thresholds."""
    kind, n, d = F.col("type"), F.col("finding_count"), F.col("domain_count")
    several = F.col("several_files")
    kept = hotspot_stats(findings, policy).where(
        ((kind == "file") & (n >= FILE_MIN_FINDINGS) & (d >= FILE_MIN_DOMAINS))
        | ((kind == "module") & (n >= MODULE_MIN_FINDINGS) & several)
        | ((kind == "dependency") & (n >= DEPENDENCY_MIN_FINDINGS) & (d >= DEPENDENCY_MIN_DOMAINS))
        | ((kind == "pattern") & (n >= PATTERN_MIN_FINDINGS) & several)
    )
    short = F.when(basename(F.col("key")) == "", F.col("key")).otherwise(basename(F.col("key")))
    label = (
        F.when(
            kind == "pattern",
            F.concat(F.lit("Repeated rule "), F.col("key"), F.lit(" ("), n.cast("string"), F.lit(" times)")),
        )
        .when(kind == "module", F.concat(F.lit("Crowded folder "), short))
        .when(kind == "dependency", F.concat(F.lit("Crowded manifest "), short))
        .otherwise(F.concat(F.lit("Crowded file "), short))
    )
    return kept.select(
        *HOTSPOT_KEY,
        label.alias("label"),
        "finding_count",
        "domain_count",
        F.transform("domain_stats", lambda s: s["domain"]).alias("domains"),
        severity_of_rank(F.col("sev_rank")).alias("severity_ceiling"),
        "sev_rank",
        "first_seq",
        "rule_bits",
        "domain_stats",
    )


def hotspots_of_type(findings: DataFrame, kind: str, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return correlate(findings, policy).where(F.col("type") == kind)


def hotspot_counts(hotspots: DataFrame) -> DataFrame:
    return hotspots.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(F.when(F.col("type") == t, 1)).alias(f"{t}_hotspots") for t in HOTSPOT_TYPES],
    )


def hotspot_position() -> Column:
    """Sort key of a hotspot in its repository: severity, size, type, first finding."""
    type_order = lookup(F.col("type"), {t: i for i, t in enumerate(HOTSPOT_TYPES)}, len(HOTSPOT_TYPES))
    return F.struct(
        (-F.col("sev_rank")).alias("s"),
        (-F.col("finding_count")).alias("n"),
        type_order.alias("t"),
        F.col("first_seq").alias("f"),
    )


def _pattern_matches(p: RootCausePattern, index: int) -> Column:
    cond = F.lit(True)
    if p.hotspot_types:
        cond = cond & F.col("type").isin(list(p.hotspot_types))
    if p.min_findings is not None:
        cond = cond & (F.col("finding_count") >= p.min_findings)
    if p.min_domains is not None:
        cond = cond & (F.col("domain_count") >= p.min_domains)
    if p.any_domains:
        cond = cond & F.arrays_overlap("domains", F.array(*[F.lit(x) for x in p.any_domains]))
    if p.any_rules:
        cond = cond & (F.get("rule_bits", F.lit(index // WORD_BITS)).bitwiseAND(F.lit(1 << index % WORD_BITS)) != 0)
    return cond


def infer_root_causes(hotspots: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """First matching pattern of each hotspot, as one CASE over the ordered patterns."""

    def outcome(category, source, confidence, rationale) -> Column:
        return F.struct(
            F.lit(category).alias("category"),
            F.lit(source).alias("source"),
            F.lit(float(confidence)).alias("confidence"),
            F.lit(rationale).alias("rationale"),
        )

    cause = outcome(FALLBACK_CATEGORY, "llm", FALLBACK_CONFIDENCE, FALLBACK_RATIONALE)
    for i, p in reversed(list(enumerate(policy.patterns))):
        confidence = min(
            MAX_PATTERN_CONFIDENCE, DEFAULT_PATTERN_CONFIDENCE if p.confidence is None else p.confidence
        )
        rationale = p.rationale or f"Fits the pattern of {p.category}."
        cause = F.when(_pattern_matches(p, i), outcome(p.category, "tool", confidence, rationale)).otherwise(cause)
    return hotspots.withColumn("_cause", cause).select("*", "_cause.*").drop("_cause")


def root_cause_clusters(inferred: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """One row per repository and category, with the severity and domains it covers."""
    hs = inferred.withColumn("_pos", hotspot_position())
    per_rationale = hs.groupBy("repo", "category", "rationale").agg(
        F.count(F.lit(1)).alias("_h"),
        F.sum("finding_count").alias("_n"),
        F.max("sev_rank").alias("_sev"),
        F.sum(F.col("confidence").cast("decimal(10,6)")).alias("_conf"),
        F.max((F.col("source") == "llm").cast("int")).alias("_llm"),
        F.min("_pos").alias("_pos"),
    )
    head = per_rationale.groupBy("repo", "category").agg(
        F.sum("_h").alias("hotspot_count"),
        F.sum("_n").alias("finding_count"),
        F.max("_sev").alias("sev_rank"),
        F.sum("_conf").alias("_conf"),
        F.max("_llm").alias("_llm"),
        F.min("_pos").alias("position"),
        F.min_by("rationale", F.struct((-F.col("_h")).alias("h"), F.col("_pos"))).alias("rationale"),
    )
    w = domain_weight(F.col("domain"), policy, UNKNOWN_DOMAIN_WEIGHT)
    per_domain = (
        hs.select("repo", "category", "_pos", F.posexplode("domain_stats").alias("_i", "_d"))
        .groupBy("repo", "category", F.col("_d.domain").alias("domain"))
        .agg(F.min(F.struct("_pos", "_i")).alias("_at"), F.sum("_d.penalty").alias("_pen"))
    )
    tail = per_domain.groupBy("repo", "category").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "domain"))), lambda s: s["domain"]).alias("domains"),
        F.sum(F.col("_pen").cast("decimal(24,6)") * w).alias("weighted_penalty"),
        F.sum(w).alias("domain_weight_sum"),
    )
    confidence = js_round(F.col("_conf").cast("double") / F.col("hotspot_count"), 2)
    return head.join(tail, ["repo", "category"]).select(
        "repo",
        "category",
        F.when(F.col("_llm") == 1, F.lit("llm")).otherwise(F.lit("tool")).alias("source"),
        confidence.alias("confidence"),
        "rationale",
        "hotspot_count",
        "finding_count",
        F.size("domains").cast("bigint").alias("domain_count"),
        "domains",
        severity_of_rank(F.col("sev_rank")).alias("severity_ceiling"),
        "sev_rank",
        "position",
        "weighted_penalty",
        "domain_weight_sum",
    )


def cluster_order() -> list[Column]:
    return [F.col("sev_rank").desc(), F.col("finding_count").desc(), F.col("position").asc()]


# -- prioritisation -------------------------------------------------------------


def estimate_effort(count: Column) -> Column:
    effort = F.lit(LARGEST_EFFORT)
    for limit in sorted(EFFORT_UP_TO, reverse=True):
        effort = F.when(count <= limit, F.lit(EFFORT_UP_TO[limit])).otherwise(effort)
    return effort


def impact_score(policy: Policy = DEFAULT_POLICY) -> Column:
    """0..100 from severity, blast radius and domain leverage, divided by the effort."""
    severity = F.col("sev_rank") / F.lit(5.0)
    blast = (
        F.least(F.lit(1.0), F.col("finding_count") / F.lit(float(FULL_BLAST_FINDINGS)))
        + F.least(F.lit(1.0), F.col("domain_count") / F.lit(float(FULL_BLAST_DOMAINS)))
    ) / F.lit(2.0)
    mean_weight = F.col("domain_weight_sum").cast("double") / F.greatest(F.col("domain_count"), F.lit(1))
    leverage = mean_weight / F.lit(float(max(policy.domain_weights.values())))
    raw = severity * blast * leverage * F.lit(100.0) / lookup(F.col("effort"), EFFORT_DIVISOR, 6.0)
    return F.greatest(F.lit(0), F.least(F.lit(100), js_round(raw))).cast("int")


def assign_batch(severity: Column, impact: Column) -> Column:
    return (
        F.when((severity == "critical") | (impact >= FIX_NOW_IMPACT), F.lit("fix_now"))
        .when((severity == "high") | (impact >= NEXT_SPRINT_IMPACT), F.lit("next_sprint"))
        .otherwise(F.lit("backlog"))
    )


def prioritize(clusters: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    total_weight = round(sum(policy.domain_weights.values()), 6)
    delta = js_round(F.col("weighted_penalty").cast("double") / F.lit(float(total_weight)), 1)
    return (
        clusters.withColumn("effort", estimate_effort(F.col("finding_count")))
        .withColumn("impact_score", impact_score(policy))
        .withColumn("batch", assign_batch(F.col("severity_ceiling"), F.col("impact_score")))
        .withColumn("score_delta", F.greatest(F.lit(0.0), delta))
    )


def batch_order(batch: Column) -> Column:
    return lookup(batch, {b: i for i, b in enumerate(BATCHES)}, len(BATCHES))


def plan_order() -> list[Column]:
    return [batch_order(F.col("batch")), F.col("impact_score").desc(), *cluster_order()]


def number_text(col: Column) -> Column:
    """A number the way a report prints it: without a trailing ``.0``."""
    return F.regexp_replace(col.cast("double").cast("decimal(20,1)").cast("string"), r"\.0$", "")


def remediation_plan(prioritized: DataFrame, overall: DataFrame) -> DataFrame:
    """Per repository: projected scores, batch sizes and a summary sentence.

    ``overall(repo, overall_score)`` gives the current score.
    """
    delta = F.col("score_delta").cast("decimal(20,1)")
    fix_now = F.col("batch") == "fix_now"
    lead = F.struct(
        (-F.col("impact_score")).alias("i"), (-F.col("sev_rank")).alias("s"), (-F.col("finding_count")).alias("n"),
        F.col("position").alias("p"),
    )
    totals = prioritized.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_clusters"),
        *[F.count(F.when(F.col("batch") == b, 1)).alias(f"{b}_count") for b in BATCHES],
        F.coalesce(F.sum(F.when(fix_now, delta)), F.lit(0)).alias("_now"),
        F.sum(delta).alias("_all"),
        F.min_by("category", F.when(fix_now, lead)).alias("top_category"),
    )
    current = F.col("overall_score")

    def clamp(col: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), js_round((current + col).cast("double"), 1)))

    plan = overall.select("repo", "overall_score").join(totals, "repo").select(
        "repo",
        current.alias("current_score"),
        clamp(F.col("_now")).alias("score_after_fix_now"),
        clamp(F.col("_all")).alias("score_after_all"),
        "total_clusters",
        *[f"{b}_count" for b in BATCHES],
        "top_category",
    )
    n = F.col("fix_now_count")
    now, after = F.col("score_after_fix_now"), F.col("score_after_all")
    gain = js_round(now - F.col("current_score"), 1)
    quiet = F.concat(
        F.lit("Nothing urgent; the score is "), number_text(F.col("current_score")),
        F.lit("; with every cluster solved it would be "), number_text(after), F.lit("."),
    )
    urgent = F.concat(
        n.cast("string"), F.lit(" cluster"), F.when(n > 1, F.lit("s")).otherwise(F.lit("")),
        F.lit(" to solve first, above all "), F.col("top_category"),
        F.lit(". Score now "), number_text(F.col("current_score")),
        F.lit(", after these "), number_text(now), F.lit(" ("), number_text(gain),
        F.lit(" more), with no cluster left "), number_text(after), F.lit("."),
    )
    return plan.withColumn("summary", F.when(n == 0, quiet).otherwise(urgent))


def contributing_ids(findings: DataFrame, inferred: DataFrame, k: int = CONTRIBUTING_IDS) -> DataFrame:
    """First ``k`` distinct finding ids of each cluster, in hotspot and finding order.

    The first ``k`` ids of each hotspot always include the first ``k`` new ones, so
    groups are cut before they are brought together.
    """
    members = findings.select("repo", F.explode(memberships()).alias("_m"), "id", "seq").select(
        "repo", "_m.type", "_m.key", "id", "seq"
    )
    firsts = members.groupBy(*HOTSPOT_KEY, "id").agg(F.min("seq").alias("seq"))
    firsts = first_k(firsts, HOTSPOT_KEY, ["seq"], k).drop("_rank")
    placed = inferred.select(*HOTSPOT_KEY, "category", hotspot_position().alias("_pos"))
    per_id = (
        placed.join(firsts, HOTSPOT_KEY)
        .groupBy("repo", "category", "id")
        .agg(F.min(F.struct("_pos", "seq")).alias("_at"))
    )
    top = first_k(per_id, ["repo", "category"], ["_at"], k)
    return top.groupBy("repo", "category").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "id"))), lambda s: s["id"]).alias("contributing")
    )
