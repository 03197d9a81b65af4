"""Independent SQL for the evaluation queries: the greedy matching runs step by step."""

from __future__ import annotations

SEVERITY = "['critical','high','medium','low','info'][doc_id % 5 + 1]"
DOMAINS = (
    "['security','tests','architecture','conventions','performance','documentation','tech-debt',"
    "'accessibility','api-design','observability','i18n','ux-consistency']"
)
RUN = "fixture, tier, run"


def words(col: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({col}), '[^a-z0-9]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2))"


def similar(a: str, b: str) -> str:
    shared = f"len(list_intersect({words(a)}, {words(b)}))"
    return f"({shared} >= 0.4::DOUBLE * (len({words(a)}) + len({words(b)}) - {shared}) AND {shared} > 0)"


BASE = f"""
tr AS (SELECT d.lang AS fixture, d.doc_id AS ord, 'GT-' || d.doc_id AS id, {SEVERITY.replace("doc_id", "d.doc_id")} AS severity,
    {DOMAINS}[d.doc_id % 12 + 1] AS domain, 'low quality ' || d.lang || ' text in ' || d.source AS title, 'docs/d' || (d.doc_id // 4) || '.md' AS file,
    d.doc_id % 4 * 3 + 1 AS line, toxic = 0 AS tool_detectable, CASE WHEN d.source < 'src2' THEN 'RC-' || d.doc_id END AS root_cause
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 0),
rn AS (SELECT tier, run, (CASE WHEN tier = 'A' THEN 500 ELSE 1200 END) + run * 100 AS lim FROM (SELECT unnest(['A', 'B']) AS tier) CROSS JOIN (SELECT unnest([1, 2, 3]) AS run)),
pd AS (SELECT lang AS fixture, tier, run, doc_id AS ord, 'F-' || doc_id AS id, {DOMAINS}[(doc_id * 5) % 12 + 1] AS domain,
    CASE WHEN doc_id % 2 = 0 THEN 'short-text' ELSE 'few-lines' END AS rule, 'short ' || lang || ' text in ' || source AS title, n_chars
  FROM documents JOIN rn ON n_chars < lim),
pe AS (SELECT *, 'docs/d' || (ord // 4) || '.md' AS file, ord % 4 * 3 + 2 AS line FROM pd
  UNION ALL SELECT *, 'docs/d' || (ord // 8) || '.md', ord % 7 FROM pd WHERE ord % 6 = 0),
tn AS (SELECT *, row_number() OVER (PARTITION BY fixture ORDER BY ord) AS k FROM tr),
cand AS (SELECT p.fixture, p.tier, p.run, t.k, p.id, min(CASE WHEN abs(p.line - t.line) <= 5 THEN 1 WHEN p.domain = t.domain THEN 2 END) AS level, min(p.ord) AS ord
    FROM tn t JOIN pe p ON p.fixture = t.fixture AND p.file = t.file WHERE abs(p.line - t.line) <= 5 OR p.domain = t.domain GROUP BY ALL
  UNION ALL SELECT p.fixture, p.tier, p.run, t.k, p.id, 3, p.ord FROM tn t JOIN pd p ON p.fixture = t.fixture AND p.domain = t.domain
    WHERE {similar("t.title", "p.title")}),
go(fixture, tier, run, k, used, pick) AS (
  SELECT DISTINCT fixture, tier, run, 0::BIGINT, []::VARCHAR[], NULL::STRUCT(id VARCHAR, level INTEGER) FROM pd
  UNION ALL
  SELECT fixture, tier, run, k, CASE WHEN pick.id IS NULL THEN used ELSE list_append(used, pick.id) END, pick FROM (
    SELECT g.fixture, g.tier, g.run, g.k + 1 AS k, any_value(g.used) AS used,
      arg_min(struct_pack(id := c.id, level := c.level::INTEGER), c.level::BIGINT * 1000000000 + c.ord) FILTER (c.id IS NOT NULL AND NOT list_contains(g.used, c.id)) AS pick
    FROM go g JOIN tn t ON t.fixture = g.fixture AND t.k = g.k + 1
    LEFT JOIN cand c ON c.fixture = g.fixture AND c.tier = g.tier AND c.run = g.run AND c.k = g.k + 1
    GROUP BY g.fixture, g.tier, g.run, g.k)),
mt AS (SELECT g.fixture, g.tier, g.run, t.id AS truth_id, t.ord, t.severity, t.title, t.tool_detectable, t.root_cause, g.pick.id AS finding_id,
    CASE g.pick.level WHEN 1 THEN 'exact-file-line' WHEN 2 THEN 'same-file-rule' WHEN 3 THEN 'same-domain-rule' ELSE 'unmatched' END AS match_type
  FROM go g JOIN tn t ON t.fixture = g.fixture AND t.k = g.k WHERE g.k > 0)
"""

DEDUP = """
du AS (SELECT a.fixture, a.tier, a.run, count(DISTINCT a.ord || '-' || b.ord) AS pairs FROM pe a JOIN pe b
    ON a.fixture = b.fixture AND a.tier = b.tier AND a.run = b.run AND a.file = b.file AND a.ord < b.ord
    WHERE abs(a.line - b.line) <= 3 OR a.rule = b.rule GROUP BY ALL),
de AS (SELECT fixture, tier, run, n AS findings, coalesce(pairs, 0) AS duplicate_pairs,
    CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE 1 - coalesce(pairs, 0) / (n::DOUBLE * (n - 1) / 2) END AS dedup
  FROM (SELECT fixture, tier, run, count(*) AS n FROM pd GROUP BY ALL) LEFT JOIN du USING (fixture, tier, run))
"""

CAUSES = f"""
rc AS (SELECT fixture, root_cause AS cause, replace(title, 'low quality', 'decay of low') AS title, [id, 'GT-' || (ord + 1), 'GT-' || (ord + 4)] AS symptoms FROM tr WHERE root_cause IS NOT NULL),
runs AS (SELECT DISTINCT fixture, tier, run FROM mt),
sy AS (SELECT r.fixture, r.tier, r.run, c.cause, (SELECT count(*) FROM mt m WHERE m.fixture = r.fixture AND m.tier = r.tier AND m.run = r.run
      AND m.finding_id IS NOT NULL AND list_contains(c.symptoms, m.truth_id)) >= 2 AS by_symptom,
    EXISTS (SELECT 1 FROM pd p WHERE p.fixture = r.fixture AND p.tier = r.tier AND p.run = r.run AND {similar("p.title", "c.title")}) AS by_title
  FROM runs r JOIN rc c USING (fixture))
"""


def rate(cond: str) -> str:
    return f"(SELECT r.fixture, r.tier, r.run, count(s.cause) AS causes, count(*) FILTER ({cond}) AS hits FROM runs r LEFT JOIN sy s USING (fixture, tier, run) GROUP BY ALL)"


def r3(x: str) -> str:
    return f"floor(({x}) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE"


WEIGHT = "(CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 0 END)"
METRICS = f"""
mc AS (SELECT fixture, tier, run, count(*) AS issues, count(finding_id) AS tp, count(*) - count(finding_id) AS missed,
    count(*) FILTER (tool_detectable) AS tool, count(finding_id) FILTER (tool_detectable) AS tool_hit,
    count(*) FILTER (NOT tool_detectable) AS oth, count(finding_id) FILTER (NOT tool_detectable) AS oth_hit,
    sum({WEIGHT}) AS w, sum(CASE WHEN finding_id IS NOT NULL THEN {WEIGHT} ELSE 0 END) AS wh FROM mt GROUP BY ALL),
fp AS (SELECT fixture, tier, run, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM mt m WHERE m.fixture = p.fixture AND m.tier = p.tier AND m.run = p.run AND m.finding_id = p.id)) AS bad,
    sum(CASE WHEN tier = 'A' THEN n_chars END) AS tokens FROM pd p GROUP BY ALL),
me0 AS (SELECT mc.*, fp.n, fp.bad, fp.tokens, de.dedup, tp / n::DOUBLE AS p, tp / issues::DOUBLE AS r, CASE WHEN tool > 0 THEN tool_hit / tool::DOUBLE ELSE 0.0::DOUBLE END AS tr_,
    CASE WHEN oth > 0 THEN oth_hit / oth::DOUBLE ELSE 0.0::DOUBLE END AS or_, CASE WHEN w > 0 THEN wh / w::DOUBLE * 10 ELSE 0.0::DOUBLE END AS a,
    CASE WHEN causes > 0 THEN hits / causes::DOUBLE ELSE 1.0::DOUBLE END AS rch
  FROM mc JOIN fp USING (fixture, tier, run) JOIN de USING (fixture, tier, run) JOIN {rate("by_symptom OR by_title")} USING (fixture, tier, run)),
me AS (SELECT fixture, tier, run, n AS finding_count, tp AS true_positives, bad AS false_positives, missed AS missed_issues, {r3("p")} AS precision, {r3("r")} AS recall,
    {r3("tr_")} AS tool_recall, {r3("or_")} AS other_recall, {r3("a")} AS actionability, {r3("rch")} AS root_cause_hit_rate, {r3("dedup")} AS dedup_effectiveness,
    CAST(tokens AS BIGINT) AS token_count, n * 10 AS latency_ms, CASE WHEN tokens > 0 THEN {r3("p * r * a / ((tokens / 10000.0::DOUBLE) * greatest(1 - dedup, 0.01::DOUBLE))")} END AS diagnostic_value FROM me0)
"""
SHARES = ["precision", "recall", "tool_recall", "root_cause_hit_rate", "actionability", "dedup_effectiveness"]
AGGREGATE = (
    "ag AS (SELECT tier, fixture, count(*) AS runs, "
    + ", ".join(f"{r3(f'avg({n})')} AS {n}_mean, {r3(f'coalesce(stddev_samp({n}), 0)')} AS {n}_stddev" for n in SHARES)
    + f", CASE WHEN bool_and(diagnostic_value IS NOT NULL) THEN {r3('avg(diagnostic_value)')} END AS diagnostic_value_mean, "
    f"CASE WHEN bool_and(diagnostic_value IS NOT NULL) THEN {r3('coalesce(stddev_samp(diagnostic_value), 0)')} END AS diagnostic_value_stddev, "
    "avg(finding_count) AS mean_finding_count, CASE WHEN bool_and(token_count IS NOT NULL) THEN avg(token_count) END AS mean_token_count, "
    "CASE WHEN bool_and(latency_ms IS NOT NULL) THEN avg(latency_ms) END AS mean_latency_ms FROM me GROUP BY tier, fixture)"
)
FULL = ", ".join([BASE, DEDUP, CAUSES, METRICS])


def q(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes} {body}"


ORACLE = {
    "eval_matches": q(BASE, "SELECT fixture, tier, run, truth_id, finding_id, match_type FROM mt"),
    "eval_metrics": q(FULL, "SELECT * FROM me"),
    "eval_root_causes": q(
        ", ".join([BASE, CAUSES]),
        f"SELECT fixture, tier, run, causes, hits, {r3('CASE WHEN causes > 0 THEN hits / causes::DOUBLE ELSE 1.0::DOUBLE END')} AS root_cause_hit_rate FROM {rate('by_symptom')}",
    ),
    "eval_dedup": q(", ".join([BASE, DEDUP]), f"SELECT fixture, tier, run, findings, duplicate_pairs, {r3('dedup')} AS dedup_effectiveness FROM de"),
    "eval_aggregate": q(FULL + "," + AGGREGATE, "SELECT * FROM ag"),
    "eval_gates": q(
        FULL + "," + AGGREGATE,
        """SELECT tier, fixture, precision_mean >= 0.6 AS precision_ok, recall_mean >= 0.5 AS recall_ok,
           greatest(precision_stddev, recall_stddev) <= 0.15 AS variance_ok, actionability_mean >= 3.0 AS actionability_ok FROM ag""",
    ),
    "eval_missed": q(
        BASE,
        """SELECT fixture, tier, run, coalesce(root_cause, '(no root cause)') AS root_cause, truth_id, severity, title, tool_detectable
           FROM mt WHERE finding_id IS NULL""",
    ),
    "eval_missed_by_cause": q(
        BASE,
        """SELECT fixture, tier, run, coalesce(root_cause, '(no root cause)') AS root_cause, count(*) AS missed,
           count(*) FILTER (tool_detectable) AS tool_detectable FROM mt WHERE finding_id IS NULL GROUP BY ALL""",
    ),
    "similar_titles": q(
        """pl AS (SELECT DISTINCT p_brand, p_name || ' ' || p_type AS title_l FROM part), pr AS (SELECT DISTINCT p_brand, lower(p_type) || ' ' || p_name || ' item' AS title_r FROM part)""",
        f"SELECT p_brand, title_l, title_r FROM pl JOIN pr USING (p_brand) WHERE {similar('title_l', 'title_r')}",
    ),
}
