"""Independent SQL for the findings queries, in the dialect of the checking engine."""

from __future__ import annotations

DOMAINS_SQL = (
    "['security','tests','architecture','conventions','performance','documentation','tech-debt',"
    "'accessibility','api-design','observability','i18n','ux-consistency']"
)
PREFIX_SQL = "['SEC','TST','ARC','CNV','PRF','DOC','DEBT','ACC','API','OBS','INT','UX']"


def sev(col: str = "severity") -> str:
    return f"(CASE {col} WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END)"


def sev_name(col: str) -> str:
    return f"(CASE {col} WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' ELSE 'info' END)"


WEIGHT = "(CASE severity WHEN 'critical' THEN 25.0 WHEN 'high' THEN 15.0 WHEN 'medium' THEN 8.0 WHEN 'low' THEN 3.0 ELSE 0.0 END)::DOUBLE"
PENALTY = f"CAST({WEIGHT} * confidence AS DECIMAL(18,6))"


def domain_weight(col: str, default: str) -> str:
    return (
        f"(CASE {col} WHEN 'security' THEN 0.24 WHEN 'tests' THEN 0.20 WHEN 'architecture' THEN 0.16 "
        "WHEN 'conventions' THEN 0.12 WHEN 'performance' THEN 0.10 WHEN 'documentation' THEN 0.08 "
        "WHEN 'tech-debt' THEN 0.10 WHEN 'accessibility' THEN 0.08 WHEN 'api-design' THEN 0.07 "
        f"WHEN 'observability' THEN 0.06 WHEN 'i18n' THEN 0.05 WHEN 'ux-consistency' THEN 0.06 ELSE {default} END)::DECIMAL(9,4)"
    )


def grade(col: str) -> str:
    return f"(CASE WHEN {col} >= 90 THEN 'A' WHEN {col} >= 75 THEN 'B' WHEN {col} >= 60 THEN 'C' WHEN {col} >= 40 THEN 'D' ELSE 'F' END)"


def capital(col: str) -> str:
    return f"array_to_string([upper(x[1]) || x[2:] for x in string_split({col}, '-')], ' ')"


FV = f"""
fv0 AS (
  SELECT event_id AS seq, 'repo' || user_id AS repo,
    CAST((event_id // 12 + user_id) % 12 AS INTEGER) + 1 AS di,
    CASE event_type WHEN 'view' THEN 'file-too-long' WHEN 'click' THEN 'excessive-file-length'
      WHEN 'error' THEN 'hardcoded-secret' WHEN 'signup' THEN 'no-hardcoded-secret' ELSE 'magic-number' END AS rule,
    CASE WHEN value >= 200 THEN 'critical' WHEN value >= 100 THEN 'high' WHEN value >= 40 THEN 'medium'
      WHEN value >= 10 THEN 'low' ELSE 'info' END AS severity,
    CAST((event_id * 37) % 101 AS DOUBLE) / 100 AS confidence,
    CASE WHEN event_id % 17 = 0 THEN 'package.json'
      WHEN event_id % 11 = 0 THEN 'src/__tests__/f' || (event_id % 4) || '.ts'
      ELSE 'src/m' || (event_id % 3) || '/f' || (event_id % 4) || '.ts' END AS file,
    CAST(event_id % 8 + 1 AS INTEGER) AS line,
    CASE WHEN event_id % 3 = 0 THEN props END AS snippet,
    event_id % 13 = 0 AS two, CAST(ts AS DATE) AS run_date,
    CAST(least((day(ts) - 1) // 10, 2) AS INTEGER) AS run_no
  FROM events),
fv AS (SELECT *, {DOMAINS_SQL}[di] AS domain, rule || ' in ' || file AS title,
    {PREFIX_SQL}[di] || '-' || lpad((seq % 100)::VARCHAR, 3, '0') AS id FROM fv0)
"""

FILTERED = "kept AS (SELECT * FROM fv WHERE confidence >= 0.2 AND confidence >= 0.3)"
ADJUSTED = """
adj AS (SELECT * REPLACE (greatest(0.0, least(1.0, confidence
    + (CASE WHEN snippet IS NOT NULL THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)
    + (CASE WHEN two THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)
    + (CASE WHEN two OR regexp_matches(file, '(?i)generated|vendor|dist|node_modules') THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END)
    + (CASE WHEN regexp_matches(file, '(?i)fixture|mock|stub|fake|__tests__|test-data') THEN -0.15::DOUBLE ELSE 0.0::DOUBLE END)
  )) AS confidence) FROM kept)
"""
ALIASED = """
ali AS (SELECT * REPLACE (CASE WHEN rule IN ('excessive-file-length', 'file-too-long') THEN 'excessive-file-length'
      WHEN rule IN ('hardcoded-secret', 'no-hardcoded-secret') THEN 'no-hardcoded-secret' ELSE rule END AS rule),
    CASE WHEN rule IN ('excessive-file-length', 'file-too-long') THEN 'conventions'
      WHEN rule IN ('hardcoded-secret', 'no-hardcoded-secret') THEN 'security' END AS keep_domain FROM adj)
"""
FLAT = "repo, seq, id, rule, domain, severity, confidence, file, line"


def dedup(keys: str = "file, line", by_severity: bool = False) -> str:
    part = ", ".join(x for x in ("repo, rule", keys) if x)
    first = f"{sev()} DESC, " if by_severity else ""
    return f"""
cf AS (SELECT * FROM ali QUALIFY row_number() OVER (PARTITION BY {part}
    ORDER BY (coalesce(domain = keep_domain, false))::INT DESC, {first}confidence DESC, seq) = 1)
"""


def clean(keys: str = "file, line", by_severity: bool = False) -> str:
    return ", ".join([FV, FILTERED, ADJUSTED, ALIASED, dedup(keys, by_severity)])


def scores(src: str, keys: str = "repo", name: str = "ds") -> str:
    return f"""{name} AS (SELECT {keys}, domain,
      CAST(greatest(floor(100.0::DOUBLE - sum({PENALTY})::DOUBLE + 0.5), 0) AS INTEGER) AS score,
      CAST(count(*) AS BIGINT) AS findings FROM {src} GROUP BY {keys}, domain)"""


def overall(src: str = "ds", keys: str = "repo", name: str = "os") -> str:
    w = domain_weight("domain", "0.1")
    return f"""{name}0 AS (SELECT {keys}, CAST(floor(sum(score * {w})::DOUBLE / sum({w})::DOUBLE + 0.5) AS INTEGER) AS overall_score,
      CAST(sum(findings) AS BIGINT) AS total_findings FROM {src} GROUP BY {keys}),
    {name} AS (SELECT *, {grade("overall_score")} AS grade FROM {name}0)"""


SEVERITY_COUNTS = ", ".join(
    f"CAST(count(*) FILTER (severity = '{s}') AS BIGINT) AS {s}" for s in ("critical", "high", "medium", "low", "info")
)

HOTSPOTS = f"""
mem AS (
  SELECT *, 'file' AS type, file AS key FROM fv
  UNION ALL SELECT *, 'module', regexp_replace(file, '/[^/]*$', '') FROM fv WHERE contains(file, '/')
  UNION ALL SELECT *, 'dependency', file FROM fv WHERE file LIKE '%package.json'
  UNION ALL SELECT *, 'pattern', rule FROM fv),
hsd AS (SELECT repo, type, key, domain, min(seq) AS first, sum({PENALTY}) AS pen, count(*) AS n FROM mem GROUP BY ALL),
hs0 AS (SELECT repo, type, key, count(*) AS finding_count, count(DISTINCT domain) AS domain_count,
    count(DISTINCT file) AS files, max({sev()}) AS sr, min(seq) AS first_seq FROM mem GROUP BY ALL),
hs1 AS (SELECT * FROM hs0 WHERE (type = 'file' AND finding_count >= 3 AND domain_count >= 2)
   OR (type = 'module' AND finding_count >= 5 AND files >= 2)
   OR (type = 'dependency' AND finding_count >= 2 AND domain_count >= 2)
   OR (type = 'pattern' AND finding_count >= 5 AND files >= 2)),
hs AS (SELECT h.*, d.domains, row_number() OVER (PARTITION BY h.repo ORDER BY sr DESC, finding_count DESC,
      CASE type WHEN 'file' THEN 0 WHEN 'module' THEN 1 WHEN 'dependency' THEN 2 ELSE 3 END, first_seq) AS pos
   FROM hs1 h JOIN (SELECT repo, type, key, list(domain ORDER BY first) AS domains FROM hsd GROUP BY ALL) d USING (repo, type, key))
"""

CAUSES = """
inf AS (SELECT *, CASE
    WHEN finding_count >= 2 AND list_contains(domains, 'security') THEN 'security-shortcut'
    WHEN type = 'dependency' THEN 'dependency-rot'
    WHEN type = 'module' AND finding_count >= 5 AND domain_count >= 2 THEN 'missing-abstraction'
    WHEN type = 'file' AND finding_count >= 6 AND domain_count >= 3 THEN 'god-module'
    WHEN list_contains(domains, 'architecture') THEN 'misaligned-architecture'
    WHEN list_contains(domains, 'documentation') THEN 'documentation-debt'
    ELSE 'isolated' END AS category FROM hs),
cause AS (SELECT *, CASE WHEN category = 'isolated' THEN 'llm' ELSE 'tool' END AS source,
   CAST(CASE category WHEN 'security-shortcut' THEN 0.9 WHEN 'dependency-rot' THEN 0.87 WHEN 'missing-abstraction' THEN 0.84
     WHEN 'god-module' THEN 0.86 WHEN 'misaligned-architecture' THEN 0.84 WHEN 'documentation-debt' THEN 0.82 ELSE 0.6 END AS DOUBLE) AS confidence,
   CASE category
     WHEN 'security-shortcut' THEN 'Security findings dominate the same hotspots, indicating shortcuts in threat controls.'
     WHEN 'dependency-rot' THEN 'Dependency manifests and related findings indicate stale or vulnerable dependency governance.'
     WHEN 'missing-abstraction' THEN 'Cross-domain hotspots in the same module suggest missing reusable abstractions.'
     WHEN 'god-module' THEN 'A single file accumulates too many findings across domains and should be split.'
     WHEN 'misaligned-architecture' THEN 'Architecture constraints are violated repeatedly across hotspots.'
     WHEN 'documentation-debt' THEN 'Documentation findings converge, indicating process debt around docs and ADRs.'
     ELSE 'No known cause fits this group of findings.' END AS rationale FROM inf)
"""

CLUSTERS = f"""
cdom AS (SELECT c.repo, c.category, d.domain, min(c.pos * 100 + list_position(c.domains, d.domain)) AS ord_at, sum(d.pen) AS pen
   FROM cause c JOIN hsd d USING (repo, type, key) GROUP BY ALL),
cl0 AS (SELECT repo, category, max(source = 'llm') AS has_llm, any_value(rationale) AS rationale, any_value(confidence) AS confidence,
   count(*) AS hotspot_count, CAST(sum(finding_count) AS BIGINT) AS finding_count, max(sr) AS sr, min(pos) AS pos FROM cause GROUP BY ALL),
cl1 AS (SELECT repo, category, list(domain ORDER BY ord_at) AS domains, count(*) AS domain_count,
   sum(pen * {domain_weight("domain", "0.05")}) AS wpen, sum({domain_weight("domain", "0.05")}) AS dw FROM cdom GROUP BY ALL),
cl AS (SELECT *, CASE WHEN has_llm THEN 'llm' ELSE 'tool' END AS source, {sev_name("sr")} AS severity_ceiling
   FROM cl0 JOIN cl1 USING (repo, category)),
pr0 AS (SELECT *, CASE WHEN finding_count <= 3 THEN 'trivial' WHEN finding_count <= 8 THEN 'small' WHEN finding_count <= 15 THEN 'medium'
     WHEN finding_count <= 30 THEN 'large' ELSE 'epic' END AS effort,
     greatest(0.0::DOUBLE, floor(wpen::DOUBLE / 1.32::DOUBLE * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE) AS score_delta FROM cl),
pr1 AS (SELECT *, CAST(greatest(0, least(100, floor((sr / 5.0::DOUBLE) * ((least(1.0::DOUBLE, finding_count / 20.0::DOUBLE) + least(1.0::DOUBLE, domain_count / 6.0::DOUBLE)) / 2.0::DOUBLE)
     * ((dw::DOUBLE / domain_count) / 0.24::DOUBLE) * 100.0::DOUBLE
     / (CASE effort WHEN 'trivial' THEN 1.0 WHEN 'small' THEN 1.5 WHEN 'medium' THEN 2.5 WHEN 'large' THEN 4.0 ELSE 6.0 END)::DOUBLE + 0.5))) AS INTEGER) AS impact_score FROM pr0),
pr AS (SELECT *, CASE WHEN severity_ceiling = 'critical' OR impact_score >= 50 THEN 'fix_now'
     WHEN severity_ceiling = 'high' OR impact_score >= 20 THEN 'next_sprint' ELSE 'backlog' END AS batch FROM pr1)
"""
BATCH_NO = "(CASE batch WHEN 'fix_now' THEN 0 WHEN 'next_sprint' THEN 1 ELSE 2 END)"
PLAN_ORDER = f"{BATCH_NO}, impact_score DESC, sr DESC, finding_count DESC, pos"
DIAGNOSIS = ", ".join([FV, HOTSPOTS, CAUSES, CLUSTERS])


def num(col: str) -> str:
    return f"regexp_replace(({col})::DOUBLE::DECIMAL(20,1)::VARCHAR, '\\.0$', '')"


def hint(domain: str) -> str:
    return (
        f"CASE WHEN batch = 'fix_now' THEN 'nothing' WHEN {domain} = 'security' THEN 'security work of the first batch' "
        "WHEN batch = 'backlog' THEN 'the first two batches' ELSE 'the first batch' END"
    )


FALLBACK = f"""
fb0 AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {sev()} DESC, confidence DESC, seq) AS rn FROM SRC),
fb AS (SELECT repo, CAST(rn AS INTEGER) AS row_no, CASE severity WHEN 'critical' THEN 'fix_now' WHEN 'high' THEN 'next_sprint' ELSE 'backlog' END AS batch,
   title AS label, severity, 'unknown' AS effort,
   CASE severity WHEN 'critical' THEN 90 WHEN 'high' THEN 70 WHEN 'medium' THEN 40 WHEN 'low' THEN 20 ELSE 10 END AS impact,
   CAST(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0.5 ELSE 0.2 END AS DOUBLE) AS score_delta, domain
   FROM fb0 WHERE rn <= 6)
"""
FALLBACK_COLS = f"repo, row_no, batch, label, severity, effort, impact, score_delta, {hint('domain')} AS dependencies"

PLAN = f"""
pl0 AS (SELECT repo, count(*) AS total_clusters, count(*) FILTER (batch = 'fix_now') AS fix_now_count,
   count(*) FILTER (batch = 'next_sprint') AS next_sprint_count, count(*) FILTER (batch = 'backlog') AS backlog_count,
   coalesce(sum(score_delta::DECIMAL(20,1)) FILTER (batch = 'fix_now'), 0) AS now, sum(score_delta::DECIMAL(20,1)) AS alld,
   arg_min(category, rk) FILTER (batch = 'fix_now') AS top_category
   FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {PLAN_ORDER}) AS rk FROM pr) GROUP BY repo),
pl AS (SELECT repo, overall_score AS current_score,
   greatest(0.0::DOUBLE, least(100.0::DOUBLE, floor((overall_score + now)::DOUBLE * 10 + 0.5) / 10)) AS score_after_fix_now,
   greatest(0.0::DOUBLE, least(100.0::DOUBLE, floor((overall_score + alld)::DOUBLE * 10 + 0.5) / 10)) AS score_after_all,
   total_clusters, fix_now_count, next_sprint_count, backlog_count, top_category FROM os JOIN pl0 USING (repo))
"""

STATS = "st AS (SELECT repo, count(*) AS total_findings, " + SEVERITY_COUNTS + " FROM cf GROUP BY repo)"
WORST = f"""
wd AS (SELECT repo, domain AS worst_domain, score AS worst_score FROM ds
   QUALIFY row_number() OVER (PARTITION BY repo ORDER BY score, list_position({DOMAINS_SQL}, domain)) = 1)
"""
SUMMARY = """
ms AS (SELECT os.repo, os.overall_score, os.grade, wd.worst_domain, wd.worst_score,
   coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(info, 0) AS info
   FROM os JOIN wd USING (repo) LEFT JOIN st USING (repo)),
mt AS (SELECT *, critical + high + medium + low + info AS total_findings,
   'Score ' || overall_score || ' of 100, grade ' || grade || '; found: '
   || CASE WHEN critical + high + medium + low + info = 0 THEN 'none' ELSE concat_ws(', ',
        CASE WHEN critical > 0 THEN critical || ' critical' END, CASE WHEN high > 0 THEN high || ' high' END,
        CASE WHEN medium > 0 THEN medium || ' medium' END, CASE WHEN low > 0 THEN low || ' low' END,
        CASE WHEN info > 0 THEN info || ' info' END) END || '.'
   || CASE WHEN worst_score < 70 THEN ' Weakest: ' || worst_domain || ' at ' || worst_score || '.' ELSE '' END
   || CASE WHEN critical + high + medium > 0 THEN ' Due: ' || concat_ws(', ', CASE WHEN critical > 0 THEN 'critical in 1 days' END,
        CASE WHEN high > 0 THEN 'high in 7 days' END, CASE WHEN medium > 0 THEN 'medium in 14 days' END) || '.' ELSE '' END AS summary FROM ms)
"""


def q(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


def hotspot_sql(kind: str) -> str:
    label = {
        "file": "'Crowded file ' || string_split(key, '/')[-1]",
        "module": "'Crowded folder ' || string_split(key, '/')[-1]",
        "dependency": "'Crowded manifest ' || string_split(key, '/')[-1]",
        "pattern": "'Repeated rule ' || key || ' (' || finding_count || ' times)'",
    }[kind]
    return q(
        FV + "," + HOTSPOTS,
        f"SELECT repo, type, key, {label} AS label, finding_count, domain_count, array_to_string(domains, ',') AS domains, "
        f"{sev_name('sr')} AS severity_ceiling FROM hs WHERE type = '{kind}'",
    )


def run(n: int, name: str) -> str:
    return f"{name} AS (SELECT * FROM fv WHERE run_no = {n})"


RUNS = ", ".join([FV, run(2, "ra"), run(0, "rb")])
RUN_SCORES = ", ".join([RUNS, scores("ra", name="da"), scores("rb", name="db")])
DIFF = {
    "added": "SELECT {c} FROM ra WHERE NOT EXISTS (SELECT 1 FROM rb WHERE rb.repo = ra.repo AND rb.id = ra.id)",
    "removed": "SELECT {c} FROM rb WHERE NOT EXISTS (SELECT 1 FROM ra WHERE rb.repo = ra.repo AND rb.id = ra.id)",
    "unchanged": "SELECT {c} FROM ra WHERE EXISTS (SELECT 1 FROM rb WHERE rb.repo = ra.repo AND rb.id = ra.id)",
}
ENTRIES = ", ".join([FV, scores("fv", "repo, run_date"), overall("ds", "repo, run_date")])

ORACLE = {
    "findings_filtered": q(FV + "," + FILTERED, f"SELECT {FLAT} FROM kept"),
    "findings_adjusted": q(", ".join([FV, FILTERED, ADJUSTED]), f"SELECT {FLAT} FROM adj"),
    "findings_suppressed": q(
        FV
        + """, sup AS (SELECT 'repo' || c_custkey AS repo,
            CASE WHEN c_custkey % 3 = 0 THEN 'magic-number' WHEN c_custkey % 3 = 1 THEN '*' ELSE 'file-too-long' END AS rule,
            CASE WHEN c_custkey % 2 = 0 THEN 'src/m1/' WHEN c_custkey % 5 = 0 THEN 'package.json' ELSE '*' END AS file FROM customer)""",
        f"""SELECT {FLAT} FROM fv WHERE NOT EXISTS (SELECT 1 FROM sup s WHERE s.repo = fv.repo AND NOT (s.rule = '*' AND s.file = '*')
            AND (s.rule = '*' OR s.rule = fv.rule)
            AND (s.file = '*' OR contains(fv.file, s.file) OR (fv.two AND contains('vendor/lib.js', s.file))))""",
    ),
    "findings_suppressed_everywhere": q(
        FV,
        f"SELECT {FLAT} FROM fv WHERE NOT (rule = 'magic-number' AND contains(file, 'src/m1/')) "
        "AND NOT contains(file, '__tests__') AND rule <> 'hardcoded-secret'",
    ),
    "findings_rejected": q(
        FV,
        """SELECT * FROM (SELECT repo, seq, concat_ws(',', CASE WHEN seq % 5 = 0 THEN 'id' END, CASE WHEN seq % 7 = 0 THEN 'severity' END,
            CASE WHEN seq % 3 = 0 AND length(title) * 12 > 200 THEN 'title' END,
            CASE WHEN seq % 11 = 0 AND confidence + 1.5 > 1 THEN 'confidence' END) AS reasons FROM fv) WHERE reasons <> ''""",
    ),
    "finding_ids": q(
        FV,
        """SELECT repo, seq, 'AUD-' || CASE WHEN n < 100 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS id
           FROM (SELECT repo, seq, 100 + row_number() OVER (PARTITION BY repo ORDER BY seq) AS n FROM fv)""",
    ),
    "dedupe_location": q(clean(), f"SELECT {FLAT} FROM cf"),
    "dedupe_file": q(clean("file"), f"SELECT {FLAT} FROM cf"),
    "dedupe_rule": q(clean(""), f"SELECT {FLAT} FROM cf"),
    "dedupe_by_severity": q(clean(by_severity=True), f"SELECT {FLAT} FROM cf"),
    "top10_per_repo": q(
        clean(),
        f"""SELECT * FROM (SELECT {FLAT}, CAST(row_number() OVER (PARTITION BY repo ORDER BY {sev()} DESC, confidence DESC, seq) AS INTEGER) AS rank
            FROM cf) WHERE rank <= 10""",
    ),
    "page_2": q(FV, f"SELECT {FLAT} FROM fv ORDER BY {sev()} DESC, confidence DESC, seq LIMIT 20 OFFSET 20"),
    "page_2_meta": q(
        FV,
        """SELECT count(*) AS total, greatest(least(count(*) - 20, 20), 0) AS count, count(*) > 40 AS has_more,
           CASE WHEN count(*) > 40 THEN 40 END AS next_offset FROM fv""",
    ),
    "stats_by_severity": q(clean() + "," + STATS, "SELECT * FROM st"),
    "stats_by_domain": q(clean(), "SELECT repo, domain, count(*) AS findings FROM cf GROUP BY ALL"),
    "findings_by_severity": q(
        FV, f"SELECT repo, severity, count(*) AS findings, min(seq) AS first_seq, {sev()} AS rank FROM fv GROUP BY ALL"
    ),
    "domain_scores": q(FV + "," + scores("fv"), "SELECT * FROM ds"),
    "domain_scores_audited": q(
        FV + "," + scores("fv"),
        f"""SELECT a.repo, a.domain, CAST(coalesce(score, 100) AS INTEGER) AS score, coalesce(findings, 0) AS findings
            FROM (SELECT DISTINCT repo, unnest({DOMAINS_SQL}) AS domain FROM fv) a LEFT JOIN ds USING (repo, domain)""",
    ),
    "overall_scores": q(", ".join([clean(), scores("cf"), overall()]), "SELECT repo, overall_score, total_findings, grade FROM os"),
    "merged_reports": q(", ".join([clean(), scores("fv"), overall(), WORST, STATS, SUMMARY]), "SELECT * FROM mt"),
    "worst_domain": q(", ".join([FV, scores("fv"), WORST]), "SELECT * FROM wd"),
    "hotspots_file": hotspot_sql("file"),
    "hotspots_module": hotspot_sql("module"),
    "hotspots_dependency": hotspot_sql("dependency"),
    "hotspots_pattern": hotspot_sql("pattern"),
    "hotspots_all": q(
        FV + "," + HOTSPOTS,
        "SELECT repo, count(*) AS total, "
        + ", ".join(f"count(*) FILTER (type = '{t}') AS {t}_hotspots" for t in ("file", "module", "dependency", "pattern"))
        + " FROM hs GROUP BY repo",
    ),
    "root_causes": q(", ".join([FV, HOTSPOTS, CAUSES]), "SELECT repo, type, key, category, source, confidence FROM cause"),
    "root_cause_clusters": q(
        DIAGNOSIS,
        """SELECT repo, category, source, confidence, rationale, hotspot_count, finding_count, domain_count,
           array_to_string(domains, ',') AS domains, severity_ceiling FROM cl""",
    ),
    "prioritized_clusters": q(DIAGNOSIS, "SELECT repo, category, impact_score, effort, batch, score_delta FROM pr"),
    "remediation_plan": q(
        ", ".join([DIAGNOSIS, scores("fv"), overall(), PLAN]),
        f"""SELECT *, CASE WHEN fix_now_count = 0 THEN 'Nothing urgent; the score is ' || {num("current_score")}
              || '; with every cluster solved it would be ' || {num("score_after_all")} || '.'
            ELSE fix_now_count || ' cluster' || CASE WHEN fix_now_count > 1 THEN 's' ELSE '' END
              || ' to solve first, above all ' || top_category || '. Score now '
              || {num("current_score")} || ', after these ' || {num("score_after_fix_now")} || ' ('
              || {num("floor((score_after_fix_now - current_score) * 10 + 0.5) / 10")} || ' more), with no cluster left '
              || {num("score_after_all")} || '.' END AS summary FROM pl""",
    ),
    "remediation_rows": q(
        ", ".join([DIAGNOSIS, FALLBACK.replace("SRC", "(SELECT * FROM fv WHERE repo NOT IN (SELECT repo FROM pr))")]),
        f"""SELECT repo, CAST(row_number() OVER (PARTITION BY repo ORDER BY {PLAN_ORDER}) AS INTEGER) AS row_no, batch,
            {capital("category")} AS label, severity_ceiling AS severity, effort, impact_score AS impact, score_delta,
            {hint("domains[1]")} AS dependencies FROM pr
            UNION ALL SELECT {FALLBACK_COLS} FROM fb""",
    ),
    "remediation_rows_estimated": q(clean() + "," + FALLBACK.replace("SRC", "cf"), f"SELECT {FALLBACK_COLS} FROM fb"),
    "projected_scores": q(
        ", ".join([clean(), scores("fv"), overall(), WORST, STATS, SUMMARY]),
        "SELECT repo, least(100.0::DOUBLE, floor((overall_score + critical * 4 + high * 2 + medium)::DOUBLE * 10 + 0.5) / 10) AS projected_score FROM ms",
    ),
    "top_root_causes": q(
        DIAGNOSIS
        + f""", u AS (SELECT repo, list(category ORDER BY rn) AS u FROM (SELECT repo, category, row_number() OVER (PARTITION BY repo ORDER BY {PLAN_ORDER}) AS rn
                FROM pr WHERE batch = 'fix_now') WHERE rn <= 3 GROUP BY repo),
            c AS (SELECT repo, list(category ORDER BY rn) AS c FROM (SELECT repo, category, row_number() OVER (PARTITION BY repo ORDER BY sr DESC, finding_count DESC, pos) AS rn
                FROM cl) WHERE rn <= 3 GROUP BY repo),
            t AS (SELECT repo, list(title ORDER BY rn) AS t FROM (SELECT repo, title, row_number() OVER (PARTITION BY repo ORDER BY {sev()} DESC, confidence DESC, seq) AS rn
                FROM fv) WHERE rn <= 3 GROUP BY repo)""",
        "SELECT repo, array_to_string(coalesce(u, c, t), ',') AS root_causes FROM t LEFT JOIN c USING (repo) LEFT JOIN u USING (repo)",
    ),
    "first_actions": q(
        DIAGNOSIS
        + f""", u AS (SELECT * FROM pr WHERE batch = 'fix_now' QUALIFY row_number() OVER (PARTITION BY repo ORDER BY {PLAN_ORDER}) = 1),
            t AS (SELECT * FROM fv QUALIFY row_number() OVER (PARTITION BY repo ORDER BY {sev()} DESC, confidence DESC, seq) = 1)""",
        f"""SELECT t.repo, coalesce('Solve ' || {capital("u.category")} || ' (' || u.effort || ' effort, about +' || {num("u.score_delta")}
            || ' points)', 'Look at ' || t.id || ' (' || t.title || ')') AS first_action FROM t LEFT JOIN u USING (repo)""",
    ),
    "causal_arrows": q(
        DIAGNOSIS,
        f"""SELECT * FROM (SELECT repo, CAST(row_number() OVER w AS INTEGER) AS step, {capital("category")} AS cause,
            {capital("lead(category) OVER w")} AS effect FROM cl WINDOW w AS (PARTITION BY repo ORDER BY sr DESC, finding_count DESC, pos))
            WHERE step <= 2 AND effect IS NOT NULL""",
    ),
    "cluster_view": q(
        DIAGNOSIS
        + """, ids AS (SELECT c.repo, c.category, m.id, min(c.pos * 1000000000 + m.seq) AS ord_at FROM cause c JOIN mem m USING (repo, type, key) GROUP BY ALL),
            con AS (SELECT repo, category, array_to_string(list(id ORDER BY ord_at)[1:4], ', ') AS contributing FROM ids GROUP BY ALL)""",
        f"""SELECT repo, {capital("category")} AS label, {capital("severity_ceiling")} AS severity, rationale,
            finding_count || ' findings, ' || hotspot_count || ' hotspots, ' || domain_count || ' domains' AS blast_radius, contributing
            FROM cl JOIN con USING (repo, category)""",
    ),
    "domain_breakdown": q(
        FV + "," + scores("fv"),
        """SELECT ds.repo, ds.domain, score, findings, critical, high, medium FROM ds JOIN (SELECT repo, domain,
             count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
             count(*) FILTER (severity = 'medium') AS medium FROM fv GROUP BY ALL) USING (repo, domain)""",
    ),
    "severity_bars": q(
        FV
        + """, s AS (SELECT r.repo, s.severity, count(f.seq) AS count FROM (SELECT DISTINCT repo FROM fv) r
             CROSS JOIN (SELECT unnest(['critical','high','medium','low','info']) AS severity) s
             LEFT JOIN fv f ON f.repo = r.repo AND f.severity = s.severity GROUP BY ALL)""",
        """SELECT repo, severity, count, CASE WHEN count = 0 THEN 0.0::DOUBLE ELSE greatest(8.0::DOUBLE,
             count::DOUBLE / greatest(max(count) OVER (PARTITION BY repo), 1)::DOUBLE * 100.0::DOUBLE) END AS percent FROM s""",
    ),
    "compare_domains": q(
        RUN_SCORES,
        """SELECT repo, domain, coalesce(a.score, 100) AS score_a, coalesce(a.findings, 0) AS findings_a, coalesce(b.score, 100) AS score_b,
           coalesce(b.findings, 0) AS findings_b, coalesce(a.score, 100) - coalesce(b.score, 100) AS delta
           FROM da a FULL JOIN db b USING (repo, domain)""",
    ),
    "compare_reports": q(
        ", ".join([RUN_SCORES, overall("da", name="oa"), overall("db", name="ob")]),
        """SELECT oa.repo, oa.overall_score AS score_a, oa.grade AS grade_a, oa.total_findings AS findings_a, ob.overall_score AS score_b,
             ob.grade AS grade_b, ob.total_findings AS findings_b, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed,
             coalesce(unchanged, 0) AS unchanged, oa.overall_score - ob.overall_score AS overall_delta
           FROM oa JOIN ob USING (repo)
           LEFT JOIN (SELECT repo, count(*) FILTER (NOT EXISTS (SELECT 1 FROM rb WHERE rb.repo = ra.repo AND rb.id = ra.id)) AS added,
               count(*) FILTER (EXISTS (SELECT 1 FROM rb WHERE rb.repo = ra.repo AND rb.id = ra.id)) AS unchanged FROM ra GROUP BY repo) x USING (repo)
           LEFT JOIN (SELECT repo, count(*) FILTER (NOT EXISTS (SELECT 1 FROM ra WHERE rb.repo = ra.repo AND rb.id = ra.id)) AS removed
               FROM rb GROUP BY repo) y USING (repo)""",
    ),
    **{f"diff_{k}": q(RUNS, v.format(c=FLAT)) for k, v in DIFF.items()},
    "diff_by_fingerprint": q(
        RUNS,
        f"""SELECT {FLAT} FROM ra WHERE NOT EXISTS (SELECT 1 FROM rb WHERE rb.repo = ra.repo AND rb.rule = ra.rule
            AND rb.file = ra.file AND coalesce(rb.snippet, '') = coalesce(ra.snippet, ''))""",
    ),
    "trend_summary": q(
        ENTRIES
        + """, r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY run_date DESC) AS rn FROM os),
             t AS (SELECT repo, count(*) AS entries, CAST(floor(sum(overall_score) / count(*)::DOUBLE + 0.5) AS INTEGER) AS average_score,
               max(overall_score) AS best_score, min(overall_score) AS worst_score, arg_max(overall_score, run_date) - arg_min(overall_score, run_date) AS score_change,
               arg_min(overall_score, run_date) AS f, avg(overall_score) FILTER (rn <= 3) AS rec FROM r GROUP BY repo)""",
        """SELECT repo, entries, average_score, best_score, worst_score, score_change, CASE WHEN entries < 2 THEN 'stable' WHEN rec - f > 3 THEN 'improving'
           WHEN f - rec > 3 THEN 'declining' ELSE 'stable' END AS direction FROM t""",
    ),
    "trend_history": q(
        ENTRIES,
        """SELECT repo, run_date::VARCHAR AS run_date, overall_score, grade, total_findings, rank, s.score AS security_score FROM
           (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY run_date DESC) AS INTEGER) AS rank FROM os) o
           LEFT JOIN (SELECT repo, run_date, score FROM ds WHERE domain = 'security') s USING (repo, run_date) WHERE rank <= 10""",
    ),
    "sarif_results": q(
        FV,
        """SELECT repo, seq, rule AS rule_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning'
           WHEN 'low' THEN 'note' ELSE 'none' END AS level, title AS message, CASE WHEN two THEN 2 ELSE 1 END AS locations, file AS uri, line AS start_line FROM fv""",
    ),
    "sarif_rules": q(
        FV,
        """SELECT repo, rule, arg_min(title, seq) AS title, arg_min(domain, seq) AS domain, min(seq) AS first_seq FROM fv GROUP BY repo, rule""",
    ),
}
