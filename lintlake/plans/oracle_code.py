"""Independent SQL for the queries over files, in the dialect of the checking engine.

The pseudo files are made of known lines, so most checks name the kind of line (``n``)
that a rule reacts to instead of repeating its pattern.
"""

from __future__ import annotations

SPLIT = "(SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"
KIND = "CAST((doc_id * 31 + line_no * 5) % 14 AS INTEGER) AS n"


def view(name: str, repo: str, path: str, templates: list[str]) -> str:
    items = ", ".join(templates)
    return f"""{name}0 AS (SELECT doc_id, line_no, {KIND} FROM {SPLIT}),
{name} AS (SELECT doc_id, '{repo}' || (doc_id % 10) AS repo, {path} AS path, CAST(line_no AS INTEGER) AS line_no, n,
   [{items}][n + 1] AS line FROM {name}0)"""


CL = view(
    "cl",
    "repo",
    "'src/' || ['controllers','services','models','repositories'][doc_id % 4 + 1] || '/file' || doc_id || '.ts'",
    [
        "'export function fn' || doc_id || '(a, b, c, d) {'",
        "'  if (ready && open) {'",
        "'  for (const x of xs) {'",
        "'}'",
        "'// TODO 2023-05-01: tidy up'",
        "'// FIXME later'",
        "'import { fn' || ((doc_id * 7) % 50) || ' } from ''../services/file' || ((doc_id * 7) % 50) || ''';'",
        "'const data = readFileSync(path);'",
        "'while (true) { step(); }'",
        "'total += ' || (doc_id % 97 + 3) || ' * rate;'",
        "'} catch (err) { }'",
        "'const apiToken = \"tok_' || (doc_id % 9) || 'abcdef0123456789abcdef\";'",
        "'router.get(''/api/getUsers'', handler);'",
        "'new Buffer(16);'",
    ],
)
JL = view(
    "jl",
    "shop",
    "'src/main/java/com/shop/' || ['controller','service','model','repository'][doc_id % 4 + 1] || '/File' || doc_id || '.java'",
    [
        "'public class File' || doc_id || ' { @RestController class Web { @Data @Entity class Row {'",
        "'  http.csrf().disable().authorizeRequests().anyRequest().permitAll();'",
        "'  config.addAllowedOrigin(\"*\");'",
        "'  // @PreAuthorize(\"hasRole(''ADMIN'')\")'",
        "'  public Order create(@RequestBody OrderDto dto) {'",
        "'  @ExceptionHandler(Exception.class)'",
        "'    return ResponseEntity.badRequest().body(e.getMessage()); }'",
        "'  @ManyToOne(cascade = CascadeType.ALL)'",
        "'  @Query(\"UPDATE Order o SET o.done = true\")'",
        "'import com.shop.model.File' || ((doc_id * 7) % 50) || ';'",
        "'  public List<Order> findAll() { return restTemplate.getForObject(url, List.class); }'",
        "'  String upload(@RequestParam MultipartFile file, HttpSession session) {'",
        "'  config.setAllowCredentials(true); }}}'",
        "'  @GetMapping(\"/api/v1/order_items\")'",
    ],
)
SL = view(
    "sl",
    "site",
    "'styles/s' || doc_id || '.css'",
    [
        "'.a { color: #' || lpad(((doc_id * 37) % 1000)::VARCHAR, 3, '0') || '; }'",
        "'.b { color: #ffffff; background: #000; }'",
        "'.c { color: rgb(1, 2, ' || ((doc_id + line_no) % 9) || '); }'",
        "'  --main-color: #' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || ';'",
        "'.d { font-family: Face' || ((doc_id + line_no) % 6) || ', serif; }'",
        "'.e { font-size: ' || ((doc_id + line_no) % 20) || 'px; }'",
        "'.f { z-index: ' || (doc_id % 300) || '; }'",
        "'.g { box-shadow: 0 0 ' || ((doc_id + line_no) % 8) || 'px black; }'",
        "'.h { transition: opacity ' || ((doc_id + line_no) % 7) || '00ms; }'",
        "'@media (max-width: ' || ((doc_id + line_no) % 9) || '00px) { }'",
        "'@keyframes spin { from { opacity: 0 } }'",
        "'.i { color: var(--main-color); }'",
        "'.j { box-shadow: none; }'",
        "'.k { font-family: inherit; }'",
    ],
)
PG = """
pg AS (SELECT page_id, 'site' || (page_id % 8) AS repo, 'page' || page_id || '.html' AS path,
   replace(CASE WHEN page_id % 5 = 0 THEN regexp_replace(html, '<html lang="[a-z]*">', '<html>') ELSE html END, '<article>',
     ['<article><img src="a.png">', '<article><button class="x"></button>',
      '<article><input name="a"><input name="b" style="color: red; margin: 0">', '<article><img src="a.png" alt="a">'][page_id % 4 + 1]) AS content FROM pages)
"""
SS = """
ss AS (SELECT 'site' || (doc_id % 8) AS repo, 'src/s' || doc_id || '.ts' AS path,
   CASE WHEN doc_id % 8 < 3 THEN 'lib' WHEN doc_id % 8 = 5 THEN 'health' ELSE 'plain' END AS kind FROM documents)
"""
SNIP = "substr(trim(line), 1, 120)"


def hit(rule, domain, confidence, severity, src, cond="true", line="line_no", snip="NULL", file="path", places="1") -> str:
    return (
        f"SELECT repo, '{rule}' AS rule, '{domain}' AS domain, {severity} AS severity, {confidence}::DOUBLE AS confidence, {file} AS file, "
        f"CAST({line} AS INTEGER) AS line, CAST({snip} AS VARCHAR) AS snippet, {places} AS places FROM {src} WHERE {cond}"
    )


def q(ctes: str, *parts: str) -> str:
    return f"WITH RECURSIVE {ctes} " + " UNION ALL ".join(parts)


def titled(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes} {body}"


SECRET_CODE = hit("no-hardcoded-secret", "security", 0.9, "'high'", "cl", "n = 11", snip=SNIP)
TODO = [
    hit("unresolved-todo", "conventions", 1.0, "CASE n WHEN 4 THEN 'low' ELSE 'medium' END", "cl", "n IN (4, 5)", snip=SNIP),
    hit("aged-todo", "tech-debt", 0.95, "'high'", "cl", "n = 4", snip=SNIP),
]
RUNTIME = [
    hit("sync-fs-usage", "performance", 0.8, "'medium'", "cl", "n = 7", snip=SNIP),
    hit("potential-infinite-loop", "performance", 0.8, "'medium'", "cl", "n = 8", snip=SNIP),
]
CUSTOM = [
    hit("no-loose-total", "security", 0.8, "'medium'", "cl", "n = 9", snip=SNIP),
    hit("no-router", "security", 0.8, "'low'", "cl", "n = 12", snip=SNIP),
]
SECRET_RE = (
    "(?i)(?:api[_-]?key|secret|token|password|passwd|pwd|access[_-]?key|private[_-]?key)[a-z0-9_]*[\"'']?"
    "\\s*[:=]\\s*[\"''][^\"''\\s]{8,}[\"'']"
)
PLACEHOLDER_RE = "(?i)changeme|change_me|placeholder|example|your[-_]|xxxx|dummy|sample|todo|\\$\\{|<[a-z_ -]+>"

FIRST_JAVA = """
fj AS (SELECT doc_id, repo, path, """ + ", ".join(f"min(line_no) FILTER (n = {i}) AS f{i}" for i in range(14)) + """ FROM jl GROUP BY ALL)
"""
LEAKS = """
lk0 AS (SELECT *, max(line_no) FILTER (n = 5) OVER w AS handler, max(line_no) FILTER (n = 6) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
   FROM jl WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lk AS (SELECT * FROM lk0 WHERE n = 6 AND handler IS NOT NULL AND line_no - handler <= 31 AND (before IS NULL OR before < handler))
"""

BRACES = """
ch AS (SELECT doc_id, line_no, i, substr(line, i, 1) AS c FROM (SELECT doc_id, line_no, line, unnest(range(1, length(line) + 1)) AS i FROM SRC)),
br AS (SELECT *, sum(CASE c WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY line_no, i) AS depth,
   row_number() OVER (PARTITION BY doc_id ORDER BY line_no, i) AS pos FROM ch WHERE c IN ('{', '}')),
op AS (SELECT doc_id, line_no, min(pos) AS pos FROM br WHERE c = '{' GROUP BY ALL),
st AS (SELECT s.*, o.pos, b.depth - 1 AS base
   FROM STARTS s JOIN op o USING (doc_id, line_no) JOIN br b ON b.doc_id = s.doc_id AND b.pos = o.pos),
sp AS (SELECT s.repo, s.path, s.name, s.line_no AS start, min(e.line_no) - s.line_no + 1 AS lines, s.doc_id
   FROM st s JOIN br e ON e.doc_id = s.doc_id AND e.c = '}' AND e.pos > s.pos AND e.depth = s.base
   GROUP BY s.repo, s.path, s.name, s.line_no, s.pos, s.doc_id)
"""
STARTS = "(SELECT *, CASE n WHEN 0 THEN 'fn' || doc_id WHEN 1 THEN 'if' ELSE 'for' END AS name FROM cl WHERE n IN (0, 1, 2))"
SPANS = CL + "," + BRACES.replace("SRC", "cl").replace("STARTS", STARTS)
CLASS_STARTS = "(SELECT *, 'File' || doc_id AS name FROM jl WHERE n = 0)"
CLASSES = JL + "," + BRACES.replace("SRC", "jl").replace("STARTS", CLASS_STARTS)

SIGNIFICANT = """
sg AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS pos FROM cl WHERE n NOT IN (3, 4, 5, 6)),
bl AS (SELECT repo, path, pos, string_agg(trim(line), chr(10)) OVER w AS block, count(*) OVER w AS k FROM sg
   WINDOW w AS (PARTITION BY path ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
bk AS (SELECT * FROM bl WHERE k = 6 AND length(block) >= 80),
sh AS (SELECT repo, block, list_sort(list(DISTINCT path)) AS files, min(struct_pack(path := path, pos := pos)) AS first FROM bk GROUP BY ALL HAVING count(DISTINCT path) >= 2),
wn AS (SELECT *, len(files) AS n FROM sh QUALIFY row_number() OVER (PARTITION BY repo, files ORDER BY first) = 1)
"""


def project(kind_sql: str) -> str:
    return f"pr AS (SELECT o_orderkey AS k, o_totalprice, 'order' || o_orderkey AS repo{kind_sql} FROM orders)"


def per(n: str, cols: str) -> str:
    """Rows of a report: one per ``i`` below ``n`` of each order."""
    return f"pr AS (SELECT o_orderkey AS k, 'order' || o_orderkey AS repo, i{cols} FROM (SELECT o_orderkey, unnest(range(0, CAST({n} AS BIGINT))) AS i FROM orders))"


DEPS = """
dp0 AS (SELECT k, repo, i, ['lodash-es','lodash-fp','@scope/lodash-merge','react-dom','express','left-pad','chalk'][i + 1] AS name,
    ['^0.1.2','latest','^1.2.3','*','~2.0.0'][(k + i) % 5 + 1] AS version FROM (SELECT o_orderkey AS k, 'order' || o_orderkey AS repo, unnest(range(0, o_orderkey % 7 + 1)) AS i FROM orders)),
dv AS (SELECT k, repo, i, ['express','vitest','react-dom'][i + 1] AS name, ['next','^3.0.0'][(k + i) % 2 + 1] AS version
    FROM (SELECT o_orderkey AS k, 'order' || o_orderkey AS repo, unnest(range(0, o_orderkey % 3 + 1)) AS i FROM orders)),
dp AS (SELECT d.k, d.repo, d.i, d.name, coalesce(v.version, d.version) AS version FROM dp0 d LEFT JOIN dv v USING (k, name)
    UNION ALL SELECT v.k, v.repo, 100 + v.i, v.name, v.version FROM dv v WHERE NOT EXISTS (SELECT 1 FROM dp0 d WHERE d.k = v.k AND d.name = v.name)),
un AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS rn, count(*) OVER (PARTITION BY k) AS cnt FROM dp
    WHERE version IN ('*', 'latest', 'next') OR regexp_matches(version, '^\\^?0\\.'))
"""

README = """
rd AS (SELECT o_orderkey AS k, 'order' || o_orderkey AS repo, o_orderkey % 8 <> 0 AS has,
   o_orderkey % 2 = 0 AS installation, o_orderkey % 3 = 0 AS usage, o_orderkey % 5 = 0 AS testing, o_orderkey % 4 = 0 AS prerequisites,
   o_orderkey % 4 = 0 AS contributing, o_orderkey % 7 = 0 AS license, o_orderkey % 7 = 0 AS architecture FROM orders)
"""


def section(name: str, required: bool) -> str:
    rule, sev, conf = ("readme-section-missing", "'medium'", 0.9) if required else ("readme-recommended-section-missing", "'low'", 0.8)
    return hit(rule, "documentation", conf, sev, "rd", f"has AND NOT {name}", line="NULL", file="'README.md'")


def drift(name: str, cond: str, named: str) -> str:
    return hit(
        "doc-code-drift", "documentation", 0.75, "'low'", "rd", f"has AND {cond} AND NOT ({named})", line="NULL",
        file="'package.json'", snip=f"'scripts.{name}'", places="2",
    )


JUNIT = """
jc AS (SELECT o_orderkey AS k, 'order' || o_orderkey AS repo, i, 't' || i || '_' || o_orderkey AS name,
    (o_orderkey + i) % 3 = 0 OR (o_orderkey + i) % 7 = 1 AS bad, (o_orderkey + i) % 5 = 0 AS flaky
   FROM (SELECT o_orderkey, unnest(range(0, o_orderkey % 4 + 1)) AS i FROM orders)),
jf AS (SELECT *, max(i) FILTER (flaky) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM jc)
"""


def tsel(rule, domain, confidence, severity, title, src, cond="true", file="path", line="NULL", snip="NULL", places="1") -> str:
    return (
        f"SELECT repo, {rule} AS rule, '{domain}' AS domain, {severity} AS severity, {confidence}::DOUBLE AS confidence, {title} AS title, "
        f"{file} AS file, CAST({line} AS INTEGER) AS line, CAST({snip} AS VARCHAR) AS snippet, {places} AS places FROM {src} WHERE {cond}"
    )


PLAYWRIGHT = project(
    ", ['playwright-report/results.json','test-results/results.json','test-results.json'][o_orderkey % 3 + 1] AS path, 'root' || (o_orderkey % 10) AS root"
)

NODES = """
nd0 AS (SELECT repo, path, page_id, unnest(regexp_extract_all(content, '>([^<{}\\n]{4,80})<', 1)) AS raw,
    generate_subscripts(regexp_extract_all(content, '>([^<{}\\n]{4,80})<', 1), 1) AS ord FROM pg),
nd1 AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS text FROM nd0),
nd AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY ord) - 1 AS INTEGER) AS pos FROM nd1 WHERE length(text) >= 4
   AND NOT regexp_matches(text, '^[\\s\\d\\-_./\\\\@#%^*+=|<>{}\\[\\]()!?,;:''"`~&$]+$')
   AND NOT regexp_matches(text, '(?i)^(?:true|false|null|undefined|NaN|Infinity|class|function|import|export|const|let|var|if|else|for|while|return|void|type|interface|enum)$')
   AND regexp_matches(text, '[a-zA-Z]{2,}') AND NOT regexp_matches(text, '\\[|\\]|\\(|\\)|\\*ng|\\{\\{|#|\\bclass\\b')
   AND NOT regexp_matches(text, '^(?:/|https?:|\\./|\\.\\./)'))
"""

COLORS = """
ct AS (SELECT doc_id, count(*) FILTER (n = 11) AS uses, count(*) FILTER (n = 3) AS defs FROM sl GROUP BY doc_id),
co AS (SELECT repo, path, line_no, 0 AS kind FROM sl WHERE n = 0 AND (doc_id * 37) % 1000 <> 0
   UNION ALL SELECT repo, path, line_no, 1 FROM sl JOIN ct USING (doc_id) WHERE n = 2 AND uses < defs + 3),
cr AS (SELECT repo, count(*) AS n, arg_min(path, path || chr(1) || kind || lpad(line_no::VARCHAR, 9, '0')) AS file,
   arg_min(line_no, path || chr(1) || kind || lpad(line_no::VARCHAR, 9, '0')) AS line FROM co GROUP BY repo)
"""

STYLE = """
sv AS (SELECT DISTINCT repo, 'family' AS kind, 'face' || ((doc_id + line_no) % 6) AS value FROM sl WHERE n = 4
   UNION SELECT repo, 'size', ((doc_id + line_no) % 20) || 'px' FROM sl WHERE n = 5
   UNION SELECT repo, 'shadow', '0 0 ' || ((doc_id + line_no) % 8) || 'px black' FROM sl WHERE n = 7
   UNION SELECT repo, 'shadow', 'none' FROM sl WHERE n = 12
   UNION SELECT repo, 'duration', ((doc_id + line_no) % 7) || '00ms' FROM sl WHERE n = 8
   UNION SELECT repo, 'breakpoint', ((doc_id + line_no) % 9) || '00px' FROM sl WHERE n = 9),
sc AS (SELECT repo, kind, count(*) AS n FROM sv GROUP BY ALL),
sf AS (SELECT repo, min(struct_pack(path := path, line := line_no)) AS f, least(count(*), 3) AS places FROM sl WHERE n IN (7, 12) GROUP BY repo)
"""

TEST_PATHS = """
tf AS (SELECT 'repo' || (doc_id % 10) AS repo, 'src/tests/' || CASE WHEN doc_id % 2 = 0 THEN 'File' || doc_id || 'Test.java' ELSE 'unit-file' || doc_id || '.test.ts' END AS path, doc_id FROM documents)
"""
TQ = "f AS (SELECT *, doc_id % 2 = 0 AS java, doc_id % 4 <> 3 OR doc_id % 5 = 0 AS blocks, doc_id % 3 = 0 OR doc_id % 7 = 1 AS asserts, doc_id % 8 AS mocks, (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 7 = 1 THEN 30 ELSE 0 END) AS na FROM tf)"

GRAPH = """
eg AS (SELECT 's' || lpad(s_suppkey::VARCHAR, 9, '0') AS src, 's' || lpad(((s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier))::VARCHAR, 9, '0') AS dst FROM supplier),
rc(start, node, step) AS (SELECT src, dst, 1 FROM eg UNION ALL SELECT r.start, e.dst, r.step + 1 FROM rc r JOIN eg e ON e.src = r.node WHERE r.node <> r.start AND r.step < 2000),
cy AS (SELECT start, step FROM rc WHERE node = start),
mb AS (SELECT r.start, r.node, c.step AS size FROM rc r JOIN cy c ON c.start = r.start),
sm AS (SELECT start AS node, min(node) AS scc, max(size) AS size FROM mb GROUP BY start)
"""

RT = """
rt AS (SELECT repo, path AS file, CAST(row_number() OVER (PARTITION BY path ORDER BY line_no) - 1 AS INTEGER) AS pos, '/api/getUsers' AS path, 'get' AS method, line_no AS line FROM cl WHERE n = 12
  UNION ALL SELECT repo, path, CAST(row_number() OVER (PARTITION BY path ORDER BY line_no) - 1 AS INTEGER), '/api/v1/order_items', 'rest', line_no FROM jl WHERE n = 13)
"""

LAYERS = "['presentation','application','domain','infrastructure'][doc_id % 4 + 1]"

ORACLE = {
    "numbered_lines": titled(CL, "SELECT repo, path, line_no, line FROM cl"),
    "line_rules": q(CL, SECRET_CODE, *TODO, *RUNTIME, *CUSTOM),
    "line_rules_java": q(
        JL,
        hit("no-commented-auth", "security", 0.92, "'high'", "jl", "n = 3", snip=SNIP),
        hit("sync-http-in-controller", "performance", 0.8, "'medium'", "jl", "n = 10", snip=SNIP),
    ),
    "secrets_docs": q(
        f"dl AS (SELECT source AS repo, 'docs/d' || doc_id || '.md' AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents), "
        "dd AS (SELECT *, substr(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 1, 120) AS snip FROM dl)",
        hit(
            "no-hardcoded-secret", "security", 0.9, "CASE WHEN regexp_matches(line, '[\"''](?:sk[-_]|gh[pousr]_|AKIA|xox[bap]-|AIza)') THEN 'critical' ELSE 'high' END",
            "dd", f"regexp_matches(line, '{SECRET_RE}') AND NOT regexp_matches(line, '{PLACEHOLDER_RE}') AND NOT regexp_matches(line, '^\\s*(?://|/\\*|\\*|#)')", snip="snip",
        ),
        hit("no-private-key", "security", 0.95, "'critical'", "dd", "regexp_matches(line, '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----')", snip="snip"),
        hit(
            "no-connection-string", "security", 0.7, "'high'", "dd",
            "regexp_matches(line, '[A-Za-z][A-Za-z0-9+.-]*://[^\\s:/@\"'']+:[^\\s/@\"'']+@') OR regexp_matches(line, '(?i)jdbc:[a-z0-9]+:')", snip="snip",
        ),
    ),
    "secrets_settings": q(
        project(", 'src/main/resources/application.properties' AS path, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS extra"),
        hit("no-connection-string", "security", 0.7, "'high'", "pr", line="2 + extra", snip="'spring.datasource.url=jdbc:postgresql://db' || (k % 9) || ':5432/app'"),
        hit(
            "no-hardcoded-secret-unquoted", "security", 0.45, "'high'", "pr", "k % 5 <> 0", line="3 + extra",
            snip="CASE WHEN k % 3 = 0 THEN 'spring.datasource.password=' ELSE 'app.api_key=' END || 's3cr3tValue' || k",
        ),
    ),
    "custom_patterns": q(CL, *CUSTOM),
    "todo_scan": titled(
        CL,
        """SELECT repo, 'unresolved-todo' AS rule, 'conventions' AS domain, CASE n WHEN 4 THEN 'low' ELSE 'medium' END AS severity, 1.0::DOUBLE AS confidence,
             CASE n WHEN 4 THEN 'TODO comment: 2023-05-01: tidy up' ELSE 'FIXME comment: later' END AS title, path AS file, line_no AS line, trim(line) AS snippet, 1 AS places
           FROM cl WHERE n IN (4, 5)
           UNION ALL SELECT repo, 'aged-todo', 'tech-debt', 'high', 0.95, 'Note left for 397 days: ' || path, path, line_no, trim(line), 1 FROM cl WHERE n = 4""",
    ),
    "runtime_calls": q(CL, *RUNTIME),
    "env_files": q(
        project(", ['.env','local.env','.env.local','.env.example','conf/env.txt'][o_orderkey % 5 + 1] AS path"),
        hit("no-env-file-committed", "security", 0.9, "'high'", "pr", "k % 5 < 3", line="NULL"),
    ),
    "java_security": q(
        ", ".join([JL, FIRST_JAVA, LEAKS]),
        hit("no-permit-all", "security", 0.95, "'critical'", "fj", "f1 IS NOT NULL", line="f1"),
        hit("no-csrf-disable", "security", 0.90, "'high'", "fj", "f1 IS NOT NULL", line="f1"),
        hit("no-cors-wildcard-credentials", "security", 0.92, "'high'", "fj", "f2 IS NOT NULL AND f12 IS NOT NULL", line="f2"),
        hit("cors-wildcard-origin", "security", 0.85, "'medium'", "fj", "f2 IS NOT NULL AND f12 IS NULL", line="f2"),
        hit("file-upload-no-validation", "security", 0.85, "'medium'", "fj", "f11 IS NOT NULL", line="f11"),
        hit("missing-valid-annotation", "security", 0.88, "'medium'", "jl", "n = 4 AND doc_id IN (SELECT doc_id FROM fj WHERE f0 IS NOT NULL)", snip=SNIP),
        hit("error-info-leak", "security", 0.90, "'high'", "lk", snip=SNIP),
    ),
    "server_config": q(
        project(", 'src/main/resources/application.properties' AS path"),
        hit("actuator-expose-all", "security", 0.90, "'medium'", "pr", "k % 2 = 0", line="2"),
    ),
    "maven_manifest": q(
        project(", 'pom.xml' AS path"),
        hit("excessive-maven-dependencies", "security", 0.9, "'medium'", "pr", "k % 60 > 50", line="NULL"),
        hit("no-snapshot-dependency", "security", 0.95, "'low'", "pr", "k % 4 = 0", line="NULL", snip="'<version>' || (k % 9) || '.0-SNAPSHOT</version>'"),
    ),
    "controllers": q(
        ", ".join([JL, FIRST_JAVA]),
        hit("stateful-rest-controller", "api-design", 0.90, "'high'", "fj", "f0 IS NOT NULL AND f11 IS NOT NULL", line="f11"),
        hit("unpaginated-list-endpoint", "api-design", 0.80, "'medium'", "fj", "f0 IS NOT NULL AND f10 IS NOT NULL", line="f10"),
    ),
    "file_naming": q(
        CL,
        hit(
            "file-naming-convention", "conventions", 0.6, "'low'",
            "(SELECT DISTINCT repo, path FROM cl WHERE doc_id % 4 < 3)", line="NULL",
        ),
    ),
    "long_files": q(
        CL + ", ln AS (SELECT repo, path, count(*) AS c FROM cl GROUP BY ALL)",
        hit("file-too-long", "conventions", 1.0, "CASE WHEN c > 60 THEN 'high' ELSE 'medium' END", "ln", "c > 20", line="NULL"),
    ),
    "many_parameters": q(CL, hit("too-many-params", "conventions", 0.9, "'medium'", "cl", "n = 0", snip="'fn' || doc_id || '(a, b, c, d)'")),
    "magic_numbers": q(
        CL + ", mg AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS rn FROM cl WHERE n = 13 OR (n = 9 AND doc_id % 97 + 3 NOT IN (1, 2, 100)))",
        hit("magic-number", "conventions", 0.85, "'low'", "mg", snip=SNIP),
    ),
    "test_quality": q(
        ", ".join([TEST_PATHS, TQ]),
        hit("empty-assertion", "tests", 0.75, "'medium'", "f", "doc_id % 4 <> 3 AND NOT asserts", line="NULL"),
        hit("excessive-mocking", "tests", 0.60, "'low'", "f", "mocks >= 5 AND NOT asserts", line="NULL", snip="'mock_calls=' || mocks"),
        hit(
            "excessive-assertions", "tests", 0.75, "'medium'", "f", "java AND doc_id % 4 <> 3 AND na > 25", line="NULL",
            snip="'assertions=' || na || ', tests=1'",
        ),
        hit("missing-test-slicing", "tests", 0.70, "'low'", "f", "java AND doc_id % 6 <> 0", line="NULL"),
    ),
    "complexity": q(
        CL + ", cx AS (SELECT repo, path, 1 + sum(CASE n WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 8 THEN 1 WHEN 10 THEN 1 ELSE 0 END) AS c FROM cl GROUP BY ALL)",
        hit("high-complexity", "tech-debt", 0.8, "CASE WHEN c > 60 THEN 'high' ELSE 'medium' END", "cx", "c >= 35", line="NULL", snip="'estimated_complexity=' || c"),
    ),
    "deprecated_apis": q(
        CL + ", dp AS (SELECT * FROM cl WHERE n = 13 QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no) = 1)",
        hit("deprecated-api-usage", "tech-debt", 0.9, "'high'", "dp", snip=SNIP),
    ),
    "deep_nesting": q(
        CL
        + """, ds AS (SELECT *, sum(CASE WHEN n IN (0, 1, 2) THEN 1 WHEN n IN (3, 10) THEN -1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS depth FROM cl),
            dm AS (SELECT * FROM ds WHERE n NOT IN (4, 5) QUALIFY row_number() OVER (PARTITION BY path ORDER BY depth DESC, line_no) = 1)""",
        hit("deep-nesting", "tech-debt", 0.85, "CASE WHEN depth > 6 THEN 'high' ELSE 'medium' END", "dm", "depth > 4", snip=SNIP),
    ),
    "persistence": q(
        ", ".join([JL, FIRST_JAVA])
        + ", cs AS (SELECT f.*, j.line, greatest(f7 - 1, 1) AS first_at FROM fj f JOIN jl j ON j.doc_id = f.doc_id AND j.line_no = greatest(f7 - 1, 1))",
        hit("jpa-data-on-entity", "tech-debt", 0.95, "'high'", "fj", "f0 IS NOT NULL", line="f0"),
        hit("jpa-missing-version", "tech-debt", 0.80, "'medium'", "fj", "f0 IS NOT NULL", line="NULL"),
        hit("jpa-cascade-all-many-to-one", "tech-debt", 0.90, "'high'", "cs", "f0 IS NOT NULL AND f7 IS NOT NULL", line="first_at", snip=SNIP),
        hit("jpa-missing-modifying", "tech-debt", 0.90, "'medium'", "jl", "n = 8", snip=SNIP),
    ),
    "a11y_pages": q(
        PG
        + """, ay AS (SELECT *, len(string_split(split_part(content, '<img', 1), chr(10))) AS img, len(string_split(split_part(content, '<button', 1), chr(10))) AS btn,
              len(string_split(split_part(content, '<input', 1), chr(10))) AS inp,
              list_filter(regexp_extract_all(content, '(?i)<img[^>]*>'), lambda x: NOT regexp_matches(x, '(?i)\\balt\\s*=')) AS imgs FROM pg)""",
        hit("img-missing-alt", "accessibility", 0.90, "'medium'", "ay", "len(imgs) > 0", line="img", snip="imgs[1]"),
        hit("interactive-no-accessible-name", "accessibility", 0.85, "'high'", "ay", "contains(content, '<button class=\"x\"></button>')", line="btn", snip="'<button class=\"x\"></button>'"),
        hit("html-missing-lang", "accessibility", 0.95, "'medium'", "ay", "contains(content, '<html>')", line="1"),
        hit("input-missing-label", "accessibility", 0.75, "'medium'", "ay", "page_id % 4 = 2", line="inp"),
    ),
    "function_spans": titled(SPANS, "SELECT repo, path, name, CAST(start AS INTEGER) AS start, CAST(lines AS INTEGER) AS lines FROM sp"),
    "long_functions": q(
        SPANS,
        hit(
            "function-too-long", "conventions", 0.9, "CASE WHEN lines > 3 THEN 'high' ELSE 'medium' END", "sp", "lines > 2", line="start",
            snip="name || '() — ' || lines || ' lines'",
        ),
    ),
    "class_spans": titled(
        CLASSES,
        """SELECT repo, path, name, CAST(start AS INTEGER) AS start, CAST(lines AS INTEGER) AS lines,
           CAST((SELECT count(*) FROM jl j WHERE j.doc_id = sp.doc_id AND j.n IN (4, 10, 11) AND j.line_no > start AND j.line_no < start + lines - 1) AS INTEGER) AS methods
           FROM sp WHERE lines > 1""",
    ),
    "swallowed_exceptions": q(
        CL + ", sw AS (SELECT repo, count(*) AS c, min(struct_pack(path := path, line := line_no)) AS f FROM cl WHERE n = 10 GROUP BY repo)",
        hit(
            "swallowed-exception", "observability", 0.85, "CASE WHEN c >= 5 THEN 'high' ELSE 'medium' END", "sw", line="f.line", file="f.path", places="least(c, 5)",
        ),
    ),
    "manifest_dependencies": titled(DEPS, "SELECT repo, name, version FROM dp"),
    "dependency_rules": q(
        DEPS,
        hit(
            "dependency-staleness-risk", "tech-debt", 0.75, "CASE WHEN cnt > 8 THEN 'medium' ELSE 'low' END", "un", "rn = 1", line="NULL",
            file="'package.json'", snip="name || ': ' || version", places="least(cnt, 3)",
        ),
    ),
    "dep_prefixes": q(
        DEPS
        + """, px AS (SELECT repo, string_split(regexp_replace(name, '^@[^/]+/', ''), '-')[1] AS prefix, count(*) AS c FROM dp
              WHERE contains(regexp_replace(name, '^@[^/]+/', ''), '-') GROUP BY ALL)""",
        hit("potential-duplicate-deps", "architecture", 0.5, "'low'", "px", "c >= 3", line="NULL", file="'package.json'"),
    ),
    "pom_facts": titled(
        project(""),
        "SELECT repo, CAST(k % 60 AS INTEGER) AS dependencies, CASE WHEN k % 4 = 0 THEN (k % 9) || '.0-SNAPSHOT' ELSE '' END AS snapshots FROM pr",
    ),
    "ignore_rules": titled(
        project(""),
        """SELECT repo, 'rule-' || (k % 4) AS rule, '*' AS file FROM pr UNION ALL SELECT repo, 'dry-violation', 'src/gen/' FROM pr
           UNION ALL SELECT repo, '*', 'vendor' || (k % 3) || '/' FROM pr UNION ALL SELECT repo, 'other', '*' FROM pr""",
    ),
    "profiles": titled(
        project(""),
        """SELECT repo, CASE WHEN k % 5 IN (0, 1) AND k % 3 = 0 AND k % 2 = 0 THEN 'java-angular-playwright' WHEN k % 5 IN (0, 1) THEN 'java-backend'
           WHEN k % 5 = 2 OR k % 3 = 0 THEN 'angular-frontend' WHEN k % 5 = 3 OR k % 3 = 1 THEN 'typescript-node' ELSE 'generic' END AS profile FROM pr""",
    ),
    "readme_sections": q(
        README,
        hit("readme-required", "documentation", 1.0, "'high'", "rd", "NOT has", line="NULL", file="'README.md'"),
        hit("adr-missing", "documentation", 0.9, "'low'", "rd", "k % 3 <> 0", line="NULL", file="'docs/adr'"),
        *[section(s, True) for s in ("installation", "usage", "testing")],
        *[section(s, False) for s in ("prerequisites", "contributing", "license", "architecture")],
        drift("build", "true", "k % 3 = 0"),
        drift("test", "k % 3 >= 1", "k % 5 = 0"),
        drift("lint", "k % 3 = 2", "false"),
    ),
    "migration_tools": q(
        project(""),
        hit(
            "jpa-no-migration-tool", "tech-debt", 0.85, "'medium'", "pr", "k % 2 = 0 AND k % 5 <> 0", line="NULL", file="'pom.xml'",
            snip="'No liquibase/flyway dependency found'",
        ),
    ),
    "observability": q(
        SS + ", ob AS (SELECT repo, count(*) AS c, min(path) AS first, bool_or(kind = 'health') AS ok FROM ss GROUP BY repo)",
        hit("missing-health-endpoint", "observability", 0.80, "'medium'", "ob", "NOT ok", line="1", file="first"),
        hit("missing-tracing", "observability", 0.80, "'low'", "ob", "NOT ok AND c >= 5", line="NULL", file="'.'"),
    ),
    "i18n_library": q(
        SS + ", ob AS (SELECT repo, count(*) AS c, bool_or(kind = 'lib') AS ok FROM ss GROUP BY repo)",
        hit("missing-i18n-library", "i18n", 0.80, "'low'", "ob", "NOT ok AND c >= 5", line="NULL", file="'.'"),
    ),
    "text_nodes": titled(PG + "," + NODES, "SELECT repo, path, pos, text FROM nd"),
    "hardcoded_colors": titled(
        SL + "," + COLORS,
        """SELECT repo, 'hardcoded-color' AS rule, 'ux-consistency' AS domain, CASE WHEN n >= 20 THEN 'high' ELSE 'medium' END AS severity, 0.85::DOUBLE AS confidence,
           n || ' literal colors' AS title, file, line, NULL::VARCHAR AS snippet, least(n, 5) AS places FROM cr WHERE n >= 5""",
    ),
    "style_values": titled(SL + "," + STYLE, "SELECT repo, kind, value FROM sv"),
    "style_sprawl": titled(
        SL + "," + STYLE,
        " UNION ALL ".join(
            [
                tsel("'font-family-proliferation'", "ux-consistency", 0.85, "'medium'", "n || ' different font families'", "sc", "kind = 'family' AND n > 3", file="'.'"),
                tsel("'font-size-sprawl'", "ux-consistency", 0.80, "'medium'", "n || ' different font sizes'", "sc", "kind = 'size' AND n > 10", file="'.'"),
                tsel("'inconsistent-durations'", "ux-consistency", 0.80, "'low'", "n || ' different durations'", "sc", "kind = 'duration' AND n > 4", file="'.'"),
                tsel("'breakpoint-inconsistency'", "ux-consistency", 0.80, "'low'", "n || ' different breakpoints'", "sc", "kind = 'breakpoint' AND n > 5", file="'.'"),
                tsel("'shadow-sprawl'", "ux-consistency", 0.80, "'medium'", "n || ' different shadows'", "sc JOIN sf USING (repo)", "kind = 'shadow' AND n > 5", file="f.path", line="f.line", places="places"),
            ]
        ),
    ),
    "inline_styles": titled(
        PG
        + """, ist AS (SELECT repo, count(*) AS n, min(path) AS file, arg_min(len(string_split(split_part(content, 'style="color: red; margin: 0"', 1), chr(10))), path) AS line
              FROM pg WHERE contains(content, 'style="color: red; margin: 0"') GROUP BY repo)""",
        tsel("'inline-style-proliferation'", "ux-consistency", 0.80, "CASE WHEN n >= 10 THEN 'high' ELSE 'medium' END", "n || ' inline styles'", "ist", "n >= 3",
             file="file", line="line", snip="'style=\"color: red; margin: 0\"'", places="least(n, 5)"),
    ),
    "magic_z_indexes": titled(
        SL
        + """, zi AS (SELECT repo, count(*) AS n, min(struct_pack(path := path, line := line_no, z := doc_id % 300)) AS f FROM sl
              WHERE n = 6 AND doc_id % 300 > 99 GROUP BY repo)""",
        tsel("'magic-zindex'", "ux-consistency", 0.85, "'medium'", "n || ' large z-index values'", "zi", file="f.path", line="f.line", snip="'z-index: ' || f.z", places="least(n, 5)"),
    ),
    "reduced_motion": q(
        SL, hit("missing-reduced-motion", "ux-consistency", 0.85, "'medium'", "(SELECT DISTINCT repo FROM sl WHERE n = 10)", line="NULL", file="'.'")
    ),
    "hardcoded_texts": titled(
        ", ".join([PG, NODES, SS])
        + """, lib AS (SELECT repo FROM ss GROUP BY repo HAVING bool_or(kind = 'lib')),
              inf AS (SELECT path FROM pg WHERE regexp_matches(content, '\\|\\s*(?:translate|i18nSelect|i18nPlural|async)') OR regexp_matches(content, '\\bi18n(?:-[a-z]+)?\\b')
                 OR regexp_matches(content, '(?:\\bt\\s*\\(|i18n\\.t\\s*\\(|useTranslation|<FormattedMessage|intl\\.formatMessage)')),
              ht AS (SELECT repo, count(*) AS n, min(path) AS file FROM nd WHERE repo IN (SELECT repo FROM lib) OR path IN (SELECT path FROM inf) GROUP BY repo)""",
        tsel("'hardcoded-template-string'", "i18n", 0.75, "'medium'", "n || ' untranslated texts in templates'", "ht", "n >= 3", file="file", line="1", places="least(n, 5)"),
    ),
    "missing_tests": q(
        CL + ", mt AS (SELECT DISTINCT doc_id, repo, path FROM cl)",
        hit("missing-test-file", "tests", 0.7, "'medium'", "mt", "doc_id % 4 <> 0 AND doc_id % 2 = 0", line="NULL"),
    ),
    "dry_blocks": titled(
        ", ".join([CL, SIGNIFICANT]),
        """SELECT w.repo, 'dry-violation' AS rule, 'conventions' AS domain, 'low' AS severity, 0.7::DOUBLE AS confidence, 'The same block in ' || w.n || ' files' AS title,
             w.first.path AS file, CAST(w.first.pos AS INTEGER) AS line, NULL::VARCHAR AS snippet,
             CAST(least(3, (SELECT count(*) FROM bk b WHERE b.repo = w.repo AND b.block = w.block)) AS INTEGER) AS places FROM wn w""",
    ),
    "exported_names": titled(
        CL, "SELECT repo, path, CAST(row_number() OVER (PARTITION BY path ORDER BY line_no) - 1 AS INTEGER) AS pos, 'fn' || doc_id AS symbol FROM cl WHERE n = 0"
    ),
    "dead_exports": q(
        CL
        + """, us AS (SELECT DISTINCT repo, path, 'fn' || doc_id AS w FROM cl WHERE n = 0 UNION SELECT DISTINCT repo, path, 'fn' || ((doc_id * 7) % 50) FROM cl WHERE n = 6),
              de AS (SELECT c.*, 'fn' || c.doc_id AS symbol FROM cl c WHERE n = 0 AND NOT EXISTS
                 (SELECT 1 FROM us u WHERE u.repo = c.repo AND u.path <> c.path AND contains(u.w, 'fn' || c.doc_id)))
              , dr AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, line_no) AS rn FROM de)""",
        hit("dead-export", "tech-debt", 0.8, "'low'", "dr", line="NULL", snip="'export … ' || symbol"),
    ),
    "dead_exports_by_token": q(
        CL
        + """, us AS (SELECT DISTINCT repo, path, 'fn' || doc_id AS w FROM cl WHERE n = 0 UNION SELECT DISTINCT repo, path, 'fn' || ((doc_id * 7) % 50) FROM cl WHERE n = 6),
              de AS (SELECT c.*, 'fn' || c.doc_id AS symbol FROM cl c WHERE n = 0 AND NOT EXISTS
                 (SELECT 1 FROM us u WHERE u.repo = c.repo AND u.path <> c.path AND u.w = 'fn' || c.doc_id))
              , dr AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, line_no) AS rn FROM de)""",
        hit("dead-export", "tech-debt", 0.8, "'low'", "dr", line="NULL", snip="'export … ' || symbol"),
    ),
    "stale_env_keys": q(
        project(", '.env.example' AS path"),
        hit("env-example-stale-key", "documentation", 0.65, "'low'", "pr", "k % 5 <> k % 4", line="NULL", snip="'API_KEY_' || (k % 5)"),
        hit("env-example-stale-key", "documentation", 0.65, "'low'", "pr", "k % 2 <> 0", line="NULL", snip="'PORT'"),
        hit("env-example-stale-key", "documentation", 0.65, "'low'", "pr", "NOT (k % 2 <> 0 AND k % 3 = 1)", line="NULL", snip="'UNUSED_' || (k % 3)"),
    ),
    "import_list": titled(
        JL, "SELECT repo, path, CAST(row_number() OVER (PARTITION BY path ORDER BY line_no) - 1 AS INTEGER) AS pos, 'com.shop.model.File' || ((doc_id * 7) % 50) AS spec FROM jl WHERE n = 9"
    ),
    "layer_violations": titled(
        CL,
        tsel("'no-layer-violation'", "architecture", 0.8, "'high'", f"'Layer violation: ' || {LAYERS} || ' → application'", "cl", "n = 6 AND doc_id % 4 IN (2, 3)",
             snip="'import ... from ''../services/file' || ((doc_id * 7) % 50) || ''''"),
    ),
    "layer_violations_java": titled(
        JL,
        tsel("'no-layer-violation'", "architecture", 0.8, "'high'", f"'Layer violation: ' || {LAYERS} || ' → domain'", "jl", "n = 9 AND doc_id % 4 IN (0, 3)",
             snip="'import ... from ''/com/shop/model/File' || ((doc_id * 7) % 50) || ''''"),
    ),
    "import_edges": titled(
        CL,
        """SELECT DISTINCT c.repo, c.path AS src, d.path AS dst FROM cl c JOIN (SELECT DISTINCT repo, path FROM cl) d
           ON d.repo = c.repo AND d.path = 'src/services/file' || ((c.doc_id * 7) % 50) || '.ts' WHERE c.n = 6""",
    ),
    "import_edges_java": titled(
        JL,
        """SELECT c.repo, c.path AS src, min(d.path) AS dst FROM (SELECT DISTINCT repo, path, doc_id FROM jl WHERE n = 9) c JOIN (SELECT DISTINCT repo, path FROM jl) d
           ON d.repo = c.repo AND d.path LIKE '%com/shop/model/File' || ((c.doc_id * 7) % 50) || '.java' GROUP BY c.repo, c.path""",
    ),
    "import_cycles": titled(GRAPH, "SELECT 'suppliers' AS repo, scc, node FROM sm"),
    "circular_dependencies": q(
        GRAPH + ", sx AS (SELECT DISTINCT 'suppliers' AS repo, scc, size FROM sm)",
        hit("no-circular-dependency", "architecture", 0.95, "'high'", "sx", line="NULL", file="scc", places="least(size, 3)"),
    ),
    "routes": titled(", ".join([CL, JL, RT]), "SELECT * FROM rt"),
    "route_paths": q(
        ", ".join([CL, JL, RT]),
        hit("verb-based-resource-name", "api-design", 0.90, "'medium'", "rt", "path = '/api/getUsers'", line="line", file="file"),
        hit("non-kebab-case-path", "api-design", 0.85, "'low'", "rt", "path <> '/api/getUsers'", line="line", file="file"),
    ),
    "route_versions": titled(
        ", ".join([CL, JL, RT])
        + ", rv AS (SELECT repo, count(*) AS n, min(struct_pack(file := file, pos := pos, line := line)) AS f FROM rt GROUP BY repo HAVING count(*) >= 3 AND NOT bool_or(path <> '/api/getUsers'))",
        tsel("'missing-api-versioning'", "api-design", 0.85, "'low'", "'No version in ' || n || ' routes'", "rv", file="f.file", line="f.line"),
    ),
    "npm_audit": titled(
        per("o_orderkey % 4 + 1", ""),
        tsel("'no-vulnerable-dependency'", "security", 0.95, "['critical','high','medium','low','info','medium'][(k + i) % 6 + 1]",
             "'Vulnerable dependency: pkg-' || ((k + i) % 200)", "pr", file="'package-lock.json'"),
    ),
    "semgrep": titled(
        per("o_orderkey % 3 + 1", ""),
        tsel("'semgrep/java.lang.security.audit.check-' || i", "security", 0.9, "['high','medium','info','critical','low'][(k + i) % 5 + 1]",
             "'Semgrep: audit.check-' || i", "pr", file="'src/F' || k || '.java'", line="k % 100 + i + 1", snip="'code ' || k"),
    ),
    "eslint": titled(
        per("o_orderkey % 3 + 1", ", unnest([0, 1]) AS f"),
        tsel("'eslint/rule-' || ((k + i) % 4)", "conventions", 1.0, "CASE WHEN (k + f + i) % 2 + 1 = 2 THEN 'medium' ELSE 'low' END",
             "'ESLint [rule-' || ((k + i) % 4) || ']: message ' || i || ' of ' || k", "pr", "(k + i) % 4 <> 0", file="'src/f' || f || '.ts'", line="i + 1", snip="'line ' || i"),
    ),
    "checkstyle": titled(
        per("o_orderkey % 3 + 1", ""),
        tsel("'checkstyle/Check' || ((k + i) % 5)", "conventions", 1.0, "CASE WHEN (k + i) % 2 = 0 THEN 'medium' ELSE 'low' END",
             "'Checkstyle [Check' || ((k + i) % 5) || ']: Line ' || i || ' is too long'", "pr", file="'src/A' || k || '.java'", line="i + 1"),
    ),
    "coverage": q(
        project(", CASE WHEN o_orderkey % 3 = 0 THEN 'coverage/coverage-final.json' ELSE 'coverage/coverage-summary.json' END AS path, (o_orderkey * 37 % 1000) / 10.0 AS l, (o_orderkey * 53 % 1000) / 10.0 AS b, (o_orderkey * 71 % 1000) / 10.0 AS fn"),
        hit("low-lines-coverage", "tests", 1.0, "CASE WHEN l < 60 THEN 'high' ELSE 'medium' END", "pr", "l < 80", line="NULL"),
        hit("low-branches-coverage", "tests", 1.0, "CASE WHEN b < 50 THEN 'high' ELSE 'medium' END", "pr", "b < 70", line="NULL"),
        hit("low-functions-coverage", "tests", 1.0, "CASE WHEN fn < 55 THEN 'high' ELSE 'medium' END", "pr", "fn < 75", line="NULL"),
    ),
    "junit_failures": titled(
        JUNIT, tsel("'no-failing-test'", "tests", 1.0, "'high'", "'Failing test: ' || name", "jc", "bad", file="'test-results/junit.xml'")
    ),
    "junit_flaky": titled(
        JUNIT,
        "SELECT repo, 'flaky-test' AS rule, 'tests' AS domain, 'medium' AS severity, 0.9::DOUBLE AS confidence, 'Flaky test: t' || (coalesce(before, -1) + 1) || '_' || k AS title, "
        "'test-results/junit.xml' AS file, NULL::INTEGER AS line, NULL::VARCHAR AS snippet, 1 AS places FROM jf WHERE flaky",
    ),
    "playwright_failures": titled(
        PLAYWRIGHT,
        " UNION ALL ".join(
            [
                tsel("'playwright-test-failure'", "tests", 1.0, "'high'", "'Failing browser test: a' || k", "pr", "k % 4 = 0", snip="'Suite: ' || root"),
                tsel("'playwright-test-failure'", "tests", 1.0, "'high'", "'Failing browser test: c' || k", "pr", "k % 6 = 0", snip="'Suite: ' || root || ' > inner > deep'"),
            ]
        ),
    ),
    "playwright_flaky": titled(
        PLAYWRIGHT,
        tsel("'flaky-test'", "tests", 0.85, "'medium'", "'Flaky browser test: b' || k", "pr", "k % 5 = 0", snip="'Suite: ' || root || ' > inner'"),
    ),
    "bundle_stats": q(
        per("o_orderkey % 3 + 1", ", (o_orderkey * 7919 + i * 104729) % 2000000 AS size, CASE WHEN o_orderkey % 2 = 0 THEN 'dist/stats.json' ELSE 'bundle-stats.json' END AS path"),
        hit("bundle-size-threshold", "performance", 0.95, "CASE WHEN size > 1024000 THEN 'high' ELSE 'medium' END", "pr", "size > 512000", line="NULL", snip="'app' || i || '.js: ' || size"),
    ),
    "build_metrics": q(
        project(", CAST(floor(o_totalprice) AS BIGINT) AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'build-metrics.json' ELSE 'build-timings.json' END AS path"),
        hit("build-time-average", "performance", 0.9, "CASE WHEN a > 300000 THEN 'high' ELSE 'medium' END", "pr", "a > 120000", line="NULL", snip="'average_build_ms=' || a"),
        hit("build-time-p95", "performance", 0.85, "'medium'", "pr", "a + 30000 > 180000", line="NULL", snip="'p95_build_ms=' || (a + 30000)"),
    ),
    "suggested_paths": titled(
        """nm0 AS (SELECT p_partkey AS k, ['get','create','list','users','find','remove'][p_partkey % 6 + 1] AS verb,
              replace(array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(p_name, ' ')], ' '), ' ', CASE WHEN p_partkey % 4 = 0 THEN '_' ELSE '' END) AS name FROM part),
           nm AS (SELECT *, CASE WHEN k % 5 = 0 THEN '' ELSE name END AS used FROM nm0)""",
        """SELECT k AS part, '/api/' || verb || used || '/:id' AS path,
             lower(regexp_replace(regexp_replace(replace(name, '_', '-'), '([a-z])([A-Z])', '\\1-\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1-\\2', 'g')) AS kebab,
             CASE WHEN verb = 'users' THEN '/api/users' || used || '/:id'
               WHEN used = '' THEN '/api/resources/:id' ELSE '/api/' || used || used || '/:id' END AS noun_path FROM nm""",
    ),
    "size_labels": titled(
        "sz AS (SELECT DISTINCT l_orderkey, CAST(floor(l_extendedprice * l_quantity) AS BIGINT) AS bytes FROM lineitem)",
        """SELECT l_orderkey, bytes, CASE WHEN bytes >= 1048576 THEN printf('%.2f MiB', floor(bytes / 1048576.0::DOUBLE * 100 + 0.5) / 100) WHEN bytes >= 1024 THEN printf('%.1f KiB', floor(bytes / 1024.0::DOUBLE * 10 + 0.5) / 10)
             ELSE bytes || ' B' END AS label FROM sz""",
    ),
    "inferred_runs": titled(
        project(""),
        """SELECT k, ['A','B','C','C',NULL][k % 5 + 1] AS tier, [NULL,'bench-ts-express',NULL,'bench-ts-express','bench-java-spring'][k % 5 + 1] AS fixture FROM pr""",
    ),
}

_FUSED = (
    # name, what the single check says about scripts; Java files add their own findings below
    "java_security", "controllers", "persistence", "file_naming", "long_files", "magic_numbers", "complexity",
    "deprecated_apis", "deep_nesting",
)


def _as_part(name: str) -> str:
    return f"SELECT repo, rule, domain, severity, confidence, file, line, snippet, places FROM ({ORACLE[name]})"


# Java files in the scope of the rules that are not about Java. None of their names tells a role; of their
# folders, "repository" is not among the conventional ones (its plural is).
_JAVA_PARTS = [
    hit("file-naming-convention", "conventions", 0.6, "'low'", f"(WITH {JL} SELECT DISTINCT repo, path FROM jl WHERE doc_id % 4 < 3)", line="NULL"),
    hit(
        "file-too-long", "conventions", 1.0, "CASE WHEN c > 60 THEN 'high' ELSE 'medium' END",
        f"(WITH {JL} SELECT repo, path, count(*) AS c FROM jl GROUP BY ALL)", "c > 20", line="NULL",
    ),
    hit(
        "deep-nesting", "tech-debt", 0.85, "CASE WHEN depth > 6 THEN 'high' ELSE 'medium' END",
        f"""(WITH {JL}, ds AS (SELECT *, sum(CASE n WHEN 0 THEN 3 WHEN 4 THEN 1 WHEN 11 THEN 1 WHEN 6 THEN -1 WHEN 12 THEN -3 ELSE 0 END)
              OVER (PARTITION BY path ORDER BY line_no) AS depth FROM jl)
            SELECT * FROM ds WHERE n <> 3 QUALIFY row_number() OVER (PARTITION BY path ORDER BY depth DESC, line_no) = 1)""",
        "depth > 4", snip=SNIP,
    ),
]
ORACLE["file_rules"] = " UNION ALL ".join([*[_as_part(n) for n in _FUSED], *_JAVA_PARTS])

_GOD = CLASSES + """, gc AS (SELECT repo, path, name, start, lines,
   (SELECT count(*) FROM jl j WHERE j.doc_id = sp.doc_id AND j.n IN (4, 10, 11) AND j.line_no > start AND j.line_no < start + lines - 1) AS methods
   FROM sp WHERE lines > 1),
gr AS (SELECT *, concat_ws(' and ', CASE WHEN methods > 1 THEN methods || ' methods' END, CASE WHEN lines > 8 THEN lines || ' lines' END) AS reason
   FROM gc WHERE methods > 1 OR lines > 8)"""
ORACLE["god_classes"] = q(
    _GOD,
    hit(
        "god-class", "tech-debt", 0.85, "CASE WHEN methods > 1 AND lines > 8 THEN 'high' ELSE 'medium' END", "gr", line="start",
        snip="'class ' || name || ' — ' || reason",
    ),
)

_CHANGES = """aft AS (SELECT source AS repo, 'docs/d' || doc_id || '.md' AS path, text AS content FROM documents),
bef AS (SELECT source AS repo, 'docs/d' || doc_id || '.md' AS path, regexp_replace(text, '[0-9]', '#', 'g') AS content FROM documents WHERE doc_id % 13 <> 0
   UNION ALL SELECT source, 'docs/old/d' || doc_id || '.md', regexp_replace(text, '[0-9]', '#', 'g') FROM documents WHERE doc_id % 17 = 0),
cp AS (SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.path, b.path) AS path,
   CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change
   FROM aft a FULL JOIN bef b ON a.repo = b.repo AND a.path = b.path
   WHERE a.path IS NULL OR b.path IS NULL OR a.content IS DISTINCT FROM b.content)"""
ORACLE["changed_paths"] = titled(_CHANGES, "SELECT * FROM cp")
ORACLE["changed_folders"] = titled(
    _CHANGES
    + """, names AS (SELECT unnest(['', 'docs', 'docs/old']) AS folder),
both_sides AS (SELECT repo, path, 1 AS b, 0 AS a FROM bef UNION ALL SELECT repo, path, 0, 1 FROM aft),
sums AS (SELECT repo, folder, sum(b)::BIGINT AS files_before, sum(a)::BIGINT AS files_after
   FROM both_sides JOIN names ON folder = '' OR starts_with(path, folder || '/') GROUP BY repo, folder)""",
    """SELECT repo, folder, CASE WHEN files_before = 0 THEN 'added' WHEN files_after = 0 THEN 'removed' ELSE 'changed' END AS change, files_before, files_after
       FROM sums s WHERE EXISTS (SELECT 1 FROM cp WHERE cp.repo = s.repo AND (folder = '' OR starts_with(cp.path, folder || '/')))""",
)
ORACLE["changed_secrets"] = titled(
    f"{_CHANGES}, sd AS ({ORACLE['secrets_docs']})", "SELECT * FROM sd WHERE (repo, file) IN (SELECT (repo, path) FROM cp WHERE change <> 'removed')"
)

ORACLE["component_templates"] = titled(
    f"ap AS ({ORACLE['a11y_pages']}), nr AS (SELECT *, regexp_extract(file, '[0-9]+')::BIGINT AS page FROM ap WHERE rule <> 'html-missing-lang')",
    "SELECT * EXCLUDE (page) REPLACE ('src/page' || page || '.component.ts' AS file) FROM nr WHERE page % 3 <> 0",
)
ORACLE["many_dependencies"] = q(
    project(""),
    hit("excessive-dependencies", "architecture", 0.9, "'medium'", "pr", "k % 120 + 1 > 80", line="NULL", file="'package.json'"),
)
