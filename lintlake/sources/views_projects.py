"""Project files derived from the orders: one small repository per order.

Every file is a row-wise projection of its order, so these views grow with the table
and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.scalars import extname
from lintlake.sources.views import spread, table

# ``k`` is the order key. Each entry: path and content as expressions over it.
PROJECT_FILES = {
    "npm_audit": (
        "'npm-audit.json'",
        """to_json(named_struct('vulnerabilities', map_from_entries(transform(sequence(0, cast(k % 4 as int)),
             i -> struct(concat('pkg-', (k + i) % 200), named_struct('severity',
                element_at(array('critical', 'high', 'moderate', 'low', 'info', 'strange'), cast((k + i) % 6 as int) + 1)))))))""",
    ),
    "semgrep": (
        "'semgrep.json'",
        """to_json(named_struct('results', transform(sequence(0, cast(k % 3 as int)), i -> named_struct(
             'check_id', concat('java.lang.security.audit.check-', i), 'path', concat('src/F', k, '.java'),
             'start', named_struct('line', cast(k % 100 + i + 1 as int)), 'extra', named_struct(
               'severity', element_at(array('ERROR', 'warning', 'INFO', 'CRITICAL', 'HINT'), cast((k + i) % 5 as int) + 1),
               'message', 'found', 'lines', concat('   code ', k, '  '))))))""",
    ),
    "eslint": (
        "element_at(array('eslint-report.json', '.eslint-report.json', 'reports/eslint.json'), cast(k % 3 as int) + 1)",
        """to_json(transform(sequence(0, 1), f -> named_struct('filePath', concat('/work/src/f', f, '.ts'),
             'messages', transform(sequence(0, cast(k % 3 as int)), j -> named_struct(
               'ruleId', if((k + j) % 4 = 0, null, concat('rule-', (k + j) % 4)), 'severity', cast((k + f + j) % 2 + 1 as int),
               'message', concat('message ', j, ' of ', k), 'line', cast(j + 1 as int), 'source', concat('  line ', j, ' '))))))""",
    ),
    "checkstyle": (
        "element_at(array('target/checkstyle-result.xml', 'checkstyle-result.xml'), cast(k % 2 as int) + 1)",
        """concat('<checkstyle version="8"><file name="/work/src/A', k, '.java">', array_join(transform(sequence(0, cast(k % 3 as int)),
             i -> concat('<error line="', i + 1, '" column="2" severity="', if((k + i) % 2 = 0, 'error', 'warning'),
               '" message="Line ', i, ' is too long" source="com.checks.Check', (k + i) % 5, '"/>')), ''),
             '</file><file name="/work/src/B.java"></file></checkstyle>')""",
    ),
    "coverage": (
        "if(k % 3 = 0, 'coverage/coverage-final.json', 'coverage/coverage-summary.json')",
        """to_json(named_struct('total', named_struct('lines', named_struct('pct', (k * 37 % 1000) / 10.0D),
             'branches', named_struct('pct', (k * 53 % 1000) / 10.0D), 'functions', named_struct('pct', (k * 71 % 1000) / 10.0D))))""",
    ),
    "junit": (
        "'test-results/junit.xml'",
        """concat(if(k % 2 = 0, '<testsuites><testsuite name="s">', '<testsuite name="s">'),
             array_join(transform(sequence(0, cast(k % 4 as int)), i -> concat('<testcase classname="c" name="t', i, '_', k, '">',
               if((k + i) % 3 = 0, '<failure message="expected"/>', ''), if((k + i) % 7 = 1, '<error type="Npe">trace</error>', ''),
               if((k + i) % 5 = 0, '<flakyFailure message="again">x</flakyFailure>', ''), '</testcase>')), ''),
             if(k % 2 = 0, '</testsuite></testsuites>', '</testsuite>'))""",
    ),
    "playwright": (
        "element_at(array('playwright-report/results.json', 'test-results/results.json', 'test-results.json'), cast(k % 3 as int) + 1)",
        """concat('{"suites":[{"title":"root', k % 10, '","tests":[{"title":"a', k, '","results":[{"status":"',
             if(k % 4 = 0, 'failed', 'passed'), '"}]}],"suites":[{"title":"inner","tests":[{"title":"b', k, '","results":[{"status":"',
             if(k % 5 = 0, 'timedOut', 'passed'), '"},{"status":"passed"}]}]',
             if(k % 6 = 0, concat(',"suites":[{"title":"deep","tests":[{"title":"c', k, '","results":[{"status":"timedOut"}]}]}]'), ''),
             '}]}]}')""",
    ),
    "bundle": (
        "if(k % 2 = 0, 'dist/stats.json', 'bundle-stats.json')",
        """to_json(named_struct('assets', transform(sequence(0, cast(k % 3 as int)), i -> named_struct(
             'name', concat('app', i, '.js'), 'size', (k * 7919 + i * 104729) % 2000000))))""",
    ),
    "build_metrics": (
        "if(k % 2 = 0, 'build-metrics.json', 'build-timings.json')",
        """to_json(named_struct('average_build_ms', cast(floor(o_totalprice) as bigint), 'p95_build_ms', cast(floor(o_totalprice) as bigint) + 30000))""",
    ),
    "manifest": (
        "'package.json'",
        """to_json(named_struct(
             'dependencies', map_from_entries(transform(sequence(0, cast(k % 7 as int)), i -> struct(
               element_at(array('lodash-es', 'lodash-fp', '@scope/lodash-merge', 'react-dom', 'express', 'left-pad', 'chalk'), i + 1),
               element_at(array('^0.1.2', 'latest', '^1.2.3', '*', '~2.0.0'), cast((k + i) % 5 as int) + 1)))),
             'devDependencies', map_from_entries(transform(sequence(0, cast(k % 3 as int)), i -> struct(
               element_at(array('express', 'vitest', 'react-dom'), i + 1), element_at(array('next', '^3.0.0'), cast((k + i) % 2 as int) + 1)))),
             'scripts', map_from_entries(transform(sequence(0, cast(k % 3 as int)), i -> struct(
               element_at(array('build', 'test', 'lint'), i + 1), 'run it')))))""",
    ),
    "wide_manifest": (
        "'package.json'",
        """to_json(named_struct('dependencies', map_from_entries(transform(sequence(1, cast(k % 120 as int) + 1), i -> struct(concat('dep', i), '1.2.3')))))""",
    ),
    "readme": (
        "if(k % 8 = 0, 'docs/readme.txt', 'README.md')",
        """concat('# Project ', k, '\\n', if(k % 2 = 0, '## Installation\\n', ''), if(k % 3 = 0, '## Usage: npm run build\\n', ''),
             if(k % 5 = 0, '## TESTING\\nnpm run test\\n', ''), if(k % 7 = 0, 'License: see file. Architecture below.\\n', ''),
             if(k % 4 = 0, 'Prerequisites and contributing\\n', ''))""",
    ),
    "adr": ("if(k % 3 = 0, 'docs/adr/0001-start.md', 'docs/adr/notes/x.md')", "'# Decision'"),
    "pom": (
        "'pom.xml'",
        """concat('<project>', repeat('<dependency><version>1.0</version></dependency>', cast(k % 60 as int)),
             if(k % 4 = 0, concat('<version>', k % 9, '.0-SNAPSHOT</version>'), ''), if(k % 5 = 0, '<artifactId>flyway-core</artifactId>', ''),
             '</project>')""",
    ),
    "entity": (
        "concat('src/main/java/com/shop/Order', k, '.java')",
        "if(k % 2 = 0, '@Entity\\npublic class Order { }', 'public class Order { }')",
    ),
    "env_example": (
        "'.env.example'",
        """concat('# settings\\nDB_URL=x\\nAPI_KEY_', k % 5, '=\\n\\nPORT = 80\\nUNUSED_', k % 3)""",
    ),
    "settings": (
        "'src/settings.ts'",
        """concat('export const url = process.env.DB_URL;\\nconst k = env.API_KEY_', k % 4, ';\\n',
             if(k % 2 = 0, 'System.getenv("PORT");', '@ConfigProperty(name = "UNUSED_1")'))""",
    ),
    "server_config": (
        "'src/main/resources/application.properties'",
        """concat('server.port=8080\\n', if(k % 2 = 0, 'management.endpoints.web.exposure.include=*\\n', ''),
             'spring.datasource.url=jdbc:postgresql://db', k % 9, ':5432/app\\n',
             if(k % 3 = 0, 'spring.datasource.password=', 'app.api_key='), if(k % 5 = 0, 'changeme_now', concat('s3cr3tValue', k)))""",
    ),
    "dotenv": ("element_at(array('.env', 'local.env', '.env.local', '.env.example', 'conf/env.txt'), cast(k % 5 as int) + 1)", "'A=1'"),
    "signal": (
        "element_at(array('pom.xml', 'build.gradle', 'angular.json', 'tsconfig.json', 'readme.txt'), cast(k % 5 as int) + 1)",
        "'x'",
    ),
    "second_signal": (
        "element_at(array('angular.json', 'tsconfig.json', 'src/a.ts'), cast(k % 3 as int) + 1)",
        "'x'",
    ),
    "third_signal": ("if(k % 2 = 0, 'playwright.config.ts', 'b.ts')", "'x'"),
    "ignore_file": (
        "'.auditignore'",
        """concat('# generated\\nrule-', k % 4, '\\n\\n  dry-violation : src/gen/ \\n*:vendor', k % 3, '/\\nother:\\n')""",
    ),
}


def project_files(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """The given files of every order's repository, as ``(repo, path, ext, content)``."""
    orders = spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice"))
    out = None
    for kind in kinds:
        path, content = PROJECT_FILES[kind]
        part = orders.select(
            F.concat(F.lit("order"), F.col("k").cast("string")).alias("repo"),
            F.expr(path).alias("path"),
            F.expr(content).alias("content"),
        )
        out = part if out is None else out.unionByName(part)
    return out.select("repo", "path", extname(F.col("path")).alias("ext"), "content")


# -- evaluation ---------------------------------------------------------------------------


SEVERITY_BY_KEY = "element_at(array('critical', 'high', 'medium', 'low', 'info'), cast(doc_id % 5 as int) + 1)"
DOMAIN_ARRAY = (
    "array('security', 'tests', 'architecture', 'conventions', 'performance', 'documentation', 'tech-debt', "
    "'accessibility', 'api-design', 'observability', 'i18n', 'ux-consistency')"
)


def labelled_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as low quality are the issues to find; the language is the fixture."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    low = table(spark, sf_dir, "labels").where(F.col("quality") == 0)
    return low.join(d, "doc_id").selectExpr(
        "lang AS fixture",
        "doc_id AS ord",
        "concat('GT-', doc_id) AS id",
        f"{SEVERITY_BY_KEY} AS severity",
        f"element_at({DOMAIN_ARRAY}, cast(doc_id % 12 as int) + 1) AS domain",
        "concat('low quality ', lang, ' text in ', source) AS title",
        "concat('./Docs/D', cast(floor(doc_id / 4) as bigint), '.md') AS file",
        "cast(doc_id % 4 * 3 + 1 as int) AS line",
        "toxic = 0 AS tool_detectable",
        "if(source < 'src2', concat('RC-', doc_id), null) AS root_cause",
    )


def flagged_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short documents, flagged by two tiers with three thresholds each."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    runs = F.explode(
        F.expr(
            "flatten(transform(array('A', 'B'), t -> transform(sequence(1, 3), r -> "
            "struct(t AS tier, r AS run, if(t = 'A', 500, 1200) + r * 100 AS limit))))"
        )
    ).alias("r")
    flagged = d.select("*", runs).where(F.col("n_chars") < F.col("r.limit"))
    return flagged.selectExpr(
        "lang AS fixture",
        "r.tier AS tier",
        "r.run AS run",
        "doc_id AS ord",
        "concat('F-', doc_id) AS id",
        f"{SEVERITY_BY_KEY} AS severity",
        f"element_at({DOMAIN_ARRAY}, cast(doc_id * 5 % 12 as int) + 1) AS domain",
        "if(doc_id % 2 = 0, 'short-text', 'few-lines') AS rule",
        "concat('short ', lang, ' text in ', source) AS title",
        "n_chars",
        """if(doc_id % 6 = 0,
             array(named_struct('file', concat('docs/d', cast(floor(doc_id / 4) as bigint), '.md'), 'line', cast(doc_id % 4 * 3 + 2 as int)),
                   named_struct('file', concat('docs/d', cast(floor(doc_id / 8) as bigint), '.md'), 'line', cast(doc_id % 7 as int))),
             array(named_struct('file', concat('docs/d', cast(floor(doc_id / 4) as bigint), '.md'), 'line', cast(doc_id % 4 * 3 + 2 as int)))) AS evidence""",
    )


def labelled_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cause per issue of the first sources, with three issues as symptoms."""
    t = labelled_truth(spark, sf_dir).where(F.col("root_cause").isNotNull())
    return t.selectExpr(
        "fixture",
        "root_cause AS id",
        "replace(title, 'low quality', 'decay of low') AS title",
        "array(id, concat('GT-', ord + 1), concat('GT-', ord + 4)) AS symptoms",
    )


def run_costs(predictions: DataFrame) -> DataFrame:
    """Cost of each run: characters read as tokens (unknown for tier B), a fixed time per finding."""
    return predictions.groupBy("fixture", "tier", "run").agg(
        F.sum(F.when(F.col("tier") == "A", F.col("n_chars"))).alias("token_count"),
        (F.count(F.lit(1)) * 10).alias("latency_ms"),
    )
