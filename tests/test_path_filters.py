"""Repository rules read texts only of the files that they look into."""

import pytest

from lintlake.operators import rules_repo as RR

REPO = {
    "README.md": "# A\n## Installation\nnpm run build",
    "package.json": '{"scripts": {"build": "b", "test": "t"}}',
    "docs/adr/0001-start.md": "README Usage testing",
    "src/main/java/Order.java": "@Entity class Order { }",
    "sub/pom.xml": "<project/>",
    "notes.txt": "flyway @Entity app.get('/health', ok)",
}


def rules(findings):
    return sorted((r.repo, r.rule) for r in findings.select("repo", "rule").collect())


@pytest.fixture(scope="module")
def stored(spark, files_of, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("files") / "t")
    bare = {"src/main/java/Order.java": "@Entity class Order { }", "db/migration/V1__a.sql": "create table"}
    files_of(("a", REPO), ("b", bare), ("c", {"x.ts": "initTracer(); app.get('/health', ok)"}), ("d", {"my-pom.xml": "liquibase", "A.java": "@Entity"}), ("e", {"n/pom.xml": "liquibase", "A.java": "@Entity"})).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    formatted = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(formatted)


def test_documentation(stored):
    got = rules(RR.documentation(stored))
    assert ("b", "readme-required") in got and ("a", "readme-required") not in got
    assert ("a", "doc-code-drift") in got and ("a", "adr-missing") not in got and ("c", "adr-missing") in got
    text = plan(RR.documentation(stored))
    assert "In(path, [README.md,package.json])" in text.replace("package.json,README.md", "README.md,package.json")
    assert "ReadSchema: struct<repo:string,path:string>" in text


def test_migration_tool(stored):
    # b has migrations by a path only; e has a tool in a nested build file; a name that only ends alike (d) is no build file
    assert rules(RR.missing_migration_tool(stored)) == [("a", "jpa-no-migration-tool"), ("d", "jpa-no-migration-tool")]
    assert "StringEndsWith" in plan(RR.missing_migration_tool(stored))


def test_observability(stored):
    got = rules(RR.observability(stored))
    assert [x for x in got if x[1] == "missing-health-endpoint"] == [(r, "missing-health-endpoint") for r in "abde"]
    assert "In(ext" in plan(RR.observability(stored))
