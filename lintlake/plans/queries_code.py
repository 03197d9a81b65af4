"""Registered queries over files: detectors, cross-file rules and report readers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions import scalars as X
from lintlake.operators import changes as CH
from lintlake.operators import cross as C
from lintlake.operators import imports as I
from lintlake.operators import routes as RT
from lintlake.operators import rules_file as RF
from lintlake.operators import rules_line as RL
from lintlake.operators import rules_repo as RR
from lintlake.operators import rules_span as RS
from lintlake.operators.detect import flat
from lintlake.policy import DEFAULT_POLICY
from lintlake.sources import files as SF
from lintlake.sources import reports as SR
from lintlake.sources import views as V
from lintlake.sources.views_projects import project_files

AS_OF = "2024-06-01"
CUSTOM = [("no-loose-total", r"total \+= \d+", "medium"), ("no-router", r"router\.get\(", "low")]
SHORT = replace(DEFAULT_POLICY, file_lengths=(20, 60), function_lengths=(2, 3))


def as_of():
    return F.to_date(F.lit(AS_OF))


def rows(findings: DataFrame) -> DataFrame:
    return flat(findings).drop("title")


# -- lines -------------------------------------------------------------------------


def numbered_lines(spark, sf):
    return RL.numbered_lines(V.code_files(spark, sf)).drop("ext")


def line_rules(spark, sf):
    return rows(RL.line_rules(V.code_files(spark, sf), as_of(), CUSTOM))


def line_rules_java(spark, sf):
    return rows(RL.line_rules(V.java_files(spark, sf)))


def secrets_docs(spark, sf):
    return rows(RL.secrets(V.document_files(spark, sf)))


def secrets_settings(spark, sf):
    return rows(RL.secrets(project_files(spark, sf, "server_config")))


def custom_patterns(spark, sf):
    files = V.code_files(spark, sf)
    return rows(RL.detect_on_lines(RL.numbered_lines(files), RL.custom_rules(CUSTOM)))


def todo_scan(spark, sf):
    return flat(RL.todos(V.code_files(spark, sf), as_of()))


def runtime_calls(spark, sf):
    return rows(RL.runtime_calls(V.code_files(spark, sf)))


def env_files(spark, sf):
    return rows(RL.committed_env_files(project_files(spark, sf, "dotenv")))


# -- files --------------------------------------------------------------------------


def java_security(spark, sf):
    return rows(RF.java_security(V.java_files(spark, sf)))


def server_config(spark, sf):
    return rows(RF.server_config(project_files(spark, sf, "server_config")))


def maven_manifest(spark, sf):
    return rows(RF.maven_manifest(project_files(spark, sf, "pom")))


def controllers(spark, sf):
    return rows(RF.controller_rules(V.java_files(spark, sf)))


def file_naming(spark, sf):
    return rows(RF.file_naming(V.code_files(spark, sf)))


def long_files(spark, sf):
    return rows(RF.file_lengths(V.code_files(spark, sf), SHORT))


def many_parameters(spark, sf):
    return rows(RF.parameter_counts(V.code_files(spark, sf)))


def magic_numbers(spark, sf):
    return rows(RF.magic_numbers(V.code_files(spark, sf)))


def test_quality(spark, sf):
    return rows(RF.test_quality(V.test_files(spark, sf)))


def complexity(spark, sf):
    return rows(RF.complexity(V.code_files(spark, sf)))


def deprecated_apis(spark, sf):
    return rows(RF.deprecated_apis(V.code_files(spark, sf)))


def deep_nesting(spark, sf):
    return rows(RF.deep_nesting(V.code_files(spark, sf)))


def persistence(spark, sf):
    return rows(RF.persistence(V.java_files(spark, sf)))


def file_rules(spark, sf):
    """All file rules in one pass over scripts and classes."""
    return rows(RF.file_rules(V.code_files(spark, sf).unionByName(V.java_files(spark, sf)), SHORT))


def a11y_pages(spark, sf):
    return rows(RF.accessibility(V.page_files(spark, sf)))


# -- spans ---------------------------------------------------------------------------


def component_templates(spark, sf):
    return rows(RF.accessibility(V.component_files(spark, sf)))


def function_spans(spark, sf):
    return RS.functions(V.code_files(spark, sf))


def long_functions(spark, sf):
    return rows(RS.function_lengths(V.code_files(spark, sf), SHORT))


def class_spans(spark, sf):
    return RS.classes(V.java_files(spark, sf))


def god_classes(spark, sf):
    return rows(RS.god_classes(V.java_files(spark, sf), methods=1, lines=8))


def swallowed_exceptions(spark, sf):
    return rows(RS.swallowed_exceptions(V.code_files(spark, sf)))


# -- repositories ------------------------------------------------------------------------


def manifest_dependencies(spark, sf):
    return SF.manifest_dependencies(project_files(spark, sf, "manifest"))


def dependency_rules(spark, sf):
    return rows(RR.dependency_rules(project_files(spark, sf, "manifest")))


def many_dependencies(spark, sf):
    return rows(RR.dependency_rules(project_files(spark, sf, "wide_manifest")))


def dep_prefixes(spark, sf):
    return rows(RR.duplicate_prefixes(project_files(spark, sf, "manifest")))


def pom_facts(spark, sf):
    return SF.pom_facts(project_files(spark, sf, "pom")).withColumn("snapshots", F.array_join("snapshots", ","))


def ignore_rules(spark, sf):
    return SF.ignore_rules(project_files(spark, sf, "ignore_file"), ".auditignore")


def profiles(spark, sf):
    return SF.detect_profiles(project_files(spark, sf, "signal", "second_signal", "third_signal"))


def readme_sections(spark, sf):
    return rows(RR.documentation(project_files(spark, sf, "readme", "adr", "manifest")))


def migration_tools(spark, sf):
    return rows(RR.missing_migration_tool(project_files(spark, sf, "entity", "pom")))


def observability(spark, sf):
    return rows(RR.observability(V.site_scripts(spark, sf)))


def i18n_library(spark, sf):
    return rows(RR.missing_i18n_library(V.site_scripts(spark, sf)))


def text_nodes(spark, sf):
    return RR.text_nodes(V.page_files(spark, sf))


def hardcoded_texts(spark, sf):
    return flat(RR.hardcoded_texts(V.page_files(spark, sf).unionByName(V.site_scripts(spark, sf))))


def hardcoded_colors(spark, sf):
    return flat(RR.hardcoded_colors(V.style_files(spark, sf)))


def style_values(spark, sf):
    return RR.style_values(V.style_files(spark, sf))


def style_sprawl(spark, sf):
    return flat(RR.style_sprawl(V.style_files(spark, sf)))


def inline_styles(spark, sf):
    return flat(RR.inline_styles(V.page_files(spark, sf)))


def magic_z_indexes(spark, sf):
    return flat(RR.magic_z_indexes(V.style_files(spark, sf)))


def reduced_motion(spark, sf):
    return rows(RR.missing_reduced_motion(V.style_files(spark, sf)))


# -- across files ---------------------------------------------------------------------------


def missing_tests(spark, sf):
    files = V.code_files(spark, sf).unionByName(V.test_files(spark, sf))
    return rows(C.missing_tests(files))


def dry_blocks(spark, sf):
    return flat(C.dry_violations(V.code_files(spark, sf)))


def exported_names(spark, sf):
    return C.exports(V.code_files(spark, sf))


def dead_exports(spark, sf):
    return rows(C.dead_exports(V.code_files(spark, sf)))


def dead_exports_by_token(spark, sf):
    return rows(C.dead_exports(V.code_files(spark, sf), mode="token"))


def stale_env_keys(spark, sf):
    return rows(C.stale_env_keys(project_files(spark, sf, "env_example", "settings")))


def import_list(spark, sf):
    return I.imports(V.java_files(spark, sf)).drop("ext")


def layer_violations(spark, sf):
    return flat(I.layer_violations(V.code_files(spark, sf)))


def layer_violations_java(spark, sf):
    policy = replace(DEFAULT_POLICY, layers=("shop",), allowed_dependencies={"presentation": ["application"], "application": ["domain"]})
    return flat(I.layer_violations(V.java_files(spark, sf), policy))


def import_edges(spark, sf):
    return I.import_edges(V.code_files(spark, sf))


def import_edges_java(spark, sf):
    return I.import_edges(V.java_files(spark, sf))


def import_cycles(spark, sf):
    return I.strong_components(V.supplier_edges(spark, sf))


def circular_dependencies(spark, sf):
    return rows(I.circular_dependencies(V.supplier_edges(spark, sf)))


def routes(spark, sf):
    files = V.code_files(spark, sf).unionByName(V.java_files(spark, sf))
    return RT.extract_routes(files)


def route_paths(spark, sf):
    files = V.code_files(spark, sf).unionByName(V.java_files(spark, sf))
    return rows(RT.path_rules(RT.extract_routes(files)))


def route_versions(spark, sf):
    files = V.code_files(spark, sf).unionByName(V.java_files(spark, sf))
    return flat(RT.missing_versioning(RT.extract_routes(files)))


# -- report readers -----------------------------------------------------------------------------


def npm_audit(spark, sf):
    return flat(SR.npm_audit(project_files(spark, sf, "npm_audit")))


def semgrep(spark, sf):
    return flat(SR.semgrep(project_files(spark, sf, "semgrep")))


def eslint(spark, sf):
    return flat(SR.eslint(project_files(spark, sf, "eslint"), "/work"))


def checkstyle(spark, sf):
    return flat(SR.checkstyle(project_files(spark, sf, "checkstyle"), "/work"))


def coverage(spark, sf):
    return rows(SR.coverage(project_files(spark, sf, "coverage")))


def junit_failures(spark, sf):
    return flat(SR.junit_failures(project_files(spark, sf, "junit")))


def junit_flaky(spark, sf):
    return flat(SR.flaky_junit(project_files(spark, sf, "junit")))


def playwright_failures(spark, sf):
    return flat(SR.playwright_failures(SR.playwright_tests(project_files(spark, sf, "playwright"))))


def playwright_flaky(spark, sf):
    return flat(SR.flaky_playwright(SR.playwright_tests(project_files(spark, sf, "playwright"))))


def bundle_stats(spark, sf):
    return rows(SR.bundle_stats(project_files(spark, sf, "bundle")))


def build_metrics(spark, sf):
    return rows(SR.build_metrics(project_files(spark, sf, "build_metrics")))


# -- scalar functions -----------------------------------------------------------------------------


def suggested_paths(spark, sf):
    """Kebab-case segments and noun paths for routes named after the parts."""
    p = V.table(spark, sf, "part")
    k = F.col("p_partkey")
    verb = F.element_at(F.array(*[F.lit(v) for v in ("get", "create", "list", "users", "find", "remove")]), (k % 6 + 1).cast("int"))
    name = F.replace(F.initcap("p_name"), F.lit(" "), F.when(k % 4 == 0, F.lit("_")).otherwise(F.lit("")))
    path = F.concat(F.lit("/api/"), verb, F.when(k % 5 == 0, F.lit("")).otherwise(name), F.lit("/:id"))
    return p.select(k.alias("part"), path.alias("path"), X.to_kebab(name).alias("kebab"), RT.to_noun_path(path).alias("noun_path"))


def size_labels(spark, sf):
    p = V.table(spark, sf, "lineitem")
    size = F.floor(F.col("l_extendedprice") * F.col("l_quantity")).cast("bigint")
    return p.select("l_orderkey", size.alias("bytes"), X.format_bytes(size).alias("label")).distinct()


def inferred_runs(spark, sf):
    """Tier and fixture of audit files from their names."""
    o = V.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "k")
    name = F.expr(
        "element_at(array('runs/tier-a-java-run', 'runs\\\\B-express_', 'out/C.', 'x_tierC.bench-ts-express-', 'plain-spring-'), cast(k % 5 as int) + 1)"
    )
    path = F.concat(name, F.col("k").cast("string"), F.lit(".json"))
    fixtures = ["bench-ts-express", "bench-java-spring", "bench-angular-app"]
    return o.select("k", X.infer_tier(path).alias("tier"), X.infer_fixture(path, fixtures).alias("fixture"))


# -- changes ------------------------------------------------------------------------


def _snapshots(spark, sf):
    return [CH.file_digests(f(spark, sf)) for f in (V.earlier_document_files, V.document_files)]


def changed_folders(spark, sf):
    return CH.changed_folders(*[CH.digest_tree(d) for d in _snapshots(spark, sf)])


def changed_paths(spark, sf):
    return CH.changed_paths(*_snapshots(spark, sf))


def changed_secrets(spark, sf):
    """Secrets in the files that a change added or edited."""
    return rows(RL.secrets(CH.changed_files(V.earlier_document_files(spark, sf), V.document_files(spark, sf))))


QUERIES = {
    f.__name__: f
    for f in (
        numbered_lines, line_rules, line_rules_java, secrets_docs, secrets_settings, custom_patterns, todo_scan,
        runtime_calls, env_files, java_security, server_config, maven_manifest, controllers, file_naming, long_files,
        many_parameters, magic_numbers, test_quality, complexity, deprecated_apis, deep_nesting, persistence, file_rules, a11y_pages, component_templates, many_dependencies,
        function_spans, long_functions, class_spans, god_classes, changed_folders, changed_paths, changed_secrets, swallowed_exceptions, manifest_dependencies, dependency_rules,
        dep_prefixes, pom_facts, ignore_rules, profiles, readme_sections, migration_tools, observability, i18n_library,
        text_nodes, hardcoded_texts, hardcoded_colors, style_values, style_sprawl, inline_styles, magic_z_indexes,
        reduced_motion, missing_tests, dry_blocks, exported_names, dead_exports, dead_exports_by_token, stale_env_keys,
        import_list, layer_violations, layer_violations_java, import_edges, import_edges_java, import_cycles,
        circular_dependencies, routes, route_paths, route_versions, npm_audit, semgrep, eslint, checkstyle, coverage,
        junit_failures, junit_flaky, playwright_failures, playwright_flaky, bundle_stats, build_metrics,
        suggested_paths, size_labels, inferred_runs,
    )
}
