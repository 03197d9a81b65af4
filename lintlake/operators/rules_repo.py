"""Repository rules: partial aggregation of per-file flags and counts.

The file contents are read in a narrow projection; only flags, counts and a few
samples per file reach a shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.scalars import basename, trimmed
from lintlake.functions.text import count_of, found, lines_of, matches_with_lines, numbered
from lintlake.operators.detect import (
    SAMPLES,
    SOURCE_EXTS,
    STYLE_EXTS,
    c,
    emit,
    finding,
    one,
    place,
    repo_samples,
    sample_array,
    scope,
    text,
    union_all,
)
from lintlake.operators.positions import first_k
from lintlake.sources.files import dependency_entries, parsed_manifests

# --- Fixed values: lists, patterns, limits --------------------------------------------
MAX_DEPENDENCIES, MIN_SAME_PREFIX = 80, 3
UNPINNED = r"(?i)^(?:\*|latest|next)$"
PRE_RELEASE = r"^\^?0\."
MANY_UNSTABLE, UNSTABLE_SAMPLES = 8, 3

README = "README.md"
REQUIRED_SECTIONS = ["installation", "usage", "testing"]
RECOMMENDED_SECTIONS = ["prerequisites", "contributing", "license", "architecture"]
DECISION_RECORD = r"(?i)^docs/adrs?/[^/]*\.md$"
DOCUMENTED_SCRIPTS = ["build", "test", "lint"]

ENTITY = r"@Entity\b"
MIGRATION_FILE = (
    r"(?i)(?:^|/)changelog-master\.(xml|ya?ml|json)$|/db/changelog/|/db/migration/|(?:^|/)V\d+__[^/]*\.sql$"
)
BUILD_FILES = ["pom.xml", "build.gradle", "build.gradle.kts"]
MIGRATION_TOOL = r"(?i)liquibase|flyway"

HEALTH_ROUTE = (
    r"(?i)(?:\b(?:app|router|server|fastify)\s*\.\s*(?:get|use|head|all)|\b(?:get|head|all)\s*\()\s*\(?\s*"
    r"[\"'`]/(?:health|ready|readiness|liveness|ping|status)(?:[/?][^\"'`]*)?[\"'`]"
)
HEALTH_HANDLER = r"(?i)(?:route|endpoint)\s*[:=]\s*[\"'`]/(?:health|ready|readiness|liveness|ping|status)(?:[/?][^\"'`]*)?[\"'`]"
HEALTH_MAPPING = r"(?i)@GetMapping\s*\(\s*[\"']/(?:health|ready|actuator)[^\"']*[\"']\s*\)"
ACTUATOR_DEPENDENCY = r"spring-boot-starter-actuator"
MANAGEMENT_KEY = r"management[\s.:]+endpoint|management[\s.:]+endpoints"
SERVER_CONFIG_EXTS = [".properties", ".yml", ".yaml"]
ENTRY_FILE = r"index\.(ts|js)$"
TRACING = r"(?i)(?:@opentelemetry|opentelemetry|jaegerClient|zipkin|NodeTracerProvider|trace\.getTracer|initTracer)"
MIN_FILES = 5

I18N_PIPE = r"\|\s*(?:translate|i18nSelect|i18nPlural|async)"
I18N_ATTRIBUTE = r"\bi18n(?:-[a-z]+)?\b"
I18N_CALL = r"(?:\bt\s*\(|i18n\.t\s*\(|useTranslation|<FormattedMessage|intl\.formatMessage)"
I18N_LIBRARY = r"(?:ngx-translate|@ngx-translate|TranslateModule|i18next|react-intl|react-i18next|vue-i18n|format\.js)"
TEXT_NODE = r">([^<{}\n]{4,80})<"
NOT_A_TEXT = (
    r"^[\s\d\-_./\\@#%^*+=|<>{}\[\]()!?,;:'\"`~&$]+$"
    r"|(?i)^(?:true|false|null|undefined|NaN|Infinity|class|function|import|export|const|let|var|if|else|for|while"
    r"|return|void|type|interface|enum)$"
)
HAS_WORD = r"[a-zA-Z]{2,}"
BINDING_SYNTAX = r"\[|\]|\(|\)|\*ng|\{\{|#|\bclass\b"
PATH_OR_URL = r"^(?:/|https?:|\./|\.\./)"
TEXT_TEMPLATE_EXTS, SCRIPT_EXTS = [".html", ".jsx", ".tsx"], [".ts", ".js"]
MIN_HARDCODED_TEXTS, MIN_TEXT_LENGTH = 3, 4

TOKEN_FILES = [
    r"variables\.(css|scss|less)$",
    r"tokens?\.(css|scss|less|json|ts|js)$",
    r"theme\.(ts|js|css|scss)$",
    r"design-tokens",
    r"tailwind\.config",
]
HEX_COLOR = r"#(?:[0-9a-fA-F]{3,4}){1,2}\b"
FUNCTION_COLOR = r"(?i)(?:rgba?|hsla?)\s*\([^)]+\)"
NEUTRAL_COLORS = ["#000", "#000000", "#fff", "#ffffff"]
TOKEN_DEFINITION_LINE = r"(?i)^\s*--[a-z]|^\s*\$[a-z]"
VAR_USE, SCSS_VAR, VAR_DEFINITION = r"(?i)var\(\s*--[a-z0-9-]+", r"(?i)\$[a-z][a-z0-9_-]*", r"(?i)--[a-z][a-z0-9-]*\s*:"
VAR_MARGIN, MIN_COLORS, MANY_COLORS = 3, 5, 20
FONT_FAMILY = r"(?i)font-family\s*:\s*([^;}{]+)"
NO_FAMILY = r"^(?:inherit|initial|unset|var\()"
FONT_SIZE = r"(?i)font-size\s*:\s*(\d+(?:\.\d+)?(?:px|rem|em))"
INLINE_STYLE = r"(?i)\bstyle\s*=\s*[\"'][^\"']{10,}[\"']"
MIN_INLINE_STYLES, MANY_INLINE_STYLES = 3, 10
Z_INDEX = r"(?i)z-index\s*:\s*(\d+)"
MAX_Z_INDEX = 99
BOX_SHADOW = r"(?i)box-shadow\s*:\s*(?!var\(|none|\$|inherit|initial|unset)([^;}{]+)"
DURATION = r"(?i)(?:transition(?:-duration)?|animation-duration)\s*:\s*[^;}{]*?(\d+(?:\.\d+)?m?s)"
BREAKPOINT = r"(?i)@media[^{]*\(\s*(?:min|max)-width\s*:\s*(\d+(?:\.\d+)?(?:px|em|rem))\s*\)"
ANIMATION, REDUCED_MOTION = r"(?i)@keyframes|animation\s*:", r"(?i)prefers-reduced-motion"
MAX_FAMILIES, MAX_SIZES, MAX_SHADOWS, MAX_DURATIONS, MAX_BREAKPOINTS = 3, 10, 5, 4, 5
SHADOW_SAMPLES = 3
# -----------------------------------------------------------------------------------------


def any_of(cond: Column) -> Column:
    return F.coalesce(F.max(F.coalesce(cond, F.lit(False))), F.lit(False))


def without_content(files: DataFrame) -> DataFrame:
    """The files by their paths: a scan of them reads no texts."""
    return files.withColumn("content", F.lit(None).cast("string"))


def whole_repo(name: str = ".") -> Column:
    return one(F.lit(name))


# -- manifests ------------------------------------------------------------------------------


def dependency_rules(files: DataFrame) -> DataFrame:
    """Too many dependencies, and unstable ones; one manifest is one row, so nothing is shuffled."""
    deps = parsed_manifests(files).select("repo", dependency_entries().alias("deps"))
    unstable = F.filter("deps", lambda d: d["version"].rlike(UNPINNED) | d["version"].rlike(PRE_RELEASE))
    f = deps.select("repo", F.size("deps").alias("n"), unstable.alias("unstable"))
    return emit(
        f,
        F.when(
            c.n > MAX_DEPENDENCIES,
            finding("excessive-dependencies", "medium", text("Many dependencies: ", c.n), whole_repo("package.json")),
        ),
        F.when(
            F.size("unstable") > 0,
            finding(
                "dependency-staleness-risk",
                F.when(F.size("unstable") > MANY_UNSTABLE, F.lit("medium")).otherwise(F.lit("low")),
                text("Unstable dependency ranges: ", F.size("unstable")),
                F.transform(
                    F.slice("unstable", 1, UNSTABLE_SAMPLES),
                    lambda d: place(F.lit("package.json"), None, F.concat(d["name"], F.lit(": "), d["version"])),
                ),
            ),
        ),
    )


def duplicate_prefixes(files: DataFrame) -> DataFrame:
    names = parsed_manifests(files).select("repo", F.explode(dependency_entries()).alias("d")).select("repo", "d.name")
    bare = F.regexp_replace("name", "^@[^/]+/", "")
    prefixes = (
        names.where(F.contains(bare, F.lit("-")))
        .groupBy("repo", F.substring_index(bare, "-", 1).alias("prefix"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(c.n >= MIN_SAME_PREFIX)
    )
    return emit(
        prefixes,
        finding(
            "potential-duplicate-deps", "low", text("Packages that share the prefix '", c.prefix, "': ", c.n),
            whole_repo("package.json"),
        ),
    )


# -- documentation ----------------------------------------------------------------------------


def documentation(files: DataFrame) -> DataFrame:
    """README presence and sections, decision records, scripts the README does not mention.

    One aggregation over flags. A path filter, pushed to the scan, leaves the contents of README and
    manifest; all files contribute their path in a scan that reads no texts. Flags don't mind rows twice.
    """
    readme, manifest = c.path == README, c.path == "package.json"
    lowered = F.when(readme, F.lower("content"))
    scripts = F.from_json(F.when(manifest, c.content), "scripts MAP<STRING,STRING>")["scripts"]
    sections = [*REQUIRED_SECTIONS, *RECOMMENDED_SECTIONS]
    flags = [any_of(readme).alias("has_readme"), any_of(c.path.rlike(DECISION_RECORD)).alias("has_adr"), any_of(manifest).alias("has_manifest")]
    flags += [any_of(F.contains(lowered, F.lit(s))).alias(f"sec_{s}") for s in sections]
    for s in DOCUMENTED_SCRIPTS:
        flags.append(any_of(F.length(F.try_element_at(scripts, F.lit(s))) > 0).alias(f"script_{s}"))
        flags.append(any_of(F.contains(lowered, F.lit(f"npm run {s}"))).alias(f"named_{s}"))
    named = files.where(c.path.isin(README, "package.json"))
    facts = without_content(files).unionByName(named).groupBy("repo").agg(*flags)

    def section(name: str) -> Column:
        rule, severity = (
            ("readme-section-missing", "medium")
            if name in REQUIRED_SECTIONS
            else ("readme-recommended-section-missing", "low")
        )
        return F.when(
            c.has_readme & ~F.col(f"sec_{name}"),
            finding(rule, severity, F.lit(f"README has no section: {name}"), whole_repo(README)),
        )

    def drift(name: str) -> Column:
        return F.when(
            c.has_readme & F.col(f"script_{name}") & ~F.col(f"named_{name}"),
            finding(
                "doc-code-drift", "low", F.lit(f"README does not mention the script: {name}"),
                F.array(place(F.lit("package.json"), None, F.lit(f"scripts.{name}")), place(F.lit(README))),
            ),
        )

    return emit(
        facts,
        F.when(~c.has_readme, finding("readme-required", "high", F.lit("No README"), whole_repo(README))),
        F.when(~c.has_adr, finding("adr-missing", "low", F.lit("No decision records"), whole_repo("docs/adr"))),
        *[section(s) for s in sections],
        *[drift(s) for s in DOCUMENTED_SCRIPTS],
    )


# -- persistence --------------------------------------------------------------------------------


def missing_migration_tool(files: DataFrame) -> DataFrame:
    """Repositories with entities but no migrations; texts are read of Java and build files only."""
    rooted = F.concat(F.lit("/"), c.path)
    build = reduce(or_, [c.path.isin(BUILD_FILES), *[c.path.endswith(f"/{b}") for b in BUILD_FILES]])
    migrations = without_content(files).where(rooted.rlike(MIGRATION_FILE))
    facts = scope(files.where((c.ext == ".java") | build).unionByName(migrations)).groupBy("repo").agg(
        any_of((c.ext == ".java") & c.content.rlike(ENTITY)).alias("entities"),
        any_of(rooted.rlike(MIGRATION_FILE)).alias("migrations"),
        any_of(basename(c.path).isin(BUILD_FILES) & c.content.rlike(MIGRATION_TOOL)).alias("tool"),
    )
    return emit(
        facts.where(c.entities & ~c.migrations & ~c.tool),
        finding(
            "jpa-no-migration-tool", "medium", F.lit("Entities without a migration tool"),
            one(F.lit("pom.xml"), None, F.lit("No liquibase/flyway dependency found")),
        ),
    )


# -- observability --------------------------------------------------------------------------------


def observability(files: DataFrame) -> DataFrame:
    """Health endpoint and tracing, from flags of the sources, build and settings files of a repository."""
    source = c.ext.isin(SOURCE_EXTS)
    read = source | c.path.isin(BUILD_FILES) | c.ext.isin(SERVER_CONFIG_EXTS)
    healthy = source & (c.content.rlike(HEALTH_ROUTE) | c.content.rlike(HEALTH_HANDLER) | c.content.rlike(HEALTH_MAPPING))
    configured = (c.path.isin(BUILD_FILES) & c.content.rlike(ACTUATOR_DEPENDENCY)) | (
        c.ext.isin(SERVER_CONFIG_EXTS) & c.content.rlike(MANAGEMENT_KEY)
    )
    facts = scope(files.where(read)).groupBy("repo").agg(
        F.count(F.when(source, 1)).alias("n"),
        any_of(healthy | configured).alias("health"),
        any_of(source & c.content.rlike(TRACING)).alias("tracing"),
        F.min(F.when(source & c.path.rlike(ENTRY_FILE), c.path)).alias("entry"),
        F.min(F.when(source, c.path)).alias("first"),
    )
    return emit(
        facts,
        F.when(
            ~c.health & (c.n > 0),
            finding("missing-health-endpoint", "medium", F.lit("No health endpoint"), one(F.coalesce("entry", "first"), F.lit(1))),
        ),
        F.when(
            ~c.tracing & (c.n >= MIN_FILES),
            finding("missing-tracing", "low", F.lit("No tracing"), whole_repo()),
        ),
    )


# -- internationalisation ----------------------------------------------------------------------------


def i18n_facts(files: DataFrame) -> DataFrame:
    script = c.ext.isin(SCRIPT_EXTS)
    return scope(files, [*TEXT_TEMPLATE_EXTS, *SCRIPT_EXTS]).groupBy("repo").agg(
        F.count(F.when(script, 1)).alias("scripts"),
        any_of(script & (c.content.rlike(I18N_CALL) | c.content.rlike(I18N_LIBRARY))).alias("library"),
    )


def missing_i18n_library(files: DataFrame) -> DataFrame:
    return emit(
        i18n_facts(files).where(~c.library & (c.scripts >= MIN_FILES)),
        finding("missing-i18n-library", "low", F.lit("No translation library"), whole_repo()),
    )


def is_user_facing(node: Column) -> Column:
    return (
        (F.length(node) >= MIN_TEXT_LENGTH)
        & ~node.rlike(NOT_A_TEXT)
        & node.rlike(HAS_WORD)
        & ~node.rlike(BINDING_SYNTAX)
        & ~node.rlike(PATH_OR_URL)
    )


def text_of_node(match: Column) -> Column:
    return trimmed(F.regexp_extract(match, TEXT_NODE, 1))


def text_nodes(files: DataFrame) -> DataFrame:
    """User-facing text nodes of all templates, one row each."""
    f = scope(files, TEXT_TEMPLATE_EXTS)
    nodes = F.filter(F.transform(found(c.content, TEXT_NODE, 1), trimmed), is_user_facing)
    return f.select("repo", "path", F.posexplode(nodes).alias("pos", "text"))


def hardcoded_texts(files: DataFrame) -> DataFrame:
    """Untranslated texts in templates of repositories (or files) that translate others."""
    library = i18n_facts(files).select("repo", "library")
    templates = scope(files, TEXT_TEMPLATE_EXTS)
    nodes = F.filter(matches_with_lines(c.content, TEXT_NODE), lambda m: is_user_facing(text_of_node(m["text"])))
    in_file = c.content.rlike(I18N_PIPE) | c.content.rlike(I18N_ATTRIBUTE) | c.content.rlike(I18N_CALL)
    per_file = templates.select(
        "repo", "path", in_file.alias("in_file"),
        F.size(F.filter(F.transform(found(c.content, TEXT_NODE, 1), trimmed), is_user_facing)).alias("n"),
        F.transform(F.slice(nodes, 1, SAMPLES), lambda m: F.struct(m["line"], F.lit(None).cast("string").alias("snippet"))).alias("samples"),
    ).where(c.n > 0)
    relevant = per_file.join(library, "repo", "left").where(c.in_file | F.coalesce("library", F.lit(False)))
    return emit(
        repo_samples(relevant).where(c.n >= MIN_HARDCODED_TEXTS),
        finding("hardcoded-template-string", "medium", text(c.n, " untranslated texts in templates"), c.evidence),
    )


# -- visual consistency ---------------------------------------------------------------------------------


def is_token_file(path: Column) -> Column:
    name = F.lower(basename(path))
    cond = F.lit(False)
    for p in TOKEN_FILES:
        cond = cond | name.rlike(p)
    return cond


def styled_files(files: DataFrame, exts) -> DataFrame:
    return scope(files, exts).where(~is_token_file(c.path))


def hardcoded_colors(files: DataFrame) -> DataFrame:
    """Color literals outside token definitions, per repository."""
    free = F.filter(numbered(c.lines), lambda l: ~l["text"].rlike(TOKEN_DEFINITION_LINE) & F.contains(l["text"], F.lit("#")))
    hexes = F.flatten(
        F.transform(
            free,
            lambda l: F.transform(
                F.filter(found(l["text"], HEX_COLOR), lambda m: ~F.lower(m).isin(NEUTRAL_COLORS)),
                lambda m: F.struct(m.alias("text"), l["line"].alias("line")),
            ),
        )
    )
    uses = count_of(c.content, VAR_USE) + count_of(c.content, SCSS_VAR)
    literal_style = uses < count_of(c.content, VAR_DEFINITION) + VAR_MARGIN
    functional = F.filter(
        matches_with_lines(c.content, FUNCTION_COLOR),
        lambda m: ~F.element_at(c.lines, m["line"]).rlike(TOKEN_DEFINITION_LINE),
    )
    hits = F.concat(hexes, F.when(literal_style, functional).otherwise(F.slice(functional, 1, 0)))
    lined = styled_files(files, [*STYLE_EXTS, *TEXT_TEMPLATE_EXTS]).withColumn("lines", lines_of(c.content))
    per_file = lined.select("repo", "path", hits.alias("hits"))
    per_file = per_file.select("repo", "path", F.size("hits").alias("n"), sample_array(c.hits).alias("samples"))
    return emit(
        repo_samples(per_file).where(c.n >= MIN_COLORS),
        finding(
            "hardcoded-color", F.when(c.n >= MANY_COLORS, F.lit("high")).otherwise(F.lit("medium")),
            text(c.n, " literal colors"), c.evidence,
        ),
    )


def style_values(files: DataFrame) -> DataFrame:
    """Distinct style values ``(repo, kind, value)`` of all stylesheets."""

    def lowered(pattern: str) -> Column:
        return F.transform(found(c.content, pattern, 1), F.lower)

    families = F.transform(
        found(c.content, FONT_FAMILY, 1),
        lambda v: F.regexp_replace(trimmed(F.element_at(F.split(v, ","), 1)), "[\"']", ""),
    )
    families = F.transform(F.filter(families, lambda v: (F.length(v) > 1) & ~v.rlike(NO_FAMILY)), F.lower)
    shadows = F.filter(F.transform(found(c.content, BOX_SHADOW, 1), trimmed), lambda v: v != "")
    kinds = {
        "family": families,
        "size": lowered(FONT_SIZE),
        "shadow": shadows,
        "duration": lowered(DURATION),
        "breakpoint": lowered(BREAKPOINT),
    }
    tagged = [_tagged(kind, values) for kind, values in kinds.items()]
    return (
        styled_files(files, STYLE_EXTS)
        .select("repo", F.explode(F.concat(*tagged)).alias("v"))
        .select("repo", "v.kind", "v.value")
        .distinct()
    )


def _tagged(kind: str, values: Column) -> Column:
    return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def style_sprawl(files: DataFrame) -> DataFrame:
    """Too many different fonts, sizes, shadows, durations or breakpoints."""
    counts = style_values(files).groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n"))

    def sprawl(kind: str, limit: int, rule: str, severity: str, label: str) -> Column:
        return F.when(
            (c.kind == kind) & (c.n > limit), finding(rule, severity, text(c.n, f" different {label}"), whole_repo())
        )

    plain = emit(
        counts,
        sprawl("family", MAX_FAMILIES, "font-family-proliferation", "medium", "font families"),
        sprawl("size", MAX_SIZES, "font-size-sprawl", "medium", "font sizes"),
        sprawl("duration", MAX_DURATIONS, "inconsistent-durations", "low", "durations"),
        sprawl("breakpoint", MAX_BREAKPOINTS, "breakpoint-inconsistency", "low", "breakpoints"),
    )
    shadows = matches_with_lines(c.content, BOX_SHADOW, SHADOW_SAMPLES)
    per_file = styled_files(files, STYLE_EXTS).select(
        "repo", "path", count_of(c.content, BOX_SHADOW).alias("n"), sample_array(shadows, SHADOW_SAMPLES).alias("samples")
    )
    many = counts.where((c.kind == "shadow") & (c.n > MAX_SHADOWS)).select("repo", c.n.alias("shadows"))
    shadowed = repo_samples(per_file, SHADOW_SAMPLES).join(many, "repo")
    return plain.unionByName(
        emit(
            shadowed,
            finding("shadow-sprawl", "medium", text(c.shadows, " different shadows"), c.evidence),
        )
    )


def inline_styles(files: DataFrame) -> DataFrame:
    hits = matches_with_lines(c.content, INLINE_STYLE, SAMPLES)
    per_file = styled_files(files, TEXT_TEMPLATE_EXTS).select(
        "repo", "path", count_of(c.content, INLINE_STYLE).alias("n"), sample_array(hits).alias("samples")
    )
    return emit(
        repo_samples(per_file, with_snippet=True).where(c.n >= MIN_INLINE_STYLES),
        finding(
            "inline-style-proliferation", F.when(c.n >= MANY_INLINE_STYLES, F.lit("high")).otherwise(F.lit("medium")),
            text(c.n, " inline styles"), c.evidence,
        ),
    )


def magic_z_indexes(files: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Large z-index values: all are counted, the first ``samples`` are shown."""
    hits = F.filter(
        matches_with_lines(c.content, Z_INDEX),
        lambda m: F.regexp_extract(m["text"], Z_INDEX, 1).cast("double") > MAX_Z_INDEX,
    )
    per_file = (
        styled_files(files, STYLE_EXTS).where(F.contains(F.lower("content"), F.lit("z-index")))
        .select("repo", "path", hits.alias("hits"))
        .select("repo", "path", F.size("hits").alias("n"), sample_array(c.hits, samples).alias("samples"))
    )
    return emit(
        repo_samples(per_file, samples, with_snippet=True),
        finding("magic-zindex", "medium", text(c.n, " large z-index values"), c.evidence),
    )


def missing_reduced_motion(files: DataFrame) -> DataFrame:
    facts = styled_files(files, [*STYLE_EXTS, *TEXT_TEMPLATE_EXTS]).groupBy("repo").agg(
        any_of(c.content.rlike(ANIMATION)).alias("animated"), any_of(c.content.rlike(REDUCED_MOTION)).alias("considerate")
    )
    return emit(
        facts.where(c.animated & ~c.considerate),
        finding("missing-reduced-motion", "medium", F.lit("Animations ignore reduced motion"), whole_repo()),
    )


def ux_consistency(files: DataFrame) -> DataFrame:
    return union_all(
        [
            hardcoded_colors(files),
            style_sprawl(files),
            inline_styles(files),
            magic_z_indexes(files),
            missing_reduced_motion(files),
        ]
    )
