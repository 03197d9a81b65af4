"""HTTP routes and the rules on their paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.text import matches_with_lines
from lintlake.operators.detect import SOURCE_EXTS, c, emit, finding, one, scope, text

# --- Fixed values: route and path patterns --------------------------------------------
ROUTERS = {
    "express": r"(?i)(?:router|app)\.(get|post|put|patch|delete|head)\s*\(\s*[\"'`]([^\"'`]+)[\"'`]",
    "nest": r"(?i)@(?:Get|Post|Put|Patch|Delete)\s*\(\s*[\"'`]([^\"'`]*)[\"'`]\s*\)",
    "spring": (
        r"(?i)@(?:GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping|RequestMapping)"
        r"\s*\(\s*(?:value\s*=\s*)?[\"']([^\"']+)[\"']"
    ),
}
UNKNOWN_METHOD = "rest"
VERBS = "get|create|add|delete|remove|update|edit|fetch|retrieve|list|find"
VERB_IN_PATH = rf"(?i)/({VERBS})(?=[A-Z_\-/]|$)"
VERSION_IN_PATH = r"(?i)/(?:api/)?v\d+/"
NOT_KEBAB = r"[a-z][A-Z]|[A-Z]{2}|_"
MIN_ROUTES = 3
# -----------------------------------------------------------------------------------------


def extract_routes(files: DataFrame) -> DataFrame:
    """Routes ``(repo, file, pos, path, method, line)`` in the order of a file's extractors."""

    def routes(kind: str) -> Column:
        pattern = ROUTERS[kind]
        group = 2 if kind == "express" else 1
        return F.transform(
            matches_with_lines(c.content, pattern),
            lambda m: F.struct(
                F.regexp_extract(m["text"], pattern, group).alias("path"),
                (F.regexp_extract(m["text"], pattern, 1) if kind == "express" else F.lit(UNKNOWN_METHOD)).alias("method"),
                m["line"].alias("line"),
            ),
        )

    every = F.concat(*[routes(k) for k in ROUTERS])
    return (
        scope(files, SOURCE_EXTS)
        .select("repo", F.col("path").alias("file"), F.posexplode(every).alias("pos", "r"))
        .select("repo", "file", "pos", "r.path", "r.method", "r.line")
    )


def bad_segment(path: Column) -> Column:
    """First segment that is not kebab-case, leaving out parameters and reported verbs."""
    verbal = path.rlike(VERB_IN_PATH)
    segments = F.filter(
        F.split(path, "/"),
        lambda s: (s != "")
        & ~F.startswith(s, F.lit(":"))
        & ~F.startswith(s, F.lit("{"))
        & ~(verbal & F.concat(F.lit("/"), s).rlike(VERB_IN_PATH))
        & s.rlike(NOT_KEBAB),
    )
    return F.get(segments, F.lit(0))


def to_noun_path(path: Column) -> Column:
    """The path with its first verb replaced by the noun that follows it."""
    whole = rf"(?i)^(.*?)/({VERBS})(?=[A-Z_\-/]|$)(.*)$"
    before, verb, after = (F.regexp_extract(path, whole, i) for i in (1, 2, 3))
    owner = F.get(
        F.filter(
            F.split(path, "/"),
            lambda s: F.contains(F.lower(s), F.lower(verb)) & (F.length(s) > F.length(verb)),
        ),
        F.lit(0),
    )
    at = F.instr(F.lower(owner), F.lower(verb))
    noun = F.concat(F.substr(owner, F.lit(1), at - 1), F.substr(owner, at + F.length(verb)))
    return F.when(
        path.rlike(VERB_IN_PATH),
        F.concat(before, F.when(owner.isNotNull(), F.concat(F.lit("/"), noun)).otherwise(F.lit("/resources")), after),
    ).otherwise(path)


def path_rules(routes: DataFrame) -> DataFrame:
    """Verbs and spelling in route paths, row by row."""
    place = one(c.file, c.line)
    return emit(
        routes.withColumn("segment", bad_segment(c.path)),
        F.when(
            c.path.rlike(VERB_IN_PATH),
            finding("verb-based-resource-name", "medium", text("Verb in a resource name: ", c.path), place),
        ),
        F.when(
            c.segment.isNotNull(),
            finding("non-kebab-case-path", "low", text('Segment is not kebab-case: "', c.segment, '"'), place),
        ),
    )


def missing_versioning(routes: DataFrame) -> DataFrame:
    """Repositories with routes of which none has a version."""
    facts = routes.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(c.path.rlike(VERSION_IN_PATH)).alias("versioned"),
        F.min(F.struct("file", "pos", "line")).alias("first"),
    )
    return emit(
        facts.where((c.n >= MIN_ROUTES) & ~c.versioned),
        finding("missing-api-versioning", "low", text("No version in ", c.n, " routes"), one(F.col("first.file"), F.col("first.line"))),
    )
