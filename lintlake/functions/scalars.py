"""Scalar functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake.schema import SEVERITIES, SEVERITY_RANK

# --- Fixed values: lookup tables --------------------------------------------
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "none"}
NPM_SEVERITY = {"critical": "critical", "high": "high", "moderate": "medium", "low": "low", "info": "info"}
SEMGREP_SEVERITY = {"CRITICAL": "critical", "ERROR": "high", "WARNING": "medium", "INFO": "info"}
FALLBACK_IMPACT = {"critical": 90, "high": 70, "medium": 40, "low": 20, "info": 10}
FALLBACK_DELTA = {"critical": 4.0, "high": 2.0, "medium": 1.0, "low": 0.5, "info": 0.2}
FALLBACK_BATCH = {"critical": "fix_now", "high": "next_sprint"}
BATCH_LABEL = {"fix_now": "Fix Now", "next_sprint": "Next Sprint"}
WHITESPACE = " \t\n\r\f\x0b\u00a0\ufeff"
TITLE_SIMILARITY = 0.4
MAX_SNIPPET = 120
# ----------------------------------------------------------------------------


def lookup(col: Column, table: dict, default=None) -> Column:
    """CASE over a small literal table."""
    branches = reduce(
        lambda acc, kv: acc.when(col == F.lit(kv[0]), F.lit(kv[1])),
        list(table.items())[1:],
        F.when(col == F.lit(next(iter(table))), F.lit(next(iter(table.values())))),
    )
    return branches if default is None else branches.otherwise(F.lit(default))


def severity_rank(col: Column) -> Column:
    return lookup(col, SEVERITY_RANK, 0)


def severity_of_rank(col: Column) -> Column:
    return lookup(col, {SEVERITY_RANK[s]: s for s in SEVERITIES}, "info")


def trimmed(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def snippet(col: Column, size: int = MAX_SNIPPET) -> Column:
    return F.substring(trimmed(col), 1, size)


def js_round(col: Column, digits: int = 0) -> Column:
    """Half-up rounding by floor arithmetic, also for negative input."""
    if digits == 0:
        return F.floor(col + F.lit(0.5))
    scale = float(10**digits)
    return F.floor(col * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def normalize_path(col: Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(col, F.lit("\\"), F.lit("/")), r"^\./", ""))


def basename(col: Column) -> Column:
    return F.substring_index(col, "/", -1)


def dirname(col: Column) -> Column:
    """Directory part; ``.`` for a bare file name and ``/`` for a file in the root."""
    return (
        F.when(~F.contains(col, F.lit("/")), F.lit("."))
        .when(col.rlike("^/[^/]*$"), F.lit("/"))
        .otherwise(F.regexp_replace(col, "/[^/]*$", ""))
    )


def extname(col: Column) -> Column:
    """Extension with its dot; empty for names without one or with a leading dot only."""
    return F.regexp_extract(basename(col), r"^.+?(\.[^.]*)$", 1)


def title_words(col: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(col), "[^a-z0-9]", " ")
    return F.array_distinct(F.filter(F.split(cleaned, r"\s+"), lambda w: F.length(w) > 2))


def word_jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    )


def fuzzy_title_match(a: Column, b: Column) -> Column:
    return word_jaccard(title_words(a), title_words(b)) >= TITLE_SIMILARITY


def capitalize(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.substring(col, 2, 1 << 30))


def root_cause_label(col: Column) -> Column:
    return F.array_join(F.transform(F.split(col, "-"), capitalize), " ")


def format_bytes(col: Column) -> Column:
    mib = 1024.0 * 1024.0
    return (
        F.when(col >= mib, F.format_string("%.2f MiB", col / F.lit(mib)))
        .when(col >= 1024, F.format_string("%.1f KiB", col / F.lit(1024.0)))
        .otherwise(F.concat(col.cast("bigint").cast("string"), F.lit(" B")))
    )


def age_days(day: Column, as_of: Column) -> Column:
    return F.datediff(as_of, day)


def to_kebab(seg: Column) -> Column:
    step = F.replace(seg, F.lit("_"), F.lit("-"))
    step = F.regexp_replace(step, "([a-z])([A-Z])", "$1-$2")
    step = F.regexp_replace(step, "([A-Z]+)([A-Z][a-z])", "$1-$2")
    return F.lower(step)


def java_package_path(spec: Column) -> Column:
    """``com.shop.Order`` as a rooted path, so that layer patterns can match it."""
    return F.when(
        F.contains(spec, F.lit(".")) & ~F.contains(spec, F.lit("/")),
        F.concat(F.lit("/"), F.replace(spec, F.lit("."), F.lit("/"))),
    ).otherwise(spec)


def resolve_relative(source_path: Column, spec: Column) -> Column:
    """Join a relative specifier to its file's directory and fold ``.`` and ``..``."""
    base = F.when(dirname(source_path) == ".", F.lit("")).otherwise(dirname(source_path))
    parts = F.filter(F.split(F.concat(base, F.lit("/"), spec), "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(folded, "/")


def infer_tier(path: Column) -> Column:
    name = basename(F.replace(path, F.lit("\\"), F.lit("/")))
    tagged = F.regexp_extract(name, r"(?i)(?:^|[-_])tier[-_]?([abc])(?:[-_.]|$)", 1)
    leading = F.regexp_extract(name, r"(?i)^([abc])(?:[-_.]|$)", 1)
    return F.upper(F.nullif(F.when(tagged != "", tagged).otherwise(leading), F.lit("")))


def fixture_tokens(name: str, generic=("bench", "ts", "java", "app")) -> list[str]:
    cleaned = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in name.lower())
    return [t for t in cleaned.split() if len(t) > 1 and t not in generic]


def infer_fixture(value: Column, fixtures: list[str]) -> Column:
    """Name contained in the text, else the fixture that shares most of its words (first best)."""
    text = F.lower(F.replace(value, F.lit("\\"), F.lit("/")))
    exact = F.coalesce(*[F.when(F.contains(text, F.lit(f.lower())), F.lit(f)) for f in fixtures])
    scored = [
        F.struct(
            reduce(
                lambda x, y: x + y,
                [F.contains(text, F.lit(t)).cast("int") for t in fixture_tokens(f)] or [F.lit(0)],
            ).alias("score"),
            F.lit(-i).alias("order"),
            F.lit(f).alias("name"),
        )
        for i, f in enumerate(fixtures)
    ]
    best = F.array_max(F.array(*scored))
    return F.coalesce(exact, F.when(best["score"] > 0, best["name"]))
