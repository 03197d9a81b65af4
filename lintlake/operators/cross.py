"""Rules that compare the files of a repository with each other, as equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.scalars import basename, trimmed
from lintlake.functions.text import found, lines_of
from lintlake.operators.detect import SOURCE_EXTS, c, emit, finding, one, place, scope, text
from lintlake.operators.positions import first_k
from lintlake.session import cut_lineage

# --- Fixed values: patterns and limits ------------------------------------------------
TEST_FILES = [r"\.(test|spec)\.(ts|js|java)$", r"Test\.java$"]
UNTESTED_NAMES = r"^index\.(?:ts|js)$|^types"
CONFIG_FILE = r"(?:^|[/\\])(?:[\w-]+\.)?config\.(?:ts|js|mjs|cjs|java)$"
TEST_SUPPORT = r"[/\\](?:__tests__|fixtures)[/\\]"
WIRING = r"[/\\](?:controllers|routes|middleware)[/\\]"

BLOCK_LINES, MIN_BLOCK_CHARS, BLOCK_PLACES = 6, 80, 3
INSIGNIFICANT = ["{", "}", "})", "});"]
INSIGNIFICANT_STARTS = ["//", "*", "import "]

EXPORT_DECLARATION = (
    r"export\s+(?:default\s+)?(?:function|class|const|let|var|type|interface|enum|abstract\s+class)\s+(\w+)"
)
EXPORT_LIST = r"export\s*\{([^}]+)\}"
ENTRY_SYMBOLS = ["default", "main", "handler"]
SCRIPT_EXTS = [".ts", ".js"]
TOKEN_PIECE, GRAM = 256, 3

ENV_EXAMPLE = ".env.example"
# The name after the prefix is one word; the call forms name a quoted string on their line.
ENV_PROPERTY = r"(?<=env\.)(?=([^\s;,()\[\]{}'\"`=+*/<>!&|?:]+))"
ENV_CALL_LINE = r"(?:getenv\(|@ConfigProperty\().*[\"'][^\"']+[\"'].*"
QUOTED_WORD = r"[\"']([^\"']+)(?=[\"'])"
# -----------------------------------------------------------------------------------------


# -- missing tests --------------------------------------------------------------------------


def _is_test(path: Column) -> Column:
    return path.rlike(TEST_FILES[0]) | path.rlike(TEST_FILES[1])


def missing_tests(files: DataFrame) -> DataFrame:
    """Source files that no test is named after.

    A test covers a base name that equals its stem or follows a ``-`` in it: each stem is
    exploded into those endings, which makes the check an equi anti join.
    """
    paths = scope(files, SOURCE_EXTS).select("repo", "path", basename(c.path).alias("base"))
    stem = F.regexp_replace(
        F.regexp_replace(c.base, r"\.(test|spec)\.(ts|js|java)$", ".$2"), r"Test\.java$", ".java"
    )
    parts = F.split(stem, "-")
    covered = (
        paths.where(_is_test(c.path))
        .select(
            "repo",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "-")
                )
            ).alias("base"),
        )
        .distinct()
    )
    sources = paths.where(
        ~_is_test(c.path)
        & ~c.base.rlike(UNTESTED_NAMES)
        & ~c.path.rlike(CONFIG_FILE)
        & ~c.path.rlike(TEST_SUPPORT)
        & ~c.path.rlike(WIRING)
    )
    return emit(
        sources.join(covered, ["repo", "base"], "left_anti"),
        finding("missing-test-file", "medium", text("No test for ", c.path), one(c.path)),
    )


# -- duplicated blocks --------------------------------------------------------------------------


def code_blocks(files: DataFrame) -> DataFrame:
    """Every run of six significant lines: ``(repo, path, pos, block)`` with the block's digest."""

    def significant(l: Column) -> Column:
        cond = (F.length(l) > 2) & ~l.isin(INSIGNIFICANT)
        for s in INSIGNIFICANT_STARTS:
            cond = cond & ~F.startswith(l, F.lit(s))
        return cond

    sig = F.filter(F.transform(lines_of(c.content), trimmed), significant)
    f = scope(files, SOURCE_EXTS, skip_tests=True).select("repo", "path", sig.alias("sig"))
    f = f.where(F.size("sig") >= BLOCK_LINES)

    # Digests are made inside the row: exploding starts would copy the lines for each of them.
    def block(i: Column) -> Column:
        body = F.array_join(F.slice("sig", i, BLOCK_LINES), "\n")
        return F.when(
            F.length(body) >= MIN_BLOCK_CHARS, F.struct(i.cast("int").alias("pos"), F.md5(body).alias("block"))
        )

    starts = F.sequence(F.lit(1), F.size("sig") - (BLOCK_LINES - 1))
    found_blocks = F.array_compact(F.transform(starts, block))
    return f.select("repo", "path", F.explode(found_blocks).alias("b")).select("repo", "path", "b.pos", "b.block")


def dry_violations(files: DataFrame) -> DataFrame:
    """Blocks that several files share, one finding per distinct set of files.

    A block may be in a third of all files, so its files are never collected: a set of
    files is known by its size and two independent sums over its paths. The block whose
    first place comes first stands for the set, and only the places of these blocks are
    looked up again.
    """
    blocks = cut_lineage(code_blocks(files))  # digests are written, so texts are read and digested once
    per_file = blocks.groupBy("repo", "block", "path").agg(F.min("pos").alias("pos"))
    shared = (
        per_file.groupBy("repo", "block")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("path", "pos")).alias("first"),
            F.bit_xor(F.xxhash64("path")).alias("set_a"),
            F.sum(F.conv(F.substring(F.md5("path"), 1, 15), 16, 10).cast("decimal(20,0)")).alias("set_b"),
        )
        .where(c.n >= 2)
    )
    chosen = shared.groupBy("repo", "n", "set_a", "set_b").agg(F.min_by("block", "first").alias("block"))
    places = first_k(
        blocks.join(chosen.select("repo", "block", "n"), ["repo", "block"]),
        ["repo", "block", "n"],
        ["path", "pos"],
        BLOCK_PLACES,
    )
    grouped = places.groupBy("repo", "block", "n").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_rank", "path", "pos"))), lambda p: place(p["path"], p["pos"])
        ).alias("places")
    )
    return emit(
        grouped, finding("dry-violation", "low", text("The same block in ", c.n, " files"), c.places)
    )


# -- dead exports ----------------------------------------------------------------------------------


def exported_symbols(content: Column) -> Column:
    """Names that a script exports, declarations first. A list of one name may not rename it."""
    lists = F.transform(
        found(content, EXPORT_LIST, 1),
        lambda l: F.when(
            F.contains(l, F.lit(",")),
            F.transform(F.split(l, ","), lambda p: trimmed(F.element_at(F.split(trimmed(p), r"\s+as\s+"), -1))),
        ).otherwise(F.array(trimmed(l))),
    )
    return F.filter(F.concat(found(content, EXPORT_DECLARATION, 1), F.flatten(lists)), lambda n: n.rlike(r"^\w+$"))


def exports(files: DataFrame) -> DataFrame:
    return scope(files, SCRIPT_EXTS, skip_tests=True).select(
        "repo", "path", F.posexplode(exported_symbols(c.content)).alias("pos", "symbol")
    )


def vocabulary(files: DataFrame) -> DataFrame:
    """Words of each repository with the least and the greatest path that has them."""
    words = F.array_distinct(found(c.content, r"\w+"))
    return (
        scope(files, SCRIPT_EXTS, skip_tests=True)
        .select("repo", "path", F.explode(words).alias("word"))
        .groupBy("repo", "word")
        .agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    )


def _grams(name: Column, sizes) -> Column:
    """Distinct pieces of ``name`` that have one of the ``sizes``."""

    def of_size(q: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(name) - q + 1, F.lit(1)))
        return F.filter(F.transform(starts, lambda i: F.substr(name, i, F.lit(q))), lambda g: F.length(g) == q)

    return F.array_distinct(F.concat(*[of_size(q) for q in sizes]))


def words_around(words: DataFrame, names: DataFrame) -> DataFrame:
    """``(repo, symbol, lo, hi)`` of the ``names (repo, symbol)`` that lie inside words of their repository.

    Words ``(repo, word, lo, hi)`` are indexed by their pieces of three characters, as far as a name has the
    piece; each name meets only the words of its rarest piece, and ``contains`` decides. A name of one or
    two characters is its own piece, so words have pieces of such a size too if any name has it. Names that no word has are left out.
    Very long words are cut, with an overlap that holds the longest name, so no row of the index is wide.
    """
    wanted = names.select("repo", "symbol").distinct()
    size = F.least(F.length("symbol"), F.lit(GRAM))
    seen = wanted.agg(F.max(F.length("symbol")), F.min(F.length("symbol")), F.collect_set(size)).first()  # three small values
    longest, shortest, sizes = seen[0] or 1, seen[1] or 1, sorted(seen[2]) or [GRAM]
    stride = max(TOKEN_PIECE, longest)
    cuts = F.sequence(F.lit(0), F.floor((F.length("word") - 1) / stride).cast("int"))
    words = words.where(F.length("word") >= shortest).select(
        "repo", "lo", "hi",
        F.explode(F.transform(cuts, lambda i: F.substr("word", i * stride + 1, F.lit(stride + longest - 1)))).alias("word"),
    )
    own = wanted.select(
        "repo", "symbol", F.explode(F.filter(_grams(c.symbol, sizes), lambda g: F.length(g) == size)).alias("gram")
    )
    index = words.select("repo", "word", "lo", "hi", F.explode(_grams(c.word, sizes)).alias("gram"))
    index = index.join(own.select("repo", "gram").distinct(), ["repo", "gram"], "left_semi")
    counts = index.groupBy("repo", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        own.join(counts, ["repo", "gram"], "left")
        .groupBy("repo", "symbol")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
        .select("repo", "symbol", "least.gram")
    )
    return (
        index.join(rarest, ["repo", "gram"])
        .where(F.contains("word", "symbol"))
        .groupBy("repo", "symbol")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )


def dead_exports(files: DataFrame, mode: str = "substring", limit: int | None = None) -> DataFrame:
    """Exported names that occur in no other file; with ``limit``, the first ones of each repository.

    A name occurs elsewhere unless the least and the greatest file that have it are both
    its own, so the text is reduced to a vocabulary with two paths per word on the map
    side. ``mode='token'`` compares whole words. ``substring``, the default, also accepts
    a name inside a longer word: a name has word characters only, so it is inside a text
    just when it is inside one of its words. Only the few names that no whole word
    explains are looked for there. Texts are read twice, for names and for words; both
    tables are written, since the search uses them several times.
    """
    symbols = exports(files).where(~c.symbol.isin(ENTRY_SYMBOLS))
    words = vocabulary(files)
    if mode == "substring":
        words = cut_lineage(words)
    own = words.select("repo", F.col("word").alias("symbol"), "lo", "hi")
    only_own = c.lo.isNull() | ((c.lo == c.path) & (c.hi == c.path))
    unused = symbols.join(own, ["repo", "symbol"], "left").where(only_own).select("repo", "path", "pos", "symbol")
    if mode == "substring":
        unused = cut_lineage(unused)
        unused = unused.join(words_around(words, unused), ["repo", "symbol"], "left").where(only_own)
    if limit is not None:
        unused = first_k(unused.select("repo", "path", "pos", "symbol"), ["repo"], ["path", "pos"], limit)
    return emit(
        unused,
        finding(
            "dead-export", "low", text('Unused export: "', c.symbol, '" in ', c.path),
            one(c.path, None, text("export … ", c.symbol)),
        ),
    )


# -- stale environment keys ----------------------------------------------------------------------------


def stale_env_keys(files: DataFrame) -> DataFrame:
    """Keys of the example environment that no source file reads.

    A property access counts when it starts with the key, so each accessed name is
    compared through its prefixes of the lengths that the repository's keys have.
    """
    keys = (
        files.where(c.path == ENV_EXAMPLE)
        .select("repo", F.posexplode(lines_of(c.content)).alias("pos", "l"))
        .select("repo", "pos", trimmed(c.l).alias("l"))
        .where((c.l != "") & ~F.startswith("l", F.lit("#")))
        .select("repo", "pos", trimmed(F.substring_index("l", "=", 1)).alias("key"))
        .where(c.key != "")
    )
    source = scope(files, SOURCE_EXTS).where(
        F.contains("content", F.lit("env")) | F.contains("content", F.lit("@ConfigProperty("))
    )
    call_words = F.flatten(
        F.transform(found(c.content, ENV_CALL_LINE), lambda l: found(l, QUOTED_WORD, 1))
    )
    names = source.select(
        "repo", found(c.content, ENV_PROPERTY, 1).alias("props"), call_words.alias("calls")
    )
    lengths = keys.groupBy("repo").agg(F.collect_set(F.length("key")).alias("lengths"))
    props = names.select("repo", F.explode(F.array_distinct(c.props)).alias("name")).distinct()
    prefixes = (
        props.join(lengths, "repo")
        .select("repo", F.explode(F.transform("lengths", lambda n: F.substr("name", F.lit(1), n))).alias("key"))
    )
    calls = names.select("repo", F.explode(F.array_distinct(c.calls)).alias("key"))
    used = prefixes.unionByName(calls).distinct()
    return emit(
        keys.join(used, ["repo", "key"], "left_anti"),
        finding(
            "env-example-stale-key", "low", text("Key is not read anywhere: ", c.key),
            one(F.lit(ENV_EXAMPLE), None, c.key),
        ),
    )
