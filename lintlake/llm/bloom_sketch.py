"""Document fingerprints as invertible Bloom lookup sketches; DataFrame functions only.

A paragraph is a line, cut every ``LONGEST`` characters. Each distinct paragraph's 64-bit digest goes into one
cell of each of three tables; a cell holds how many digests it got, their exclusive or, and that of their check
values. The fingerprint is the sketch with ``BASE`` cells a table, so its size has a bound and equal texts have
equal fingerprints. Only cells in use are listed.

Two versions are compared by subtracting their cells: what they share cancels. Cells with one digest left give
it away; taking it out of its other cells frees more, until nothing is left. If cells remain that cannot
be peeled, sketches with ``FIRST_RETRY`` cells for each paragraph of both are made and subtracted, then four times
larger ones, and so on. The digests found are the paragraphs in which the versions differ, and the likeness is
that of their paragraph sets (shared over all), 1 for two texts without paragraphs.

Defined results: a null is an empty text; a text without paragraphs has the fingerprint ``0:``. Blank lines and
the order and number of equal paragraphs don't count. Rows that repeat a document follow one another as documents of their
own. A missing doc_id is the least. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import bound, doc_id_of, keyed, materialised, partitions_of, slices_of

LONGEST = 160
TABLES, BASE, FIRST_RETRY, RETRIES = 3, 6, 2, 3
ROUNDS = 60
CELL = "array<struct<cell:int,count:int,key:bigint,check:bigint>>"
CHECK_BITS = 0xFFFFFFFF


def paragraphs(text: Column) -> Column:
    """Digests of the distinct paragraphs of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{LONGEST}}}"), F.lit(0)), lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check")).bitwiseAND(F.lit(CHECK_BITS))


def _cells_of(items: Column, size: Column, key=lambda d: d, count=lambda d: F.lit(1)) -> Column:
    """What each item adds to its cells: its digest is ``key(item)``, and it counts ``count(item)`` times."""

    def adds(d):
        return F.array(
            *[
                F.struct(
                    (F.pmod(F.xxhash64(key(d), F.lit(t)), size) + size * t).cast("int").alias("cell"),
                    count(d).cast("int").alias("count"), key(d).alias("key"), _check(key(d)).alias("check"),
                )
                for t in range(TABLES)
            ]
        )

    return F.flatten(F.transform(items, adds))


def _summed(cells: Column) -> Column:
    """Cells of one place added up, in order of place; empty ones are left out."""

    def add(a, c):
        return F.struct(
            c["cell"].alias("cell"), (a["count"] + c["count"]).alias("count"), a["key"].bitwiseXOR(c["key"]).alias("key"), a["check"].bitwiseXOR(c["check"]).alias("check")
        )

    zero = F.struct(F.lit(0).alias("cell"), F.lit(0).alias("count"), F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("check"))

    def runs(ordered):
        n = F.size(ordered)
        place = lambda i: F.get(ordered, i)["cell"]
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (place(i) != place(i - 1)))

        def added(at):
            ends = F.concat(F.slice(at, 2, F.size(at)), F.array(n))
            return F.zip_with(at, ends, lambda i, j: F.aggregate(F.slice(ordered, i + 1, j - i), zero, add))

        return F.when(n > 0, bound(starts, added)).otherwise(F.array().cast(CELL))

    return F.filter(bound(F.sort_array(cells), runs), lambda c: (c["count"] != 0) | (c["key"] != 0) | (c["check"] != 0))


def sketch(digests: Column, size: Column) -> Column:
    return _summed(_cells_of(digests, size))


def subtracted(a: Column, b: Column) -> Column:
    negated = F.transform(b, lambda c: F.struct(c["cell"].alias("cell"), (-c["count"]).alias("count"), c["key"].alias("key"), c["check"].alias("check")))
    return _summed(F.concat(a, negated))


def difference(a: Column, b: Column, size: Column) -> Column:
    """The difference of the sketches of two versions with ``size`` cells a table."""
    return _summed(F.concat(_cells_of(a, size), _cells_of(b, size, count=lambda d: F.lit(-1))))


def peeled(cells: Column, size: Column) -> Column:
    """Digests with their counts (1: only in the first version) that a difference of sketches holds; null if some can't be freed.

    The tables take turns, since a digest has one cell in each; it ends when no table has a cell to free.
    """

    def step(state, turn):
        table = turn % TABLES
        pure = lambda c: (F.abs(c["count"]) == 1) & (c["cell"] >= size * table) & (c["cell"] < size * (table + 1)) & (_check(c["key"]) == c["check"])
        out = F.transform(F.filter(state["cells"], pure), lambda c: F.struct(c["key"].alias("key"), c["count"].alias("count")))

        def without(free):
            taken = _cells_of(free, size, lambda d: d["key"], lambda d: -d["count"])
            left = F.struct(_summed(F.concat(state["cells"], taken)).alias("cells"), F.concat(state["found"], free).alias("found"), F.lit(0).alias("idle"))
            same = F.struct(state["cells"].alias("cells"), state["found"].alias("found"), (state["idle"] + 1).alias("idle"))
            return F.when(F.size(free) > 0, left).otherwise(same)

        return F.when((state["idle"] >= TABLES) | (F.size(state["cells"]) == 0), state).otherwise(bound(out, without))

    start = F.struct(cells.cast(CELL).alias("cells"), F.array().cast("array<struct<key:bigint,count:int>>").alias("found"), F.lit(0).alias("idle"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS)), start, step, lambda end: F.when(F.size(end["cells"]) == 0, end["found"]))


def with_likeness(df: DataFrame, pairs: dict[str, tuple[str, str, str, str]]) -> DataFrame:
    """Add the likeness of versions: name to columns (digests, base sketch) of one and of the other."""
    for name, (a, sa, b, sb) in pairs.items():
        n = F.size(a) + F.size(b)
        tries = [F.array_size(peeled(subtracted(F.col(sa), F.col(sb)), F.lit(BASE)))]
        for k in range(RETRIES):
            size = n * F.lit(FIRST_RETRY * 4**k)
            tries.append(F.array_size(peeled(difference(F.col(a), F.col(b), size), size)))
        # after all retries, whose joint failure has no practical chance, the digests themselves
        tries.append(F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)))
        shared = (n - F.col("differ")) / 2
        df = materialised(df, F.coalesce(*tries).alias("differ")).withColumn(name, F.when(n == 0, 1.0).otherwise(shared / (n - shared))).drop("differ")
    return df


def printed(digests: str, cells: str) -> Column:
    """A fingerprint: number of paragraphs, then the cells in use."""
    body = F.transform(cells, lambda c: F.concat_ws(".", c["cell"].cast("string"), c["count"].cast("string"), F.lower(F.hex(c["key"])), F.lower(F.hex(c["check"]))))
    return F.concat(F.size(digests).cast("string"), F.lit(":"), F.array_join(body, ","))


def with_next(rows: DataFrame, slices: int | None = None) -> DataFrame:
    """``rows (id, tk, text)`` with the text of the next document in descending order (``next``); the first follows the last.

    Rows are cut into slices of the order, each of which finds its neighbours alone; the row after its last one,
    of which there is one per slice, is added to it.
    """
    n = slices or partitions_of(rows.sparkSession)
    cuts = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] or []
    at = slices_of(F.col("id"), sorted(set(cuts)))
    # one row per slice reaches the driver: its greatest key, which follows the slice above
    tops = sorted((r.s, r.top.id, r.top.tk) for r in rows.groupBy(at.alias("s")).agg(F.max(F.struct("id", "tk")).alias("top")).collect())
    follows = [(i, t, tops[(k + 1) % len(tops)][0]) for k, (_, i, t) in enumerate(tops)]
    ghost = rows.sparkSession.createDataFrame(follows, "id long, tk long, slice int")
    ghosts = rows.join(F.broadcast(ghost), ["id", "tk"]).select("id", "tk", "text", "slice", F.lit(1).alias("ghost"))
    order = Window.partitionBy("slice").orderBy("ghost", F.col("id").desc(), F.col("tk").desc())
    own = rows.select("id", "tk", "text", at.cast("int").alias("slice"), F.lit(0).alias("ghost"))
    return own.unionByName(ghosts).withColumn("next", F.lead("text").over(order)).where("ghost = 0").select("id", "tk", "text", "next")


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next text."""
    rows = materialised(with_next(keyed(docs)), F.char_length("text").cast("long").alias("n_chars"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = materialised(rows, F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next", half)).alias("edited"))
    rows = materialised(rows, *[paragraphs(F.col(c)).alias(f"d_{c}") for c in ("text", "edited", "next")]).select(
        "id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "d_text", "d_edited", "d_next"
    )
    rows = materialised(rows, *[sketch(F.col(f"d_{c}"), F.lit(BASE)).alias(f"s_{c}") for c in ("text", "edited", "next")])
    rows = with_likeness(rows, {"near_edited": ("d_text", "s_text", "d_edited", "s_edited"), "near_next": ("d_text", "s_text", "d_next", "s_next")})
    return rows.select(
        doc_id_of(F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", printed("d_text", "s_text").alias("fingerprint"), printed("d_edited", "s_edited").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and likeness of every document."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
