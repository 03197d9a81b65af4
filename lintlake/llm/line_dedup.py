"""Line dedup by a deletion-neighbourhood join; DataFrame functions only.

A line is what stands between newlines, compared by its words (cut at white space). A line of at least
``MIN_WORDS`` words is removed if an equal one stands earlier (by doc_id, then by place); one of at least
``EDIT_WORDS`` also if an earlier one becomes equal by inserting, deleting or replacing one word. Earlier
lines count whether or not they are removed themselves, so the result depends on no order of work.

1. Lines are reduced to digests, and equal ones to their first place, with map-side minima.
2. One edit leaves a line's first or last ``a`` words alone, where ``a`` is the largest power of two up to half
   of its words. Only lines that share such an end with another line go on.
3. For these, every variant within the edit bound (one word of the other part deleted) is emitted as a hashed
   key: two lines that differ in one word share the variant without it at the same place, and of two lines that
   differ by a word the shorter one is a variant of the longer one. Equal variants join, a group knows its
   earliest line, and what meets an earlier one is verified by the words of both lines.

The variants of a line take time in proportion to its words: the digest of a line without a word follows from
running digests of what stands before and after it.

Defined results: a null is an empty text; blank and short lines stay, as do their places. Rows that
repeat doc_id and text count as one document. A document that loses every line goes from the filter, and keeps an
empty text in the report. A missing doc_id comes first. Extra columns are untouched. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import doc_id_of, joined_by_key, key_columns, keyed, written

MIN_WORDS, EDIT_WORDS = 5, 8
SPACE = r"[ \t\x0B\f\r]+"
BLANKS = " \t\x0b\f\r"
PLACE = ["id", "tk", "at"]
#: Names of own columns beside those of any table.
REMOVED, LINES = "__llm_removed", "__llm_lines"


def _plain(line: Column) -> Column:
    """The words of a line with one space between them; only a line with other blanks needs the pattern."""
    odd = F.contains(line, F.lit("  "))
    for blank in BLANKS[1:]:
        odd = odd | F.contains(line, F.lit(blank))
    return F.when(odd, F.btrim(F.regexp_replace(line, SPACE, " "))).otherwise(F.btrim(line))


def distinct_lines(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All lines that may be removed ``(h, g, id, tk, at)``, and the first of equal ones with the keys of its ends."""
    lines = rows.select("id", "tk", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    lines = lines.select("id", "tk", "at", F.inline(F.array(F.struct(_plain(F.col("raw")).alias("line")))))
    counted = lines.withColumn("n", F.when(F.col("line") == "", 0).otherwise(F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1))
    a, b = "shiftleft(1, length(bin((n - 1) div 2)) - 1)", "shiftleft(1, length(bin(n div 2)) - 1)"
    key = lambda side, k, when="true": F.expr(
        f"CASE WHEN n >= {EDIT_WORDS} AND {when} THEN xxhash64({side}, {k}, substring_index(line, ' ', {'-' if side else ''}({k}))) END"
    )
    all_lines = written(
        counted.where(F.col("n") >= MIN_WORDS).select(
            F.xxhash64("line").alias("h"), F.hash("line").alias("g"), *PLACE, F.col("n").cast("int").alias("n"),
            key(0, a).alias("p"), key(1, a).alias("s"), key(0, b, f"{a} != {b}").alias("p2"), key(1, b, f"{a} != {b}").alias("s2"),
        )
    )
    first = written(
        all_lines.groupBy("h", "g").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("copies"), *[F.min(c).alias(c) for c in ("n", "p", "s", "p2", "s2")])
    )
    return all_lines.select("h", "g", *PLACE), first


def _sharing(first: DataFrame) -> DataFrame:
    """Lines that share an end with another: ``(id, tk, at, n, h, key, end)``, one row per line and end."""
    ends = first.where(F.col("n") >= EDIT_WORDS).select(
        "first.*", "n", "h",
        F.explode(F.filter(F.array(*[F.struct(F.col(c).alias("key"), F.lit(i).alias("end")) for i, c in enumerate(("p", "s", "p2", "s2"))]), lambda x: x["key"].isNotNull())).alias("e"),
    ).select(*PLACE, "n", "h", "e.*")
    shared = ends.groupBy("key").agg(F.count("*").alias("lines")).where("lines > 1").select("key")
    return ends.join(shared, "key", "left_semi")


def _lines_at(rows: DataFrame, places: DataFrame, more: list[str]) -> DataFrame:
    """``places (id, tk, at, ...)`` with the words of their lines, one space between them, as ``line``."""
    wanted = places.groupBy("id", "tk").agg(F.collect_list(F.struct("at", *more)).alias("want"))
    met = joined_by_key(rows, wanted, F.size("want") * (16 + 16 * len(more)) + 32)
    # a generator keeps the split from being done again for every line
    split = met.select("id", "tk", "want", F.inline(F.array(F.struct(F.split("text", "\n").alias("lines")))))
    return split.select("id", "tk", F.explode("want").alias("w"), "lines").select("id", "tk", "w.*", _plain(F.element_at("lines", F.col("w.at") + 1)).alias("line"))


def _variants(lines: DataFrame) -> DataFrame:
    """``(v, kind, h, id, tk, at)``: hashed variants of each line, whose end ``key`` is shared.

    Kind S lacks one word at a place, kind B lacks a word anywhere, kind A is a line as it is.
    """
    words = F.split("line", " ")
    last = lambda a: F.element_at(a, -1)
    before = F.aggregate(words, F.array(F.lit(0).cast("bigint")), lambda a, w: F.array_append(a, last(a).bitwiseXOR(F.xxhash64(w, F.size(a)))))
    # the words behind a place move up by one
    after = F.reverse(F.aggregate(F.reverse(words), F.array(F.lit(0).cast("bigint")), lambda a, w: F.array_append(a, last(a).bitwiseXOR(F.xxhash64(w, F.col("n") - F.size(a))))))
    n, a = F.col("n"), F.expr("shiftleft(1, length(bin((n - 1) div 2)) - 1)")
    without = F.zip_with(F.slice(before, 1, n), F.slice(after, 2, n), lambda x, y: x.bitwiseXOR(y))
    row = lambda v, kind: F.struct(v.alias("v"), F.lit(kind).alias("kind"))
    suffix = F.col("end") % 2 == 1
    lo = F.when(suffix, 1).otherwise(a + 1)
    deleted = F.flatten(
        F.transform(
            F.slice(without, lo, n - a),
            lambda d, i: F.array(row(F.xxhash64("key", n, i, d), "S"), row(F.xxhash64("key", F.lit("x"), n - 1, d), "B")),
        )
    )
    alone = F.array(row(F.xxhash64("key", F.lit("x"), n, last(before)), "A"))
    # ends 0 and 1 serve a line as the longer one, and as the shorter one too if no others are made for that
    rows = F.when(F.col("end") >= 2, alone).when(F.col("both"), F.concat(deleted, alone)).otherwise(deleted)
    return lines.withColumn("both", F.expr("shiftleft(1, length(bin((n - 1) div 2)) - 1) = shiftleft(1, length(bin(n div 2)) - 1)")).select("h", *PLACE, F.explode(rows).alias("r")).select("r.*", "h", *PLACE)


def near_earlier(rows: DataFrame, first: DataFrame) -> DataFrame:
    """``(id, tk, at)`` of lines with an earlier one within one word."""
    sharing = _sharing(first)
    variants = written(_variants(_lines_at(rows, sharing, ["n", "h", "key", "end"])))
    several = variants.groupBy("v").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo != hi").select("v")
    met = written(variants.join(several, "v", "left_semi"))
    place = F.struct(*PLACE)
    earliest = met.groupBy("v").agg(*[F.min(F.when(F.col("kind") == k, place)).alias(k) for k in "SAB"])
    partner = F.when(F.col("kind") == "S", F.col("S")).when(F.col("kind") == "A", F.col("B")).otherwise(F.col("A"))
    pairs = met.join(earliest, "v").withColumn("other", partner).where(F.col("other") < place).groupBy(*PLACE).agg(F.min("other").alias("other"))
    pairs = written(pairs.select(*PLACE, F.col("other.id").alias("o_id"), F.col("other.tk").alias("o_tk"), F.col("other.at").alias("o_at")))
    own = _lines_at(rows, pairs, ["o_id", "o_tk", "o_at"]).select(*[F.col(c).alias(f"m_{c}") for c in PLACE], F.col("o_id").alias("id"), F.col("o_tk").alias("tk"), F.col("o_at").alias("at"), F.col("line").alias("m_line"))
    other = _lines_at(rows, pairs.select(F.col("o_id").alias("id"), F.col("o_tk").alias("tk"), F.col("o_at").alias("at")).distinct(), [])
    both = own.join(other, PLACE)
    return both.where(within_one_word(F.col("m_line"), F.col("line"))).select(*[F.col(f"m_{c}").alias(c) for c in PLACE]).distinct()


def within_one_word(x: Column, y: Column) -> Column:
    """Whether two lines become equal by inserting, deleting or replacing at most one word."""
    a, b = F.split(x, " "), F.split(y, " ")
    same = lambda p, q: F.array_position(F.zip_with(p, q, lambda u, v: (~u.eqNullSafe(v)).cast("int")), 1)
    longer = F.greatest(F.size(a), F.size(b))
    ahead, behind = same(a, b), same(F.reverse(a), F.reverse(b))  # first place that differs, from 1; 0 if none
    return (ahead == 0) | ((F.abs(F.size(a) - F.size(b)) <= 1) & (ahead - 1 + behind - 1 >= longer - 1))


def removed_lines(docs: DataFrame) -> DataFrame:
    """``(id, tk, at)`` of all lines to remove; ``at`` counts lines from 0."""
    rows = keyed(docs)
    lines, first = distinct_lines(rows)
    copies = first.where("copies > 1").select("h", "g", "first")
    again = lines.join(copies, ["h", "g"]).where(F.struct(*PLACE) != F.col("first")).select(*PLACE)
    return again.union(near_earlier(rows, first)).distinct()


def _without(docs: DataFrame) -> DataFrame:
    """``docs`` with its lines, those to remove, and the kept text, in columns of their own."""
    key = key_columns(docs)
    gone = removed_lines(docs).groupBy("id", "tk").agg(F.collect_list("at").alias(REMOVED))
    # the keys take names that clash with no table's: the frame is joined as one column
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key["id"].alias("id"), key["tk"].alias("tk"), key["text"].alias("text"))
    met = joined_by_key(rows, gone, F.size(REMOVED) * 8 + 32, "left")
    split = met.select("row", "id", "text", REMOVED, F.inline(F.array(F.struct(F.split("text", "\n").alias(LINES)))))
    stay = F.array_except(F.sequence(F.lit(0), F.size(LINES) - 1), F.col(REMOVED))
    left = F.when(F.col(REMOVED).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(LINES, i)), "\n"))
    return split.select("row", "id", F.size(LINES).alias("n_lines"), F.coalesce(F.size(REMOVED), F.lit(0)).alias("n_removed"), left.alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_removed, kept)`` of every document."""
    out = _without(docs.select("doc_id", "text"))
    return out.select(doc_id_of(F.col("id")).alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), "kept")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed lines; ``n_chars``, if there, follows the text. What loses all lines goes."""
    out = _without(docs).where("n_removed < n_lines")
    text = F.when(F.col("row.text").isNull(), F.col("row.text")).otherwise(F.col("kept"))
    cells = []
    for field in docs.schema.fields:
        c = F.col("row")[field.name]
        if field.name == "text":
            c = text
        elif field.name == "n_chars":
            c = F.when(F.col("n_removed") > 0, F.char_length("kept").cast(field.dataType)).otherwise(c)
        cells.append(c.alias(field.name))
    return out.select(*cells)


def query(spark, sf_dir: str) -> DataFrame:
    """Per document its lines, the removed ones, and the digest of what is kept."""
    out = report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), plain AS (
  SELECT doc_id, pos, raw, trim(regexp_replace(raw, '[ \t\x0B\f\r]+', ' ', 'g'), ' ') AS line FROM lines
), counted AS (
  SELECT *, CASE WHEN line = '' THEN 0 ELSE len(string_split(line, ' ')) END AS n FROM plain
), firsts AS (
  SELECT line, any_value(n) AS n, min((doc_id, pos)) AS start FROM counted WHERE n >= {MIN_WORDS} GROUP BY line
), edit AS (
  SELECT line, n, start, string_split(line, ' ') AS w FROM firsts WHERE n >= {EDIT_WORDS}
), variants AS (
  SELECT line, n, start, e, array_to_string(list_concat(w[1:e], w[e + 2:]), ' ') AS v FROM (SELECT *, unnest(range(n)) AS e FROM edit)
), near AS (
  SELECT a.line FROM variants a JOIN variants b ON a.v = b.v AND a.e = b.e AND a.n = b.n WHERE b.start < a.start
  UNION SELECT a.line FROM variants a JOIN edit b ON a.v = b.line WHERE b.start < a.start
  UNION SELECT b.line FROM variants a JOIN edit b ON a.v = b.line WHERE a.start < b.start
), judged AS (
  SELECT c.*, coalesce((c.doc_id, c.pos) != f.start, false) OR c.n >= {MIN_WORDS} AND c.line IN (SELECT line FROM near) AS gone
  FROM counted c LEFT JOIN firsts f ON c.line = f.line
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
