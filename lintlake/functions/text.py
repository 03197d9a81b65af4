"""Regex helpers that keep track of lines, built from split and extract.

``regexp_extract_all`` gives the matches of a text but not where they are. The
text between the matches is what ``split`` returns for the same pattern, so the
line of a match is one more than the newlines before it in both lists.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines_of(content: Column) -> Column:
    return F.split(content, "\n")


def newlines(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit("")))


def found(content: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(group))


def count_of(content: Column, pattern: str) -> Column:
    return F.regexp_count(content, F.lit(pattern))


def first_line(lines: Column, pattern: str) -> Column:
    """1-based number of the first matching line, 0 if there is none."""
    return F.array_position(F.transform(lines, lambda l: l.rlike(pattern)), F.lit(True)).cast("int")


def numbered(lines: Column) -> Column:
    return F.transform(lines, lambda l, i: F.struct((i + 1).cast("int").alias("line"), l.alias("text")))


def hits_on_lines(lines: Column, condition) -> Column:
    """Lines (number and text) for which ``condition(text)`` holds."""
    return F.filter(numbered(lines), lambda s: condition(s["text"]))


FOLD = 512


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(block: Column) -> Column:
    """Running sums of a short array; appending copies it, so long ones go block by block."""
    return F.aggregate(
        block, F.array().cast("array<int>"), lambda a, x: F.array_append(a, (F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x).cast("int"))
    )


def running_sums(values: Column) -> Column:
    """Running sums of an array of numbers, in time that grows with its length."""

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: (s + x).cast("int")))
        before = F.concat(F.array(F.lit(0)), _running(totals))
        return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, o: F.transform(_running(b), lambda x: x + o)))

    def of_values(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / FOLD).cast("int")), lambda k: F.slice(v, k * FOLD + 1, FOLD))
        return F.when(F.size(v) > 0, _bound(cut, of_blocks)).otherwise(F.array().cast("array<int>"))

    return _bound(values, of_values)


def matches_with_lines(content: Column, pattern: str, limit: int | None = None) -> Column:
    """Matches in text order as ``array<struct<text, line>>``; ``limit`` keeps the first ones.

    The line of a match is one more than the newlines in all that stands before it: running sums over
    what lies between the matches and the matches themselves.
    """
    matches = found(content, pattern)
    if limit is not None:
        matches = F.slice(matches, 1, limit)

    def placed(p: Column) -> Column:
        gaps = F.slice(p["gaps"], 1, F.size(p["texts"]))
        inside = F.concat(F.array(F.lit(0)), F.transform(p["texts"], newlines))
        steps = F.zip_with(gaps, F.slice(inside, 1, F.size(p["texts"])), lambda g, n: F.coalesce(newlines(g), F.lit(0)) + n)
        return F.zip_with(p["texts"], running_sums(steps), lambda t, n: F.struct(t.alias("text"), (n + 1).cast("int").alias("line")))

    return _bound(F.struct(matches.alias("texts"), F.split(content, pattern, -1).alias("gaps")), placed)


def first_match_line(content: Column, pattern: str) -> Column:
    """Line on which the first match starts."""
    return (F.lit(1) + newlines(F.element_at(F.split(content, pattern, 2), 1))).cast("int")
