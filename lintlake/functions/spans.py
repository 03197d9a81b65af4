"""Brace spans: the only detector step that needs characters in order, as a pandas UDF.

Which ``}`` closes a function depends on every brace before it, so a text is walked
once per file, inside a task, over Arrow batches. What is found leaves as an array
of small structs; thresholds, findings and everything after are DataFrame work.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: what starts a function, a method, a class, a catch block --------
FUNCTION_STARTS = [
    r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(",
    r"^\s+(?:(?:public|private|protected|static|async|readonly)\s+)*(\w+)\s*\([^)]*\)\s*(?::\s*\S+)?\s*\{",
    r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[^=])\s*=>\s*\{",
    r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*\w[\w<>,\s]*\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+\w[\w,\s]*)?\s*\{",
    r"^\s*(?:async\s+)?def\s+(\w+)\s*\(",
    r"^func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\(",
]
INDENTED_START = r"^\s*(?:async\s+)?def\s+"
CLASS_START = r"(?:export\s+)?(?:abstract\s+)?(?:public\s+)?class\s+(\w+)"
METHOD_STARTS = [
    r"^\s+(?:(?:public|private|protected|static|async|abstract|readonly|override)\s+)*(\w+)\s*\([^)]*\)\s*(?::\s*\S+)?\s*\{",
    r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*\w[\w<>,\s]*\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+\w[\w,\s]*)?\s*\{",
]
CATCH_WORD = r"\bcatch\b"
# -----------------------------------------------------------------------------------

_FUNCTIONS = [re.compile(p, re.ASCII) for p in FUNCTION_STARTS]
_INDENTED = re.compile(INDENTED_START, re.ASCII)
_CLASS = re.compile(CLASS_START, re.ASCII)
_METHODS = [re.compile(p, re.ASCII) for p in METHOD_STARTS]
_CATCH = re.compile(CATCH_WORD, re.ASCII)
_BRACE = re.compile(r"[{}]")
_SPACE = re.compile(r"\s*")


class Braces:
    """Brace positions of a text with the depth after each, and where every line starts."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.at: list[int] = []
        self.opens: list[bool] = []
        self.depth: list[int] = []
        self.line: list[int] = []
        self.first_of_line: list[int] = []
        depth = 0
        for number, line in enumerate(self.lines):
            self.first_of_line.append(len(self.opens))
            for m in _BRACE.finditer(line):
                is_open = m.group() == "{"
                depth += 1 if is_open else -1
                self.opens.append(is_open)
                self.depth.append(depth)
                self.line.append(number)
        # For each closing depth, the ordered brace numbers: a span ends at the first one
        # after its opening brace that is back at the depth before the span.
        self.closing: dict[int, list[int]] = {}
        self.next_open = [len(self.opens)] * (len(self.opens) + 1)
        for i in range(len(self.opens) - 1, -1, -1):
            self.next_open[i] = i if self.opens[i] else self.next_open[i + 1]
        for i, is_open in enumerate(self.opens):
            if not is_open:
                self.closing.setdefault(self.depth[i], []).append(i)

    def end_line(self, start_line: int) -> int | None:
        """Line of the brace that closes what the line opens; None if it stays open."""
        first = self.first_of_line[start_line]
        base = self.depth[first - 1] if first else 0
        opening = self.next_open[first]
        candidates = self.closing.get(base, [])
        lo, hi = 0, len(candidates)
        while lo < hi:
            mid = (lo + hi) // 2
            if candidates[mid] <= opening:
                lo = mid + 1
            else:
                hi = mid
        if opening == len(self.opens) or lo == len(candidates):
            return None
        return self.line[candidates[lo]]


def indented_length(lines: list[str], start: int) -> int:
    """Lines of a body that is delimited by indentation; trailing blank lines count."""

    def indent(line: str) -> int:
        return len(line) - len(line.lstrip())

    base, end = indent(lines[start]), start
    for i in range(start + 1, len(lines)):
        if lines[i].strip() and indent(lines[i]) <= base:
            break
        end = i
    return end - start + 1


def function_list(text: str) -> list[dict]:
    braces = Braces(text)
    out = []
    for i, line in enumerate(braces.lines):
        if "(" not in line and "=>" not in line:
            continue
        m = next(filter(None, (p.search(line) for p in _FUNCTIONS)), None)
        if m is None:
            continue
        if _INDENTED.search(line):
            size = indented_length(braces.lines, i)
        else:
            end = braces.end_line(i)
            size = 0 if end is None else end - i + 1
        if size > 0:
            out.append({"name": m.group(1), "start": i + 1, "lines": size})
    return out


def class_list(text: str) -> list[dict]:
    braces = Braces(text)
    starts = [0]
    for line in braces.lines:
        starts.append(starts[-1] + ("(" in line and "{" in line and any(p.search(line) for p in _METHODS)))
    out = []
    for i, line in enumerate(braces.lines):
        m = _CLASS.search(line)
        end = braces.end_line(i) if m else None
        if m and end is not None and end > i:
            out.append({"name": m.group(1), "start": i + 1, "lines": end - i + 1, "methods": starts[end] - starts[i + 1]})
    return out


def catch_list(text: str) -> list[dict]:
    """Bodies of catch blocks, found by matching round and curly brackets."""
    close = {"(": ")", "{": "}"}
    ends: dict[int, int] = {}
    open_at: dict[str, list[int]] = {"(": [], "{": []}
    opener = {")": "(", "}": "{"}
    for m in re.finditer(r"[(){}]", text):
        ch = m.group()
        if ch in close:
            open_at[ch].append(m.start())
        elif open_at[opener[ch]]:
            ends[open_at[opener[ch]].pop()] = m.start()
    out, line, scanned = [], 1, 0
    for m in _CATCH.finditer(text):
        line += text.count("\n", scanned, m.start())
        scanned = m.start()
        at = _SPACE.match(text, m.end()).end()
        if at < len(text) and text[at] == "(":
            if at not in ends:
                continue
            at = _SPACE.match(text, ends[at] + 1).end()
        if at < len(text) and text[at] == "{" and at in ends:
            out.append({"line": line, "body": text[at + 1 : ends[at]]})
    return out


def _series(contents: pd.Series, fn) -> pd.Series:
    return contents.map(lambda t: fn(t) if isinstance(t, str) else [])


def function_spans(content: Column) -> Column:
    """``array<struct<name, start, lines>>`` of the functions of a text."""

    @F.pandas_udf("array<struct<name:string,start:int,lines:int>>")
    def spans(contents: pd.Series) -> pd.Series:
        return _series(contents, function_list)

    return spans(content)


def class_spans(content: Column) -> Column:
    @F.pandas_udf("array<struct<name:string,start:int,lines:int,methods:int>>")
    def spans(contents: pd.Series) -> pd.Series:
        return _series(contents, class_list)

    return spans(content)


def catch_blocks(content: Column) -> Column:
    @F.pandas_udf("array<struct<line:int,body:string>>")
    def spans(contents: pd.Series) -> pd.Series:
        return _series(contents, catch_list)

    return spans(content)
