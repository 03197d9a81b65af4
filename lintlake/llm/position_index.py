"""Spelling variants: words one edit apart, found with bitsets per (position, letter) over the vocabulary.

The vocabulary is dealt into groups: one edit leaves the first two or the last two letters of a word as they are, so
each word joins the group of its first two and the group of its last two, and every near pair meets in one of them
(a pair that agrees at both ends counts in the first). A group's words are ordered by length; for each length the
words at most one letter shorter or longer get a bitset per (position, letter). A batch of queries of that length then
goes through its letters once, with four sets per query, 64 words of the vocabulary at a time:

    same    = words that agree so far
    changed = words with one letter replaced so far
    shorter = words that lack one of the query's letters: they are compared one position behind
    longer  = words that have one letter more: compared one position ahead

Groups of more than ``BLOCK`` words are dealt into blocks by hash, and every pair of blocks is a task of its own, so a
common beginning is no task. A task returns one row per word (number, best near word), never its pairs.

A word's form is its near word of largest count, if that is at least twice its own; forms are followed to the root by
doubling pointers. Counts at least double with every step, so the number of rounds is the logarithm of the logarithm
of the largest count.

Defined results: null and empty texts have no words; a null doc_id is written as an empty string before the colon.
Repeated rows count each. Extra columns are ignored. An empty table gives an empty result. Words shorter than
``MIN_LETTERS`` or rarer than ``MIN_COUNT`` are no words. Near means exactly one letter inserted, deleted or replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import partitions_of, written

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One in so many pairs of document and run loses a letter.
SLIP = 97
MIN_LETTERS, MIN_COUNT, FACTOR = 5, 3, 2
END = 2
BLOCK, BATCH_WORDS = 8192, 1 << 16


def vocabulary(docs: DataFrame, slip: int = SLIP, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)``: the words of all texts, after the planted slips."""
    text = F.translate(docs["text"].cast("string"), UPPER, LOWER)
    id_ = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    runs = docs.select(id_.alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), 0)).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    # both numbers of a row are computed once
    runs = runs.select("run", h.alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of words of any lengths as one array, with the first of each word."""
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), at


def rows_of_length(points: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The letters of words as a matrix; 0 behind their ends."""
    size = np.diff(at)
    out = np.zeros((len(size), width), np.uint32)
    out[np.arange(width) < size[:, None]] = points[at[0] : at[-1]]
    return out


def bitsets(letters: np.ndarray, known: np.ndarray) -> np.ndarray:
    """``[position, letter]`` -> bitset of the words (rows of ``letters``) with that letter there; the last letter is unknown."""
    words = -(-max(len(letters), 1) // 64)
    out = np.zeros((letters.shape[1] + 1, len(known) + 1, words), np.uint64)
    for p in range(letters.shape[1]):
        code = np.searchsorted(known, letters[:, p])
        for c in np.unique(code[letters[:, p] > 0]):
            bits = np.packbits(code == c, bitorder="little") if c else np.packbits((code == c) & (letters[:, p] > 0), bitorder="little")
            out[p, c].view(np.uint8)[: len(bits)] = bits
    return out


def one_edit(words: list[str], queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``queries``, place in ``words``) with exactly one letter inserted, deleted or replaced."""
    by = np.argsort([len(w) for w in words], kind="stable")
    points, at = code_points([words[i] for i in by])
    size = np.diff(at)
    q_by = np.argsort([len(q) for q in queries], kind="stable")
    q_points, q_at = code_points([queries[i] for i in q_by])
    q_size = np.diff(q_at)
    left, right = [], []
    for m in np.unique(q_size).tolist():
        lo, hi = np.searchsorted(size, [m - 1, m + 2])
        if lo == hi or not m:
            continue
        a, b = np.searchsorted(q_size, [m, m + 1])
        letters = rows_of_length(points, at[lo : hi + 1], m + 1)
        asked = q_points[q_at[a] : q_at[b]].reshape(b - a, m)
        known = np.unique(letters[letters > 0])
        index = bitsets(letters, known)
        code = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        code = np.where(known[code] == asked, code, len(known))
        of_length = [np.packbits(size[lo:hi] == s, bitorder="little") for s in (m - 1, m, m + 1)]
        masks = np.zeros((3, index.shape[2]), np.uint64)
        for k, bits in enumerate(of_length):
            masks[k].view(np.uint8)[: len(bits)] = bits
        step = max(1, BATCH_WORDS // index.shape[2])
        for i in range(0, b - a, step):
            hits = _recur(index, code[i : i + step], masks)
            q, w = np.nonzero(np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little")[:, : hi - lo])
            left.append(q_by[a + i + q])
            right.append(by[lo + w])
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def _recur(index: np.ndarray, code: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The recurrences for queries of one length; ``masks`` are the words one shorter, as long, and one longer."""
    rows, m = code.shape
    same = np.broadcast_to(np.bitwise_or.reduce(masks, axis=0), (rows, index.shape[2])).copy()
    changed, shorter, longer = (np.zeros_like(same) for _ in range(3))
    for p in range(m):
        here, ahead = index[p, code[:, p]], index[p + 1, code[:, p]]
        changed = (changed & here) | (same & ~here)
        shorter = (shorter & index[p - 1, code[:, p]] if p else shorter) | same
        longer = (longer | same) & ahead
        same &= here
    return (shorter & masks[0]) | (changed & masks[1]) | ((longer | same) & masks[2])


def _near(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Per word of two blocks of a group: its near words in the other one, their number and the best of them."""
    words, n, block = (table.column(c).to_pylist() for c in ("word", "n", "block"))
    _, end, first, second = (k.as_py() for k in key)
    own = [i for i, b in enumerate(block) if b == first]
    other = own if first == second else [i for i, b in enumerate(block) if b == second]
    q, w = one_edit([words[i] for i in other], [words[i] for i in own])
    a, b = np.array(own, np.int64)[q], np.array(other, np.int64)[w]
    if end:  # pairs that agree at the beginning too have met there
        apart = np.array([words[i][:END] != words[j][:END] for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool)
        a, b = a[apart], b[apart]
    if first != second:
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
    count = np.array(n, np.int64)
    place = np.empty(len(words), np.int64)
    place[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
    by = np.lexsort((place[b], -count[b], a))
    a, b = a[by], b[by]
    at = np.flatnonzero(np.diff(a, prepend=-1))
    sizes = np.diff(np.append(at, len(a)))
    return pa.table({
        "word": pa.array([words[i] for i in a[at].tolist()], pa.string()), "n_near": pa.array(sizes, pa.int64()),
        "near": pa.array([words[i] for i in b[at].tolist()], pa.string()), "near_n": pa.array(count[b[at]], pa.int64()),
    })


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(word, n_near, near, near_n)``: for words ``(word, n)`` with near ones their number and the best of them."""
    ends = F.array(F.struct(F.lit(0).alias("end"), F.substring("word", 1, END).alias("key")), F.struct(F.lit(1).alias("end"), F.substring("word", -END, END).alias("key")))
    grouped = words.select("word", "n", F.inline(ends))
    # one row per pair of letters: bounded by the square of the alphabet
    sizes = grouped.groupBy("end", "key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = grouped.join(sizes, ["end", "key"]).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "end", F.least("block", "with").alias("first"), F.greatest("block", "with").alias("second"), "block", "word", "n")
    task = ["key", "end", "first", "second"]
    # the work of a group is far more than its bytes: tasks are not to be gathered by their size
    found = dealt.repartition(4 * partitions_of(words.sparkSession), *task).groupBy(*task).applyInArrow(_near, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame, largest: int) -> DataFrame:
    """``(word, root)`` for ``(word, form)`` without nulls: pointers that double until no chain can be longer."""
    steps = max(1, math.ceil(math.log2(max(largest, 2))))  # counts at least double with every step
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps + 1))):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        now = written(now.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
    return now


def variants(
    docs: DataFrame, slip: int = SLIP, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, factor: int = FACTOR, block: int = BLOCK,
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word; ``min_letters`` is at least 2 * END + 1."""
    if min_letters < 2 * END + 1:
        raise ValueError(f"words need {2 * END + 1} letters, so that one edit leaves an end as it is")
    if factor < 2:
        raise ValueError("a form is at least twice as frequent as its variant")
    words = written(vocabulary(docs, slip, min_letters, min_count))
    near = near_words(words, block)
    joined = words.join(near, "word", "left")
    strong = F.col("near_n") >= factor * F.col("n")
    joined = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("near")).alias("form"), F.when(strong, F.col("near_n")).alias("form_n")))
    largest = joined.agg(F.max("form_n")).first()[0]
    found = roots(joined.where("form is not null"), largest or 2)
    out = joined.join(found, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    """Form, root and near words of every word of the corpus."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
), runs AS (
  SELECT id, run, count(*) AS times FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents) GROUP BY id, run
), bytes AS (
  SELECT run, times, hex(id || ':' || run) AS x FROM runs
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295,
    list_transform(range(1, length(x) // 2 + 1), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM bytes, crc
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), shorter AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT word AS a, v AS b FROM shorter WHERE v IN (SELECT word FROM words)
  UNION SELECT v, word FROM shorter WHERE v IN (SELECT word FROM words)
  UNION SELECT x.word, y.word FROM shorter x JOIN shorter y ON x.i = y.i AND x.v = y.v AND x.word <> y.word
), near AS (
  SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k
  FROM pairs JOIN words ON word = b
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN x.n >= 2 * w.n THEN b END AS form, CASE WHEN x.n >= 2 * w.n THEN x.n END AS form_n
  FROM words w LEFT JOIN near x ON a = w.word AND k = 1
), walk AS (
  SELECT word, word AS place, 0 AS depth FROM formed
  UNION ALL SELECT walk.word, form, depth + 1 FROM walk JOIN formed ON formed.word = walk.place WHERE form IS NOT NULL
), roots AS (SELECT word, arg_max(place, depth) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN roots USING (word)
"""
