"""Phrase collocations by prefix-free parsing: n-grams are counted once per distinct chunk.

Every document is cut into chunks by its content: a chunk ends behind ``overlap = max_words - 1`` consecutive
words whose hash is divisible by ``RARITY``, and the next one begins with the same words, so no chunk is a proper
prefix of another and equal passages give equal chunks wherever they stand. Chunks travel as strings, packed by
bucket and equal ones of a task once with their number; a bucket's distinct chunks with their frequencies are the
dictionary, which is written to the shared folder. An n-gram is counted inside each distinct chunk, weighted by
its frequency; those that start in the last ``overlap`` words belong to the next chunk, which begins there.

A task sends each n-gram of its buckets once, as 96 bits of a digest and a count, to the partition of the digest. Those
that reach ``min_count`` there are answered to one bucket that has them, which looks up their words, so strings
travel only for phrases that can matter: a part of a candidate is at least as frequent as the candidate. Scores,
drops and ranks are joins of that table of frequent phrases. Products are decimals of 38 digits.

Hot keys: a common n-gram or chunk is one row per task or bucket, whatever its frequency. A chunk is never longer
than its document.

Defined results: null and empty texts have no words; a null lang is ``und``. Repeated rows count each. Extra columns
are ignored. An empty table, or one without frequent phrases, gives an empty result. Phrases are those of one lang;
a phrase never crosses a separator or a document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import packed, partitions_of, small_batches, unpacked, written
from lintlake.llm.text_arrays import BASE, BASE_2, CHUNK_BYTES, LOWER, Sums, chunks, give_back, mix, ngrams, ranges, split, texts_of

MAX_WORDS, MIN_COUNT, DROP_PERCENT, TOP = 3, 10, 50, 2000
#: One in so many places ends a chunk.
RARITY = 16
SEND_BYTES, SEND_GRAMS = 16 << 20, 1 << 21
BUCKETS_PER_PARTITION = 4
UNKNOWN = "und"

_bytes = np.arange(256)
SEPARATOR = np.isin(_bytes, list(b".,;:!?\n\x0b\x0c\r"))
WORD = ~(SEPARATOR | (_bytes == 0x20) | (_bytes == 0x09))


def parse(data: np.ndarray, offsets: np.ndarray, overlap: int, rarity: int = RARITY):
    """The chunks of some texts.

    Returns the normalised bytes (words joined by one blank, or by a newline where a separator stood), and of every
    chunk its text, its first and last byte there, and whether it is the last one of its text.
    """
    data = LOWER[data]
    starts, ends, first = split(data, offsets, WORD)
    seps = np.concatenate([[0], np.cumsum(SEPARATOR[data])])
    lengths = ends - starts
    new_ends = np.cumsum(lengths + 1)
    new_starts = new_ends - lengths - 1
    flat = np.full(int(new_ends[-1]) if len(new_ends) else 0, 0x20, np.uint8)
    flat[ranges(new_starts, lengths)] = data[ranges(starts, lengths)]
    if len(starts) > 1:
        broken = seps[starts[1:]] > seps[ends[:-1]]
        flat[new_ends[:-1][broken] - 1] = 0x0A
    new_ends = new_ends - 1
    words = Sums(flat).hash(new_starts, new_ends)
    window = ngrams(words, overlap)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin = np.zeros(len(words), bool)
    begin[: len(window)] = window % np.uint64(rarity) == 0
    inside = np.arange(len(words)) + overlap <= first[1:][text]  # a window that ends in its text
    begin &= inside
    begin[first[:-1][np.diff(first) > 0]] = True
    at = np.flatnonzero(begin)
    owner = text[at]
    final = np.ones(len(at), bool)
    final[:-1] = owner[1:] != owner[:-1]
    stop = np.append(at[1:], 0) + overlap
    stop = np.where(final, first[1:][owner] if len(at) else 0, stop)
    return flat, owner, new_starts[at], new_ends[stop - 1], final


def _lang_codes(langs: list[str | None]) -> tuple[list[str], np.ndarray]:
    known = [UNKNOWN if x is None else x for x in langs]
    names = sorted(set(known))
    place = {x: i for i, x in enumerate(names)}
    return names, np.array([place[x] for x in known], np.int64)


def _lang_hashes(names: list[str]) -> np.ndarray:
    body = [x.encode() for x in names]
    at = np.concatenate([[0], np.cumsum([len(b) for b in body])]).astype(np.int64)
    return Sums(np.frombuffer(b"".join(body), np.uint8), BASE_2).hash(at[:-1], at[1:]) ^ mix(np.diff(at).astype(np.uint64) + np.uint64(1))


def _distinct(keys: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of one row of every distinct key, in order of the keys, and the sum of weights."""
    by = np.lexsort(keys[::-1])
    new = np.ones(len(by), bool)
    new[1:] = np.logical_or.reduce([k[by][1:] != k[by][:-1] for k in keys]) if len(by) > 1 else True
    at = np.flatnonzero(new)
    return by[at], np.add.reduceat(weights[by], at) if len(at) else weights[:0]


def _send(overlap: int, buckets: int):
    """Chunks of a task, equal ones once, packed by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, strings, size = [], [], 0

        def out():
            names, lang = _lang_codes([x for part in held for x in part[4]])
            one, two, final, count = (np.concatenate(x) for x in zip(*(h[:4] for h in held), strict=True))
            salt = _lang_hashes(names)[lang]
            one, two = mix(one ^ salt), mix(two ^ salt)
            at, count = _distinct([one, two], count)
            bucket = (one[at] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            parts = np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1)
            rows = [packed((names, lang[at[p]], one[at[p]], two[at[p]], final[at[p]], count[p], [strings[i] for i in at[p]])) for p in parts]
            return pa.record_batch([pa.array([int(bucket[p[0]]) for p in parts], pa.int32()), pa.array(rows, pa.binary())], ["bucket", "packed"])

        for batch in chunks(batches):
            langs = batch.column("lang").to_pylist()
            flat, owner, lo, hi, final = parse(*texts_of(batch.column("text")), overlap)
            if not len(owner):
                continue
            length = (hi - lo).astype(np.uint64) * np.uint64(2) + final
            one, two = (Sums(flat, b).hash(lo, hi) ^ mix(length) for b in (BASE, BASE_2))
            lang = np.array([hash(x) for x in langs], np.int64).view(np.uint64)[owner]
            at, count = _distinct([one, two, lang], np.ones(len(owner), np.int64))
            body = flat.tobytes()
            held.append((one[at], two[at], final[at], count, [langs[i] for i in owner[at]]))
            strings += [body[a:b] for a, b in zip(lo[at].tolist(), hi[at].tolist(), strict=True)]
            size += int((hi - lo)[at].sum()) + 100 * len(at)
            if size >= SEND_BYTES:
                yield out()
                held, strings, size = [], [], 0
        if held:
            yield out()

    return run


def _merge(parts: list[tuple]) -> bytes:
    """The dictionary of one bucket: distinct chunks with their frequencies."""
    names, lang = _lang_codes([p[0][i] for p in parts for i in p[1].tolist()])
    one, two, final, count = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4, 5))
    strings = [s for p in parts for s in p[6]]
    at, count = _distinct([one, two], count)
    return packed((names, lang[at], final[at], count, [strings[i] for i in at]))


def _by_bucket(batches: Iterable[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """``work(bucket, values)`` for the rows of each bucket; they come by bucket."""
    bucket, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            b = batch.column(0)[i].as_py()
            if b != bucket and held:
                yield from work(bucket, held)
                held = []
                give_back()
            bucket = b
            held.append(tuple(c[i].as_py() for c in batch.columns[1:]))
    if held:
        yield from work(bucket, held)
    give_back()


def _dictionary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def work(bucket, rows):
        body = _merge([unpacked(r[0]) for r in rows])
        yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([body], pa.binary())], ["bucket", "packed"])

    return _by_bucket(batches, work)


def grams_of(entry: bytes, max_words: int, slice_bytes: int = CHUNK_BYTES):
    """The n-grams of a bucket's dictionary, some chunks at a time: digests, counts, langs, bytes and places."""
    names, lang, final, count, strings = unpacked(entry)
    salt = _lang_hashes(names)
    sizes = np.array([len(s) for s in strings], np.int64)
    part = np.cumsum(sizes) // slice_bytes
    for chosen in np.split(np.arange(len(strings)), np.flatnonzero(np.diff(part)) + 1):
        body = b"\n".join([strings[i] for i in chosen])
        data = np.frombuffer(body, np.uint8)
        at = np.concatenate([[0], np.cumsum(sizes[chosen] + 1)])[:-1]
        starts, ends, _ = split(data, np.array([0, len(data)]), WORD)
        first = np.searchsorted(starts, np.append(at, len(data) + 1))
        chunk = np.repeat(np.arange(len(chosen)), np.diff(first))
        # what starts in the overlap of a chunk that has a successor is counted there
        own = np.arange(len(starts)) < first[1:][chunk] - np.where(final[chosen], 0, max_words - 1)[chunk]
        joined = data[np.minimum(ends, len(data) - 1)] == 0x20
        if len(joined):
            joined[-1] = False
        sums = [Sums(data, b) for b in (BASE, BASE_2)]
        for n in range(1, max_words + 1):
            word = np.flatnonzero(own)
            if n > 1:
                word = word[word + n - 1 < len(starts)]
                for k in range(n - 1):
                    word = word[joined[word + k]]
            lo, hi = starts[word], ends[word + n - 1]
            code = lang[chosen][chunk[word]]
            extra = mix((hi - lo).astype(np.uint64)) ^ salt[code]
            one = mix(sums[0].hash(lo, hi) ^ extra)
            two = (mix(sums[1].hash(lo, hi) ^ extra) >> np.uint64(32)).astype(np.uint32)
            yield n, one, two, count[chosen][chunk[word]], code, lo, hi, body, names


def planes(digests: np.ndarray) -> tuple:
    """Ascending digests as differences, byte by byte, so that their common leading bytes compress."""
    return np.diff(digests, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), len(digests)


def unplaned(body: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)


def _count(max_words: int, parts: int):
    """Digests and counts of the n-grams of a task's buckets, equal ones once, packed by the range of the digest."""

    def out(held):
        one, two, count, source = (np.concatenate(x) for x in zip(*held, strict=True))
        at, count = _distinct([one, two], count)
        one, two, source = one[at], two[at], source[at]
        cuts = np.searchsorted(one, range_starts(parts))
        rows = [(p, packed((planes(one[lo:hi]), two[lo:hi], count[lo:hi], source[lo:hi]))) for p, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(one)], strict=True)) if hi > lo]
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary()))], ["part", "packed"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for bucket, entry in zip(*batch.columns, strict=True):
                for _, one, two, count, *_ in grams_of(entry.as_py(), max_words):
                    at, count = _distinct([one, two], count)
                    held.append((one[at], two[at], count, np.full(len(at), bucket.as_py(), np.int32)))
                    size += len(at)
                if size >= SEND_GRAMS:
                    yield out(held)
                    held, size = [], 0
                    give_back()
        if held:
            yield out(held)
        give_back()

    return run


def range_starts(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(parts)], np.uint64)


def _frequent(min_count: int):
    """The n-grams that reach ``min_count``, each answered to one of its buckets with the whole count."""

    def work(part, rows):
        digests, low, counts, source = [], [], [], []
        for (body,) in rows:
            (plane, n), two, count, bucket = unpacked(body)
            digests.append(unplaned(plane, n))
            low.append(two)
            counts.append(count)
            source.append(bucket)
        one, two, count, source = (np.concatenate(x) for x in (digests, low, counts, source))
        at, count = _distinct([one, two], count)
        keep = count >= min_count
        at, count = at[keep], count[keep]
        by = np.argsort(source[at], kind="stable")
        at, count = at[by], count[by]
        answers = [p for p in np.split(np.arange(len(at)), np.flatnonzero(np.diff(source[at])) + 1) if len(p)]
        yield pa.record_batch(
            [pa.array([int(source[at[p[0]]]) for p in answers], pa.int32()), pa.array([1] * len(answers), pa.int32()), pa.array([packed((one[at[p]], two[at[p]], count[p])) for p in answers], pa.binary())],
            ["bucket", "kind", "packed"],
        )

    return lambda batches: _by_bucket(batches, work)


def _phrases(max_words: int):
    """The words of answered n-grams from the dictionary of their bucket, and the number of words per lang."""

    def work(bucket, rows):
        entry = next(body for kind, body in rows if kind == 0)
        answers = [unpacked(body) for kind, body in rows if kind == 1]
        one, two, count = (np.concatenate([a[k] for a in answers]) if answers else np.zeros(0, t) for k, t in enumerate((np.uint64, np.uint32, np.int64)))
        by = np.lexsort((two, one))
        one, two, count = one[by], two[by], count[by]
        seen = np.zeros(len(one), bool)
        totals: dict[str, int] = {}
        for n, high, low, weight, code, lo, hi, body, names in grams_of(entry, max_words):
            if n == 1:
                for name, total in zip(names, np.bincount(code, weight, len(names)), strict=True):
                    totals[name] = totals.get(name, 0) + int(total)
            if not len(one) or not len(high):
                continue
            at, _ = _distinct([high, low], weight)
            place = np.searchsorted(one, high[at])
            for _ in range(4):  # digests whose first 64 bits are equal lie side by side
                inside = np.minimum(place, len(one) - 1)
                place = np.where((place < len(one)) & (one[inside] == high[at]) & (two[inside] < low[at]), place + 1, place)
            inside = np.minimum(place, len(one) - 1)
            hit = (place < len(one)) & (one[inside] == high[at]) & (two[inside] == low[at])
            hit[hit] = ~seen[inside[hit]]
            seen[inside[hit]] = True
            chosen = at[hit]
            yield rows_of(
                [names[c] for c in code[chosen].tolist()], [body[a:b].decode() for a, b in zip(lo[chosen].tolist(), hi[chosen].tolist(), strict=True)],
                [n] * len(chosen), count[inside[hit]],
            )
        yield rows_of(list(totals), [None] * len(totals), [0] * len(totals), list(totals.values()))

    def rows_of(lang, phrase, words, f):
        return pa.record_batch([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(words, pa.int32()), pa.array(f, pa.int64())], ["lang", "phrase", "words", "f"])

    return lambda batches: _by_bucket(batches, work)


def frequent_phrases(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """``(lang, phrase, words, f)``: all phrases of up to ``max_words`` words that stand ``min_count`` times.

    Rows with 0 words and no phrase hold numbers of word occurrences of a lang; they are to be added up.
    """
    if max_words < 2:
        raise ValueError("a phrase has at least two words")
    small_batches(docs.sparkSession)
    n = partitions_of(docs.sparkSession)
    rows = docs.select(F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), docs["lang"].cast("string").alias("lang"))
    sent = rows.mapInArrow(_send(max_words - 1, n * BUCKETS_PER_PARTITION), "bucket int, packed binary")
    dictionary = written(sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_dictionary, "bucket int, packed binary"))
    counted = dictionary.mapInArrow(_count(max_words, n), "part int, packed binary")
    answers = counted.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_frequent(min_count), "bucket int, kind int, packed binary")
    asked = dictionary.select("bucket", F.lit(0).alias("kind"), "packed").unionByName(answers)
    return asked.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_phrases(max_words), "lang string, phrase string, words int, f long")


def part(phrase_words: Column, lo, n) -> Column:
    return F.array_join(F.slice(phrase_words, lo, n), " ")


def collocations(
    docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, drop_percent: int = DROP_PERCENT, top: int | None = TOP,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of every lang, or with ``top=None`` all."""
    table = written(frequent_phrases(docs, max_words, min_count))
    totals = table.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    grams = table.where("words > 0").select("lang", "phrase", "words", "f")
    found = grams.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    pieces = found.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "w")
    pieces = pieces.select("lang", "phrase", "words", "a", "k", part(F.col("w"), 1, F.col("k")).alias("head"), part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    for side, name in (("head", "l"), ("tail", "r")):
        pieces = pieces.join(grams.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    wide = "decimal(15,0)"
    squared = (F.col("a").cast(wide) * F.col("a").cast(wide)) * F.lit(1_000_000).cast("decimal(7,0)")
    pieces = pieces.withColumn("over", squared).withColumn("under", F.col("l").cast(wide) * F.col("r").cast(wide))
    scored = pieces.withColumn("score", F.expr("over div under"))
    scored = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = found.where("words > 2").select("lang", "words", "a", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    longer = longer.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    longer = longer.select("lang", part(F.col("w"), F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < drop_percent * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase"))
    kept = kept.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        kept = kept.where(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every lang."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH pieces AS (
  SELECT doc_id, rn, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT *, row_number() OVER () AS rn FROM documents)
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sized AS (SELECT lang, w, len(w) AS m FROM words WHERE len(w) > 0
), totals AS (SELECT lang, CAST(sum(m) AS BIGINT) AS n FROM sized GROUP BY lang
), grams AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, s, CAST(count(*) AS BIGINT) AS f
  FROM (SELECT lang, w, m, s, unnest(range(1, m - s + 2)) AS i FROM sized, (VALUES (1), (2), (3)) AS sizes(s) WHERE m >= s)
  GROUP BY lang, phrase, s
), candidates AS (
  SELECT lang, phrase, s, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE s >= 2 AND f >= 10
), cuts AS (
  SELECT lang, phrase, s, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:s], ' ') AS tail
  FROM (SELECT *, unnest(range(1, s)) AS k FROM candidates)
), scored AS (
  SELECT c.lang, c.phrase, c.s, c.a, k, h.f AS l, t.f AS r,
    CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
  FROM cuts c JOIN grams h ON h.lang = c.lang AND h.phrase = c.head JOIN grams t ON t.lang = c.lang AND t.phrase = c.tail
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM candidates WHERE s = 3
), kept AS (
  SELECT * FROM lowest x WHERE NOT EXISTS (SELECT 1 FROM longer y WHERE y.lang = x.lang AND y.phrase = x.phrase AND 100 * y.a >= 50 * x.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
