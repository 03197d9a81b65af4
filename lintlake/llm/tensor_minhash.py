"""MinHash near-dedup with tensored banding.

``2 * HALVES`` keys of ``ROWS`` minhashes each make two collections; a table key is a pair of one key of
either, so ``HALVES ** 2`` tables of ``2 * ROWS`` minhashes come from ``2 * HALVES * ROWS`` minhashes (256
tables from 64, where plain banding computes 1024). Two sets of similarity s share no table with
probability below ``2 * (1 - s ** ROWS) ** HALVES``: 4e-6 at 0.75.

Documents with equal shingle sets are one node. Candidates are found in two steps, neither of which lists
the pairs of a group:

1. each half key knows its least node. A node shares a table with the nodes that are least for one of its
   keys in both collections; these stars are verified and joined to components.
2. groups of a left key stay as long as their nodes lie in several components. A round takes the next nodes
   of each group (4, then 64, then 1024, ...) and joins them with its later nodes in other components that share
   a table, that is a right key as well; then components are joined again, and nodes that have met all others
   leave. Once the nodes left make at most ``LAST_ROUND`` comparisons, behind the first round, one round makes all of
   them. A pair is made once, by its first common left key. So every pair of a table is either verified or already in
   one component. Groups of up to ``PAIRED`` nodes list their pairs. A larger one is dealt into blocks of ``SLICE`` by
   ``PART`` nodes, which are compared as arrays: a node that may have links is a row with the nodes it may be linked with,
   its set joins it once a block, and a block returns links that join something.

Neither way makes a pair whose 128 low bytes of minhashes agree too seldom (72 of 128; 96 are expected at 0.75,
five deviations away) or whose sizes rule a link out. Links are confirmed on full sets of shingles.

Defined results: a document without words, or null, has the empty set and is linked with nothing. With
fewer than five words the whole sequence is the only shingle. Nodes are numbers of shingle sets, not doc_ids, so
rows are linked by their texts alone and one row of each component is kept: the least by (doc_id, digest of the
text). Rows that repeat both are one document. In the report, ``component_id`` is the least doc_id of the documents
that a chain of links joins, where rows that share a doc_id are linked too; rows without a doc_id aren't linked for that.
A missing doc_id counts as the least one. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lintlake.llm.common import NO_ID, doc_id_of, key_columns, keyed, written
from lintlake.llm.components import components
from lintlake.llm.text_arrays import LOWER, NOT_SPACE, Sums, chunks, lists_of, mix, ngrams, ranges, split, texts_of, values

WORDS, PERCENT = 5, 75
HALVES, ROWS = 16, 2
SIGNED, LEAST_AGREEING = 128, 72
FIRST_TAKE, FASTER = 4, 16
#: Comparisons that one round makes at once, behind the first: the squares of the sizes of the groups that stay.
LAST_ROUND = 200_000_000
#: Nodes of a group whose pairs are rows of a join; larger ones are compared in blocks of so many nodes by so many.
PAIRED, SLICE, PART = 64, 512, 8192
#: Pairs that a task weighs at once.
AT_ONCE = 1 << 19
_seed = np.arange(1, 2 * SIGNED + 1, dtype=np.uint64)
FACTORS = mix(_seed * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (64 bits each) of all texts, sorted within each, and the first one of each text."""
    data = LOWER[data]
    starts, ends, first = split(data, offsets, NOT_SPACE)
    n = np.diff(first)
    hashes = Sums(data).hash(starts, ends)
    grams = ngrams(hashes, words)
    text = np.repeat(np.arange(len(n)), np.maximum(n - words + 1, 0))
    of = grams[ranges(first[:-1][n >= words], (n - words + 1)[n >= words])]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        whole = Sums(hashes).hash(first[short], first[short + 1]) ^ mix(n[short].astype(np.uint64))
        text, of = np.concatenate([text, short]), np.concatenate([of, whole])
    by = np.lexsort((of, text))
    text, of = text[by], of[by]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (text[1:] != text[:-1])
    return of[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, digest, half keys and low bytes of the minhashes of each set."""
    for batch in chunks(batches):
        shingles, first = shingle_sets(*texts_of(batch.column("text")))
        full = np.flatnonzero(np.diff(first))
        at = first[full]
        rows = batch.num_rows
        digest = np.zeros((2, rows), np.uint64)
        halves = np.zeros((rows, 2 * HALVES), np.int64)
        low = np.zeros((rows, SIGNED), np.uint8)

        if len(full):
            for k, c in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                digest[k, full] = np.add.reduceat(mix(shingles ^ np.uint64(c)), at)
            key = np.zeros(len(full), np.uint64)
            for r in range(SIGNED):
                least = np.minimum.reduceat((shingles ^ FACTORS[-1 - r]) * FACTORS[r] >> np.uint64(24), at)
                low[full, r] = (mix(least) & np.uint64(0xFF)).astype(np.uint8)
                if r < 2 * HALVES * ROWS:
                    h = r // ROWS
                    key = mix((key if r % ROWS else np.full(len(full), h + 1, np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + least)
                    halves[full, h] = key.view(np.int64)
        sizes = pa.array(np.arange(rows + 1) * 2 * HALVES, pa.int32())
        words = pa.array(np.arange(rows + 1) * (SIGNED // 8), pa.int32())
        yield pa.record_batch(
            [batch.column("id"), batch.column("tk"), pa.array(np.diff(first), pa.int64()), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
             pa.ListArray.from_arrays(sizes, pa.array(halves.ravel())), pa.ListArray.from_arrays(words, pa.array(low.view(np.int64).ravel()))],
            ["id", "tk", "n", "d1", "d2", "halves", "low"],
        )


SKETCH = "id long, tk long, n long, d1 long, d2 long, halves array<long>, low array<long>"


def _bodies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        shingles, first = shingle_sets(*texts_of(batch.column("text")))
        body = shingles.tobytes()
        cut = first * 8
        yield pa.record_batch([batch.column("node"), pa.array([body[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())], ["node", "body"])


def _linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yes = []
        for x, y in zip(batch.column("body_a"), batch.column("body_b"), strict=True):
            x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            yes.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(yes, pa.bool_()))


def may_link(n_a: Column, low_a: Column, n_b: Column, low_b: Column) -> Column:
    """Whether sizes and minhash bytes leave a link possible; bytes that differ are counted word by word."""
    differ = F.lit(0)
    for i in range(SIGNED // 8):
        x = F.get(low_a, i).bitwiseXOR(F.get(low_b, i))
        some = x.bitwiseOR(F.shiftrightunsigned(x, 4)).bitwiseAND(F.lit(0x0F0F0F0F0F0F0F0F))  # short: a join's condition names x anew each time
        differ = differ + F.bit_count((some + F.lit(0x0F0F0F0F0F0F0F0F)).bitwiseAND(F.lit(0x1010101010101010)))
    fits = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * PERCENT
    return fits & (differ <= SIGNED - LEAST_AGREEING)


def _keys_of(column: pa.ChunkedArray, pad: int) -> np.ndarray:
    """Half keys of all rows, filled up with ``pad``."""
    flat, at = lists_of(column.combine_chunks())
    n = np.diff(at)
    out = np.full((len(n), HALVES), pad, np.int64)
    out[np.arange(HALVES) < n[:, None]] = flat
    return out


def _differing(low_a: np.ndarray, low_b: np.ndarray) -> np.ndarray:
    """Number of minhash bytes in which each row of one side differs from each of the other, as :func:`may_link` counts."""
    out = np.zeros((len(low_a), len(low_b)), np.uint8)
    for i in range(SIGNED // 8):
        some = low_a[:, i, None] ^ low_b[None, :, i]
        some |= some >> np.uint64(4)
        some &= np.uint64(0x0F0F0F0F0F0F0F0F)
        some += np.uint64(0x0F0F0F0F0F0F0F0F)
        out += np.bitwise_count(some & np.uint64(0x1010101010101010))
    return out


MET = "h long, slice long, part long, node long, others array<long>"


def _met(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
    """Nodes of a block that may have links: those of one side alone, those of the other with the nodes they may be linked with."""
    none = pa.table([pa.array([], t) for t in (*[pa.int64()] * 4, pa.list_(pa.int64()))], MET.replace(" array<long>", "").replace(" long", "").split(", "))
    if not one.num_rows or not two.num_rows:
        return none
    h = key[0].as_py()
    column = lambda t, name: t.column(name).to_numpy()
    a, n_a, comp_a = (column(one, c) for c in ("node", "n", "comp"))
    low_a, left_a, right_a = lists_of(one.column("low").combine_chunks())[0].view(np.uint64).reshape(len(a), -1), _keys_of(one.column("left"), NO_ID), _keys_of(one.column("right"), NO_ID)
    used, nodes, others = np.zeros(len(a), bool), [], []
    step = max(1, AT_ONCE // len(a))
    for lo in range(0, two.num_rows, step):
        rows = two.slice(lo, step)
        b, n_b, comp_b = (column(rows, c) for c in ("node", "n", "comp"))
        low_b, left_b, right_b = lists_of(rows.column("low").combine_chunks())[0].view(np.uint64).reshape(len(b), -1), _keys_of(rows.column("left"), NO_ID + 1), _keys_of(rows.column("right"), NO_ID + 1)
        fits = np.minimum.outer(n_a, n_b) * 100 >= np.maximum.outer(n_a, n_b) * PERCENT
        fits &= (a[:, None] < b) & (comp_a[:, None] != comp_b) & (_differing(low_a, low_b) <= SIGNED - LEAST_AGREEING)
        y, x = np.nonzero(fits.T)
        for c in range(0, len(x), AT_ONCE // 8):
            i, j = x[c : c + AT_ONCE // 8], y[c : c + AT_ONCE // 8]
            common = (left_a[i][:, :, None] == left_b[j][:, None, :]).any(2)
            mine = np.where(common, left_a[i], np.iinfo(np.int64).max).min(1) == h
            i, j = i[mine], j[mine]
            table = (right_a[i][:, :, None] == right_b[j][:, None, :]).any((1, 2))
            i, j = i[table], j[table]
            if len(i):
                used[i] = True
                cuts = np.flatnonzero(np.diff(j)) + 1
                nodes.append(b[j[np.concatenate([[0], cuts])]])
                others += np.split(a[i], cuts)
    if not nodes:
        return none
    nodes = np.concatenate([a[used], *nodes])
    sizes = np.concatenate([[0], np.zeros(int(used.sum()), np.int64), [len(x) for x in others]])
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(others)))
    return pa.table([*[pa.array(np.full(len(nodes), k.as_py(), np.int64)) for k in key], pa.array(nodes), lists], none.column_names)


def _joining(block: pa.Table) -> pa.Table:
    """Links of a block that join something: at most one for each node."""
    flat, at = lists_of(block.column("others").combine_chunks())
    node, full = block.column("node").to_numpy(), np.diff(at) > 0
    body = [np.frombuffer(x.as_buffer(), np.uint64) for x in block.column("body")]
    alone = np.flatnonzero(~full)
    alone = alone[np.argsort(node[alone])]
    root, out = {int(k): int(k) for k in node[alone]}, []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for r in np.flatnonzero(full):
        which = alone[np.searchsorted(node[alone], flat[at[r] : at[r + 1]])]
        size = np.array([len(body[k]) for k in which])
        near = np.concatenate([body[k] for k in which])
        place = np.minimum(np.searchsorted(body[r], near), len(body[r]) - 1)
        both = np.add.reduceat((body[r][place] == near).astype(np.int64), np.cumsum(size) - size)
        linked = node[which[100 * both >= PERCENT * (size + len(body[r]) - both)]].tolist()
        for k in {top(k) for k in linked}:
            out.append((k, int(node[r])))
            root[k] = top(linked[0])
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _block_links(full: DataFrame, firsts: DataFrame, bodies: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between ``firsts`` and later nodes of other components in their groups."""
    key = ["h", "slice", "part"]
    dealt = lambda column, of: F.pmod(F.xxhash64("node", F.lit(column)), F.col(of))
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    one = firsts.withColumn("slice", dealt("slice", "slices")).withColumn("part", each("parts"))
    two = full.withColumn("slice", each("slices")).withColumn("part", dealt("part", "parts"))
    one, two = (df.toDF(*df.columns) for df in (one, two))  # columns of their own: both come from one table
    met = written(one.groupBy(*key).cogroup(two.groupBy(*key)).applyInArrow(_met, MET))
    return met.join(bodies, "node").groupBy(*key).applyInArrow(_joining, "a long, b long")


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(side if c == "node" else f"{c}_{side}") for c in df.columns])


def _verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar enough."""
    pairs = written(pairs)
    return written(pairs.join(_side(bodies, "b"), "b").join(_side(bodies, "a"), "a").mapInArrow(_linked, "a long, b long"))


def _halves_of(own: DataFrame, value: str) -> DataFrame:
    """Per node the values of its half keys, by collection."""
    sides = [F.collect_set(F.when(F.col("side") == s, F.col(value))).alias(name) for s, name in ((0, "left"), (1, "right"))]
    return own.groupBy("node").agg(*sides)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(id, tk, n_shingles, least)`` of every row; ``least (id, tk)`` is the first row of its component."""
    rows = keyed(docs)
    sketch = written(rows.mapInArrow(_sketch, SKETCH).withColumn("at", F.monotonically_increasing_id()))
    equal, own_key = ["d1", "d2", "n"], F.struct("id", "tk").alias("least")
    classes = sketch.where("n > 0").groupBy(*equal).agg(F.min(F.struct("id", "tk", "at")).alias("own"))
    classes = written(classes.select(*equal, "own.*", F.monotonically_increasing_id().alias("node")))  # written, so numbers stay
    alone = sketch.where("n = 0").select("id", "tk", F.col("n").alias("n_shingles"), own_key)  # empty sets aren't equal to one another
    members = sketch.where("n > 0").select("id", "tk", *equal).join(classes.select(*equal, "node"), equal).select("id", "tk", F.col("n").alias("n_shingles"), "node")

    first = sketch.select("at", "n", "low", "halves").join(classes.select("at", "node"), "at")
    halves = first.select("node", F.posexplode("halves").alias("pos", "h")).select("node", "h", (F.col("pos") >= HALVES).cast("int").alias("side"))
    least = halves.groupBy("h").agg(F.min("node").alias("m"), F.max("node").alias("top")).where("m != top").select("h", "m")
    own = written(halves.join(least, "h"))

    candidates = own.select("node").distinct()
    sets = written(first.select("node", "n", "low").join(candidates, "node"))
    texts = rows.join(classes.select("id", "tk", "node").join(candidates, "node"), ["id", "tk"]).dropDuplicates(["id", "tk"])  # rows may repeat
    bodies = written(texts.select("node", "text").mapInArrow(_bodies, "node long, body binary"))

    star = _halves_of(own, "m").select(F.explode(F.array_intersect("left", "right")).alias("a"), F.col("node").alias("b")).where("a != b")
    possible = may_link(F.col("n_a"), F.col("low_a"), F.col("n_b"), F.col("low_b"))
    star = star.join(_side(sets, "b"), "b").join(_side(sets, "a"), "a").where(possible).select("a", "b")
    comp = written(components(_verified(star, bodies)))

    def with_comp(df):
        return df.join(comp.select("node", F.col("comp").alias("_c")), "node", "left").withColumn("comp", F.coalesce("_c", "node")).drop("_c")

    def mixed(df):
        """Rows of the keys whose nodes lie in several components, with the number of nodes of their key."""
        several = df.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo != hi")
        return df.join(several.select("h", "size"), "h")

    keys = written(_halves_of(mixed(with_comp(own)), "h").where("size(left) > 0 and size(right) > 0").join(sets, "node"))
    group = keys.select(F.explode("left").alias("h"), "node")
    take = FIRST_TAKE
    while True:
        seen = Observation()
        active = written(mixed(with_comp(group)).observe(seen, F.sum("size").alias("squares"), F.max("size").alias("largest")))
        squares = seen.get["squares"]
        if squares is None:
            break
        last = take > FIRST_TAKE and squares <= LAST_ROUND
        full = active.join(keys, "node")
        firsts = full
        if not last:
            order = F.row_number().over(Window.partitionBy("h").orderBy("node"))
            pivots = written(active.withColumn("at", order).where(F.col("at") <= take).select("h", "node"))
            firsts = full.join(pivots, ["h", "node"], "left_semi")
        few = F.col("size") <= PAIRED
        met = _side(firsts.where(few), "a").join(
            _side(full.where(few), "b"),
            (F.col("h_a") == F.col("h_b")) & (F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b"))
            & possible & F.arrays_overlap("right_a", "right_b") & (F.get(F.array_sort(F.array_intersect("left_a", "left_b")), 0) == F.col("h_a")),
        )
        links = _verified(met.select("a", "b"), bodies)
        if seen.get["largest"] > PAIRED:
            blocks = [df.where(~few).withColumn("slices", F.ceil(F.col("size") / SLICE)).withColumn("parts", F.ceil(F.col("size") / PART)) for df in (full, firsts)]
            links = written(links.unionByName(_block_links(*blocks, bodies)))
        if not links.isEmpty():
            old = comp.select(F.col("node").alias("a"), F.col("comp").alias("b"))
            comp = written(components(old.unionByName(links)))
        if last:
            break
        group = active.select("h", "node").join(pivots, ["h", "node"], "left_anti")
        take *= FASTER
    named = comp.join(classes.select("node", own_key), "node")
    least = written(named.join(named.groupBy("comp").agg(F.min("least").alias("first")), "comp").select("node", "first"))
    firsts = classes.select("node", own_key).join(least, "node", "left").select("node", F.coalesce("first", "least").alias("least"))
    return members.join(firsts, "node").select("id", "tk", "n_shingles", "least").unionByName(alone)


def report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``; the least document of each component is kept."""
    out = written(near_duplicates(docs).withColumn("component", F.col("least.id")))
    several = out.where(F.col("id") != F.lit(NO_ID)).groupBy("id").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("id")
    chains = components(out.select("id", "component").join(several, "id").select(F.col("id").alias("a"), F.col("component").alias("b")))
    out = out.join(chains.withColumnRenamed("node", "component"), "component", "left")
    kept = F.col("least") == F.struct("id", "tk")
    return out.select(doc_id_of(F.col("id")).alias("doc_id"), "n_shingles", doc_id_of(F.coalesce("comp", "component")).alias("component_id"), kept.alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the least doc_id, once."""
    key = key_columns(docs)
    rows = docs.select(key["id"].alias("id"), key["tk"].alias("tk"), F.struct("*").alias("row"))  # no name of the table can clash
    kept = near_duplicates(docs).where(F.col("least") == F.struct("id", "tk")).select("id", "tk").distinct()
    once = Window.partitionBy("id", "tk").orderBy(F.lit(0))  # rows that repeat doc_id and text
    return rows.join(kept, ["id", "tk"], "left_semi").withColumn("at", F.row_number().over(once)).where("at = 1").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """Per document the size of its set, its component, and whether it is kept."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
