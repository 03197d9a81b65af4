"""Evaluation of findings against labelled truth.

Tables: ``truth(fixture, ord, id, severity, domain, title, file, line, tool_detectable,
root_cause)`` and ``predictions(fixture, tier, run, ord, id, severity, domain, rule, title,
evidence)``. A run is one ``(fixture, tier, run)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.scalars import TITLE_SIMILARITY, js_round, lookup, normalize_path, title_words
from lintlake.operators.detect import c
from lintlake.operators.graph import connected
from lintlake.operators.positions import numbered_positions
from lintlake.policy import SEVERITY_WEIGHTS
from lintlake.session import cut_lineage, new_table

# --- Fixed values ---------------------------------------------------------------------
LINE_REACH, DUPLICATE_REACH = 5, 3
MATCH_TYPES = {1: "exact-file-line", 2: "same-file-rule", 3: "same-domain-rule"}
UNMATCHED = "unmatched"
MIN_SYMPTOMS = 2
GATES = {"precision": 0.6, "recall": 0.5, "variance": 0.15, "actionability": 3.0}
NO_ROOT_CAUSE = "(no root cause)"
DIGITS = 3
# ----------------------------------------------------------------------------------------

RUN = ["fixture", "tier", "run"]
#: Rows (of truth and of choices) that are settled at once, as Arrow buffers and numbers; what is linked with more
#: is settled in slices of a quarter as many truth rows.
BLOCK_ROWS, MIN_SLICE = 500_000, 8
SHARES = ["precision", "recall", "tool_recall", "root_cause_hit_rate", "actionability", "dedup_effectiveness"]


def runs_of(predictions: DataFrame) -> DataFrame:
    return predictions.select(*RUN).distinct()


def key_text(*parts: Column) -> Column:
    return F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])


# -- similar titles ---------------------------------------------------------------------


def similar_titles(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs ``(keys, title_l, title_r)`` of distinct titles whose words overlap enough.

    Two sets with this overlap share a word among the first few of each when words are
    ordered from rare to frequent. Only those words are joined, so a word that every
    title has brings no pairs together.
    """

    def titles(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.col("title").alias(name)).distinct().withColumn("words", title_words(F.col(name)))

    l, r = titles(left, "title_l"), titles(right, "title_r")
    every = l.select(*keys, F.explode("words").alias("word")).unionByName(r.select(*keys, F.explode("words").alias("word")))
    frequency = every.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("df"))

    def rare_first(df: DataFrame, name: str) -> DataFrame:
        spread = df.select(*keys, name, "words", F.explode("words").alias("word")).join(frequency, [*keys, "word"])
        ordered = spread.groupBy(*keys, name, "words").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("o"))
        keep = F.size("words") - F.ceil(F.size("words") * F.lit(TITLE_SIMILARITY)).cast("int") + 1
        return ordered.select(*keys, name, "words", F.explode(F.slice("o", F.lit(1), keep)).alias("o")).select(
            *keys, name, F.col("words").alias(f"{name}_words"), F.col("o.word").alias("word")
        )

    pairs = rare_first(l, "title_l").join(rare_first(r, "title_r"), [*keys, "word"])
    shared = F.size(F.array_intersect("title_l_words", "title_r_words"))
    joint = F.size("title_l_words") + F.size("title_r_words") - shared
    return pairs.where(shared / joint >= TITLE_SIMILARITY).select(*keys, "title_l", "title_r").distinct()


# -- one-to-one matching -------------------------------------------------------------------


def _choices(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """What a truth row would take, best first: ``(run, level, key, pos, id)``.

    Rows with the same key have the same list, so a list is stored once: level 1 per
    (file, line), level 2 per (file, domain), level 3 per (domain, title).
    """
    ev = predictions.select(*RUN, "id", "ord", "domain", F.explode("evidence").alias("e")).select(
        *RUN, "id", "ord", "domain", normalize_path(F.col("e.file")).alias("file"), F.col("e.line").alias("line")
    )
    reach = F.sequence(c.line - LINE_REACH, c.line + LINE_REACH)
    wanted = truth.select(*RUN, "file", F.col("line").alias("at"), F.explode(reach).alias("line")).distinct()
    near = wanted.join(ev, [*RUN, "file", "line"]).select(
        *RUN, F.lit(1).alias("level"), key_text(c.file, F.col("at")).alias("key"), "id", "ord"
    )
    same_file = ev.select(*RUN, F.lit(2).alias("level"), key_text(c.file, c.domain).alias("key"), "id", "ord")
    alike = similar_titles(truth, predictions, [*RUN, "domain"])
    same_title = alike.join(
        predictions.select(*RUN, "domain", F.col("title").alias("title_r"), "id", "ord"), [*RUN, "domain", "title_r"]
    ).select(*RUN, F.lit(3).alias("level"), key_text(c.domain, c.title_l).alias("key"), "id", "ord")
    return (
        near.unionByName(same_file).unionByName(same_title)
        .groupBy(*RUN, "level", "key", "id")
        .agg(F.min("ord").alias("ord"))
    )


def _within_reach(rows: DataFrame, choices: DataFrame) -> DataFrame:
    """The choices that rows can come to.

    A finding on a single list is there for the rows of that list alone, so the n rows of a list never pass the
    n-th such finding.
    """
    lst = [*RUN, "level", "key"]
    wanted = rows.select(*RUN, F.posexplode("keys").alias("at", "key")).groupBy(*RUN, (c.at + 1).alias("level"), "key")
    used = cut_lineage(choices.join(wanted.agg(F.count(F.lit(1)).alias("wanted")), lst))
    alone = used.groupBy(*RUN, "id").agg(F.count(F.lit(1)).alias("lists")).where(c.lists == 1)
    own = numbered_positions(used.join(alone, [*RUN, "id"], "left_semi"), lst, ["ord", "id"], "pos")
    last = own.where(c.pos == c.wanted).select(*lst, F.struct("ord", "id").alias("last"))
    reached = used.join(last, lst, "left").where(c.last.isNull() | (F.struct("ord", "id") <= c.last))
    return reached.select(*choices.columns)


def _match_in_order(rows: DataFrame, choices: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Blocks too large for a task, a slice of their truth rows after the other, all blocks side by side.

    A slice meets what earlier ones have left. It needs one task per block, for its rows and the choices in their reach.
    """
    size = max(limit // 4, MIN_SLICE)
    sliced = numbered_positions(rows, keys, ["t_ord", "keys"], "rank")
    sliced = cut_lineage(sliced.withColumn("slice", F.floor((c.rank - 1) / size)).drop("rank"))
    spark, taken, done = rows.sparkSession, new_table(rows.sparkSession), None
    for k in range(sliced.agg(F.max("slice")).first()[0] + 1):
        now = sliced.where(c.slice == k).drop("slice")
        left = choices
        if done is not None:
            left = choices.join(done.select(*RUN, F.col("finding_id").alias("id")), [*RUN, "id"], "left_anti")
        block = now.unionByName(_within_reach(now, left), allowMissingColumns=True)
        part = _settled(block, keys)
        part.write.mode("append").parquet(taken)
        done = spark.read.schema(part.schema).parquet(taken)
    return done


def _take(table: pa.Table) -> pa.Table:
    """Settle one block: truth rows in order take the first finding of their lists that is still there.

    A finding that is gone stays gone, so each list is passed once, however many rows share it. Lists, keys and
    findings are numbers here, so a block is little more than its Arrow buffers.
    """
    rows = table.filter(pc.is_null(table["level"]))
    names = [f"_k{i}" for i in range(len(MATCH_TYPES))]
    for i, name in enumerate(names):
        rows = rows.append_column(name, pc.list_element(rows["keys"], i))
    rows = rows.sort_by([(k, "ascending") for k in ("t_ord", *names)])
    lists = table.filter(pc.is_valid(table["level"])).sort_by([(k, "ascending") for k in ("level", "key", "ord", "id")])
    ids = lists["id"].combine_chunks().dictionary_encode()
    codes = memoryview(pc.fill_null(ids.indices, -1).to_numpy(zero_copy_only=False).astype("int32"))
    levels = lists["level"].to_numpy()
    wanted, heads, ends = [], [], []
    for i, name in enumerate(names):
        begin, end = (int(x) for x in np.searchsorted(levels, [i + 1, i + 2]))
        keys = lists["key"].slice(begin, end - begin).combine_chunks().dictionary_encode()
        at = pc.index_in(rows[name].combine_chunks(), value_set=keys.dictionary)
        wanted.append(memoryview(pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype("int32")))
        # Keys come sorted, so the k-th of them in order of appearance has the k-th run of entries.
        bounds = np.searchsorted(keys.indices.to_numpy(zero_copy_only=False), np.arange(len(keys.dictionary) + 1)) + begin
        heads.append(bounds[:-1].tolist())
        ends.append(bounds[1:].tolist())
    taken = bytearray(len(ids.dictionary))
    found, level = np.full(rows.num_rows, -1, "int32"), np.zeros(rows.num_rows, "int32")
    for r in range(rows.num_rows):
        for i in range(len(names)):
            k = wanted[i][r]
            if k < 0:
                continue
            at, end, got = heads[i][k], ends[i][k], -1
            while at < end:
                got = codes[at]
                at += 1
                if got < 0 or not taken[got]:
                    break
                got = -1
            heads[i][k] = at
            if got >= 0:
                taken[got] = 1
                found[r], level[r] = got, i + 1
                break
    none = found < 0
    return pa.table(
        {
            **{k: rows[k] for k in RUN},
            "ord": rows["t_ord"].cast(pa.int64()),
            "finding_id": ids.dictionary.take(pa.array(found, mask=none)).cast(pa.string()),
            "level": pa.array(level, mask=none),
        }
    )


def _settled(both: DataFrame, keys: list[str]) -> DataFrame:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema.fields if f.name in RUN)
    return both.groupBy(*keys).applyInArrow(_take, f"{fields}, ord long, finding_id string, level int")


def _by_size(both: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows of blocks up to ``limit`` rows, and of larger ones."""
    sizes = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    return tuple(both.join(sizes.where(cond), keys, "left_semi") for cond in (c.size <= limit, c.size > limit))


def _match(rows: DataFrame, choices: DataFrame, limit: int) -> DataFrame:
    """Blocks that share no finding are settled side by side.

    A run is a block if it is small enough, at least without the choices that its rows can't come to; otherwise its linked
    components are (rows are linked by their lists, lists by their findings). A component that is too large for one task
    is settled slice by slice, in the order of its rows.
    """
    wanted = rows.select(*RUN, F.posexplode("keys").alias("at", "key")).select(*RUN, (c.at + 1).alias("level"), "key").distinct()
    choices = choices.join(wanted, [*RUN, "level", "key"], "left_semi")
    both = cut_lineage(rows.unionByName(choices, allowMissingColumns=True))  # rows of truth have no level

    def truth_of(df: DataFrame, *more: str) -> DataFrame:
        return df.where(c.level.isNull()).select(*RUN, *more, "t_ord", "keys")

    def choices_of(df: DataFrame, *more: str) -> DataFrame:
        return df.where(c.level.isNotNull()).select(*RUN, *more, "level", "key", "id", "ord")

    small, large = _by_size(both, RUN, limit)
    done = _settled(small, RUN)
    large = cut_lineage(large)
    if large.isEmpty():
        return done
    large = cut_lineage(truth_of(large).unionByName(_within_reach(truth_of(large), choices_of(large)), allowMissingColumns=True))
    small, large = _by_size(large, RUN, limit)
    done = done.unionByName(_settled(small, RUN))
    large = cut_lineage(large)
    if large.isEmpty():
        return done

    def list_node(level, key):
        return F.concat_ws("\u0002", F.lit("list"), level, key)

    own = F.transform("keys", lambda k, i: list_node(i + 1, k))
    first = large.where(c.level.isNull()).select(*RUN, own[0].alias("a"), F.explode(own).alias("b"))
    links = large.where(c.level.isNotNull()).select(*RUN, list_node(c.level, c.key).alias("a"), F.concat_ws("\u0002", F.lit("id"), "id").alias("b"))
    comps = connected(first.unionByName(links), RUN)
    node = F.when(c.level.isNull(), own[0]).otherwise(list_node(c.level, c.key))
    large = cut_lineage(large.withColumn("node", node).join(comps, [*RUN, "node"], "left").withColumn("comp", F.coalesce("comp", "node")))
    block = [*RUN, "comp"]
    small, large = _by_size(large, block, limit)
    done = done.unionByName(_settled(small, block))
    large = cut_lineage(large)
    if large.isEmpty():
        return done
    return done.unionByName(_match_in_order(truth_of(large, "comp"), choices_of(large, "comp"), block, limit))


def match_findings(
    truth: DataFrame, predictions: DataFrame, runs: DataFrame | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Greedy one-to-one matching: truth rows take their best remaining finding in order.

    The choices of all rows come from equi joins; then every block of linked rows is settled by itself.
    """
    runs = runs_of(predictions) if runs is None else runs.select(*RUN).distinct()
    base = (
        truth.withColumn("file", normalize_path(c.file))
        .join(runs, "fixture")
        .select(*RUN, F.col("ord").alias("t_ord"), "file", "line", "domain", "title")
    )
    rows = base.select(
        *RUN,
        "t_ord",
        F.array(key_text(c.file, c.line), key_text(c.file, c.domain), key_text(c.domain, c.title)).alias("keys"),
    )
    matched = _match(rows, _choices(base, predictions), block_rows)
    return (
        truth.join(runs, "fixture")
        .join(matched, [*RUN, "ord"], "left")
        .select(
            *RUN, "ord", F.col("id").alias("truth_id"), "severity", "domain", "title", "tool_detectable", "root_cause",
            "finding_id", F.coalesce(lookup(c.level, MATCH_TYPES), F.lit(UNMATCHED)).alias("match_type"),
            c.finding_id.isNotNull().alias("matched"),
        )
    )


# -- metrics -----------------------------------------------------------------------------------


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: js_round(F.col(n), DIGITS) for n in names})


def match_metrics(matches: DataFrame, predictions: DataFrame) -> DataFrame:
    """Counts, precision, recalls and actionability of each run, not rounded.

    False positives are counted by finding id, as rows whose id no truth row took.
    """

    def when(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    weight = lookup(c.severity, {k: float(v) for k, v in SEVERITY_WEIGHTS.items()}, 0.0)
    found = matches.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("issues"),
        when(c.matched).alias("true_positives"),
        when(~c.matched).alias("missed_issues"),
        when(c.tool_detectable).alias("_tool"),
        when(c.tool_detectable & c.matched).alias("_tool_hit"),
        when(~c.tool_detectable).alias("_other"),
        when(~c.tool_detectable & c.matched).alias("_other_hit"),
        F.sum(weight).alias("_weight"),
        F.sum(F.when(c.matched, weight).otherwise(0.0)).alias("_weight_hit"),
    )
    taken = matches.where(c.matched).select(*RUN, F.col("finding_id").alias("id")).distinct().withColumn("_hit", F.lit(1))
    reported = (
        predictions.select(*RUN, "id").join(taken, [*RUN, "id"], "left").groupBy(*RUN)
        .agg(F.count(F.lit(1)).alias("finding_count"), F.count(F.when(c._hit.isNull(), 1)).alias("false_positives"))
    )
    return (
        found.join(reported, RUN, "left").na.fill(0, ["finding_count", "false_positives"])
        .select(
            *RUN, "finding_count", "true_positives", "false_positives", "missed_issues",
            ratio(c.true_positives, c.finding_count).alias("precision"),
            ratio(c.true_positives, c.issues).alias("recall"),
            ratio(c._tool_hit, c._tool).alias("tool_recall"),
            ratio(c._other_hit, c._other).alias("other_recall"),
            (ratio(c._weight_hit, c._weight) * 10).alias("actionability"),
        )
    )


def root_cause_hits(causes: DataFrame, matches: DataFrame, reported: DataFrame | None = None) -> DataFrame:
    """Share of causes ``(fixture, id, title, symptoms)`` that each run surfaces.

    A cause is hit when the run reports one with a similar title, or when at least two of
    its symptoms (truth ids) were matched.
    """
    runs = matches.select(*RUN).distinct()
    wanted = causes.join(runs, "fixture").select(*RUN, F.col("id").alias("cause"), "title", "symptoms")
    seen = matches.where(c.matched).select(*RUN, F.col("truth_id").alias("symptom")).distinct()
    by_symptom = (
        wanted.select(*RUN, "cause", F.explode("symptoms").alias("symptom"))
        .join(seen, [*RUN, "symptom"], "left_semi")
        .groupBy(*RUN, "cause").agg(F.count(F.lit(1)).alias("n"))
        .where(c.n >= MIN_SYMPTOMS).select(*RUN, "cause")
    )
    hits = by_symptom
    if reported is not None:
        alike = similar_titles(wanted, reported, RUN).select(*RUN, F.col("title_l").alias("title"))
        hits = hits.unionByName(wanted.join(alike, [*RUN, "title"], "left_semi").select(*RUN, "cause"))
    counts = hits.distinct().groupBy(*RUN).agg(F.count(F.lit(1)).alias("hits"))
    totals = wanted.groupBy(*RUN).agg(F.count(F.lit(1)).alias("causes"))
    return (
        runs.join(totals, RUN, "left").join(counts, RUN, "left").na.fill(0, ["causes", "hits"])
        .select(*RUN, "causes", "hits", ratio(c.hits, c.causes, 1.0).alias("root_cause_hit_rate"))
    )


# -- duplicates ------------------------------------------------------------------------------------

_PAIRS = "decimal(38,0)"


def _pairs_within(n: Column) -> Column:
    n = n.cast("decimal(18,0)")
    return F.floor(n * (n - 1) / 2).cast(_PAIRS)


def _near_pairs(single: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rows with equal ``keys`` and lines at most three apart, from line counts."""
    counts = single.where(c.line.isNotNull()).groupBy(*RUN, *keys, "line").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select(
        *RUN, *keys, F.col("n").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(DUPLICATE_REACH))).alias("gap"), (c.line + c.gap).alias("line")
    )
    product = (c.n.cast("decimal(18,0)") * c.m.cast("decimal(18,0)")).cast(_PAIRS)
    return (
        counts.join(ahead, [*RUN, *keys, "line"])
        .groupBy(*RUN).agg(F.sum(F.when(c.gap == 0, _pairs_within(c.n)).otherwise(product)).alias("pairs"))
    )


def duplicate_pairs(predictions: DataFrame) -> DataFrame:
    """Number of duplicate pairs per run, without ever forming a pair.

    Two findings are duplicates if they name the same file with lines at most three
    apart, or with the same rule. Findings with one place are counted from group sizes:
    same rule plus near lines minus both. Findings with several places could meet a
    partner more than once; each of them unites the sets of its partners as bitmaps.
    """
    f = predictions.select(*RUN, "ord", "rule", "evidence").withColumn("several", F.size("evidence") > 1)
    ev = f.select(*RUN, "ord", "rule", "several", F.explode("evidence").alias("e")).select(
        *RUN, "ord", "rule", "several", normalize_path(F.col("e.file")).alias("file"), F.col("e.line").alias("line")
    )
    single = ev.where(~c.several)
    same_rule = (
        single.groupBy(*RUN, "file", "rule").agg(F.count(F.lit(1)).alias("n")).groupBy(*RUN).agg(F.sum(_pairs_within(c.n)).alias("pairs"))
    )
    near = _near_pairs(single, ["file"])
    both = _near_pairs(single, ["file", "rule"])

    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*RUN, (c.pairs * F.lit(sign)).cast(_PAIRS).alias("pairs"))

    def tokens(lines: Column) -> Column:
        by_rule = F.array(key_text(F.lit("rule"), c.file, c.rule))
        by_line = F.when(
            c.line.isNotNull(), F.transform(lines, lambda l: key_text(F.lit("line"), c.file, l))
        ).otherwise(F.slice(by_rule, 1, 0))
        return F.concat(by_rule, by_line)

    around = F.sequence(c.line - DUPLICATE_REACH, c.line + DUPLICATE_REACH)
    probes = ev.where(c.several).select(*RUN, "ord", F.explode(tokens(around)).alias("token")).distinct()
    postings = (
        ev.select(*RUN, F.col("ord").alias("o"), "several", F.explode(tokens(F.array(c.line))).alias("token"))
        .join(probes.select(*RUN, "token").distinct(), [*RUN, "token"], "left_semi")
        .groupBy(*RUN, "token", "several", F.bitmap_bucket_number("o").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("o")).alias("bits"))
    )
    partners = (
        probes.join(postings, [*RUN, "token"])
        .groupBy(*RUN, "ord", "several", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
        .groupBy(*RUN).agg(
            F.sum(F.when(~c.several, c.n).otherwise(0)).alias("outside"), F.sum(F.when(c.several, c.n).otherwise(0)).alias("inside")
        )
    )
    # A finding is its own partner; pairs among findings with several places are seen twice.
    own = probes.groupBy(*RUN).agg(F.count_distinct("ord").alias("own"))
    united = partners.join(own, RUN).select(
        *RUN, (c.outside + F.floor((c.inside - c.own) / 2)).cast(_PAIRS).alias("pairs")
    )
    parts = signed(same_rule, 1).unionByName(signed(near, 1)).unionByName(signed(both, -1)).unionByName(united)
    sizes = f.groupBy(*RUN).agg(F.count(F.lit(1)).alias("findings"))
    return sizes.join(parts.groupBy(*RUN).agg(F.sum("pairs").alias("pairs")), RUN, "left").select(
        *RUN, "findings", F.coalesce("pairs", F.lit(0)).cast("bigint").alias("duplicate_pairs")
    )


def dedup_effectiveness(predictions: DataFrame) -> DataFrame:
    """One minus the share of duplicate pairs; 1 for runs with at most one finding."""
    n = c.findings.cast("double")
    share = c.duplicate_pairs / (n * (n - 1) / 2)
    return duplicate_pairs(predictions).select(
        *RUN, "findings", "duplicate_pairs",
        F.when(c.findings <= 1, F.lit(1.0)).otherwise(1 - share).alias("dedup_effectiveness"),
    )


# -- combination -------------------------------------------------------------------------------------


def diagnostic_value(tokens: Column, precision: Column, recall: Column, actionability: Column, dedup: Column) -> Column:
    """Value per token; null when the tokens of a run are unknown."""
    cost = (tokens / 10000) * F.greatest(1 - dedup, F.lit(0.01))
    return F.when(tokens > 0, precision * recall * actionability / cost)


def run_metrics(
    truth: DataFrame, predictions: DataFrame, causes: DataFrame, reported: DataFrame | None = None, costs: DataFrame | None = None
) -> DataFrame:
    """All metrics of each run; ``costs(fixture, tier, run, token_count, latency_ms)`` is optional."""
    matches = cut_lineage(match_findings(truth, predictions))
    joined = (
        match_metrics(matches, predictions)
        .join(root_cause_hits(causes, matches, reported).drop("causes", "hits"), RUN)
        .join(dedup_effectiveness(predictions).drop("findings", "duplicate_pairs"), RUN, "left")
        .na.fill(1.0, ["dedup_effectiveness"])
    )
    if costs is None:
        joined = joined.withColumn("token_count", F.lit(None).cast("bigint")).withColumn("latency_ms", F.lit(None).cast("bigint"))
    else:
        joined = joined.join(costs.select(*RUN, "token_count", "latency_ms"), RUN, "left")
    valued = joined.withColumn(
        "diagnostic_value",
        diagnostic_value(c.token_count, c.precision, c.recall, c.actionability, c.dedup_effectiveness),
    )
    return rounded(valued, *SHARES, "other_recall", "diagnostic_value")


def aggregate_runs(metrics: DataFrame) -> DataFrame:
    """Mean and sample deviation per tier and fixture; costs only if every run has them."""
    aggs = [F.count(F.lit(1)).alias("runs")]
    for n in SHARES:
        aggs.append(js_round(F.avg(n), DIGITS).alias(f"{n}_mean"))
        aggs.append(js_round(F.coalesce(F.stddev_samp(n), F.lit(0.0)), DIGITS).alias(f"{n}_stddev"))

    def complete(col: str, value: Column) -> Column:
        return F.when(F.bool_and(F.col(col).isNotNull()), value)

    aggs += [
        complete("diagnostic_value", js_round(F.avg("diagnostic_value"), DIGITS)).alias("diagnostic_value_mean"),
        complete("diagnostic_value", js_round(F.coalesce(F.stddev_samp("diagnostic_value"), F.lit(0.0)), DIGITS)).alias(
            "diagnostic_value_stddev"
        ),
        F.avg("finding_count").alias("mean_finding_count"),
        complete("token_count", F.avg("token_count")).alias("mean_token_count"),
        complete("latency_ms", F.avg("latency_ms")).alias("mean_latency_ms"),
    ]
    return metrics.groupBy("tier", "fixture").agg(*aggs)


def decision_gates(aggregated: DataFrame) -> DataFrame:
    """Whether each tier and fixture passes the configured thresholds."""
    variance = F.greatest(c.precision_stddev, c.recall_stddev)
    return aggregated.select(
        "tier",
        "fixture",
        (c.precision_mean >= GATES["precision"]).alias("precision_ok"),
        (c.recall_mean >= GATES["recall"]).alias("recall_ok"),
        (variance <= GATES["variance"]).alias("variance_ok"),
        (c.actionability_mean >= GATES["actionability"]).alias("actionability_ok"),
    )


def missed_issues(matches: DataFrame) -> DataFrame:
    """Unmatched truth rows with the root cause they belong to."""
    return matches.where(~c.matched).select(
        *RUN, F.coalesce("root_cause", F.lit(NO_ROOT_CAUSE)).alias("root_cause"), F.col("truth_id"), "severity", "title",
        "tool_detectable",
    )


def missed_by_cause(matches: DataFrame) -> DataFrame:
    return missed_issues(matches).groupBy(*RUN, "root_cause").agg(
        F.count(F.lit(1)).alias("missed"), F.count(F.when(c.tool_detectable, 1)).alias("tool_detectable")
    )
