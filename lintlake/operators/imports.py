"""Imports, layers, import edges and import cycles."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.scalars import extname, java_package_path, resolve_relative
from lintlake.functions.text import found
from lintlake.operators.detect import SOURCE_EXTS, c, emit, finding, one, place, scope, text
from lintlake.policy import DEFAULT_POLICY, Policy
from lintlake.session import cut_lineage

# --- Fixed values: import and layer patterns ---------------------------------------
QUOTED_IMPORT = r"(?:import|from)\s+['\"]([^'\"]+)['\"]"
PACKAGE_IMPORT = r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?;"
PACKAGE_NAME = r"(?i)^[a-z][\w]*(\.[a-z][\w]*)+(\.[A-Z][\w]*)?$"
LAYERS = {
    "presentation": r"(?i)/(controller|resource|handler|view|component|page)s?/",
    "application": r"(?i)/(service|usecase|facade|orchestrator)s?/",
    "domain": r"(?i)/(models?|entit(?:y|ies)|domain|aggregates?|value-?objects?)/",
    "infrastructure": r"(?i)/(repositor(?:y|ies)|adapters?|gateways?|clients?|config|persistence)/",
}
FORBIDDEN = {
    "domain": ["presentation", "application", "infrastructure"],
    "infrastructure": ["presentation", "application"],
}
SCRIPT_EXTS = [".ts", ".js"]
RESOLVE_SUFFIXES = [".ts", ".js", "/index.ts"]
CYCLE_EVIDENCE = 3
# --------------------------------------------------------------------------------------

#: Imports of a repository, or of a component, that are walked at once in one task.
BLOCK_EDGES = 200_000
MEMBERS = "repo string, scc string, node string"


def import_specifiers(content: Column) -> Column:
    """Module specifiers in text order: quoted ones, then package imports."""
    return F.concat(found(content, QUOTED_IMPORT, 1), found(content, PACKAGE_IMPORT, 1))


def imports(files: DataFrame) -> DataFrame:
    """One row per import ``(repo, path, ext, pos, spec)``."""
    return scope(files, SOURCE_EXTS).select(
        "repo", "path", "ext", F.posexplode(import_specifiers(c.content)).alias("pos", "spec")
    )


# -- layers -----------------------------------------------------------------------------


def layer_patterns(names=()) -> dict[str, str]:
    """Built-in layers; a profile's layer name matches a folder of that name."""
    own = {}
    for n in names:
        escaped = "".join(f"\\{ch}" if ch in ".*+?^${}()|[]\\" else ch for ch in n)
        own[n] = f"(?i)/{escaped}s?/"
    return {**LAYERS, **own}


def detect_layer(path: Column, names=()) -> Column:
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.coalesce(*[F.when(path.rlike(p), F.lit(n)) for n, p in layer_patterns(names).items()])


def is_violation(source: Column, target: Column, allowed: dict | None = None) -> Column:
    """Whether ``source`` must not depend on ``target``; with a list, what it omits is forbidden."""
    if allowed is None:
        bad = F.lit(False)
        for layer, forbidden in FORBIDDEN.items():
            bad = bad | ((source == layer) & target.isin(forbidden))
        return bad
    fine = F.lit(False)
    for layer, targets in allowed.items():
        if targets:
            fine = fine | ((source == layer) & target.isin(list(targets)))
    return (source != target) & ~fine


def layer_violations(files: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Imports that cross layers the wrong way: a projection, since layers follow from paths."""
    spec = F.when(c.ext == ".java", java_package_path(c.spec)).otherwise(c.spec)
    layered = (
        scope(files, SOURCE_EXTS)
        .withColumn("source", detect_layer(F.concat(F.lit("/"), c.path), policy.layers))
        .where(c.source.isNotNull())
        .select("repo", "path", "ext", "source", F.explode(import_specifiers(c.content)).alias("spec"))
        .withColumn("spec", spec)
        .withColumn("target", detect_layer(c.spec, policy.layers))
    )
    return emit(
        layered.where(c.target.isNotNull() & is_violation(c.source, c.target, policy.allowed_dependencies)),
        finding(
            "no-layer-violation", "high", text("Layer violation: ", c.source, " → ", c.target),
            one(c.path, None, F.concat(F.lit("import ... from '"), c.spec, F.lit("'"))),
        ),
    )


# -- edges --------------------------------------------------------------------------------


def import_edges(files: DataFrame) -> DataFrame:
    """Resolved imports ``(repo, src, dst)`` between the files of a repository."""
    paths = scope(files, SOURCE_EXTS).select("repo", "path").distinct()
    specs = imports(files)

    relative = specs.where(c.ext.isin(SCRIPT_EXTS) & F.startswith("spec", F.lit(".")))
    base = resolve_relative(c.path, c.spec)
    candidates = F.when(extname(c.spec) != "", F.array(c.base)).otherwise(
        F.array(*[F.concat(c.base, F.lit(s)) for s in RESOLVE_SUFFIXES])
    )
    tried = (
        relative.select("repo", c.path.alias("src"), base.alias("base"), "spec")
        .distinct()
        .select("repo", "src", "spec", F.posexplode(candidates).alias("priority", "path"))
    )
    script_edges = (
        tried.join(paths, ["repo", "path"])
        .groupBy("repo", "src", "spec")
        .agg(F.min_by("path", "priority").alias("dst"))
        .select("repo", "src", "dst")
    )

    # A package import names the end of a path. Its first part may be the end of a folder
    # name, so the join key is what follows that part, and the rest is compared after.
    packages = (
        specs.where((c.ext == ".java") & c.spec.rlike(PACKAGE_NAME))
        .select("repo", c.path.alias("src"), F.concat(F.replace("spec", F.lit("."), F.lit("/")), F.lit(".java")).alias("suffix"))
        .distinct()
    )
    wanted = packages.select("repo", "suffix").distinct().withColumn("tail", F.regexp_replace("suffix", "^[^/]*/", ""))
    segments = F.split(c.path, "/")
    tails = paths.select(
        "repo",
        "path",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(segments)),
                lambda i: F.array_join(F.slice(segments, i, F.size(segments)), "/"),
            )
        ).alias("tail"),
    )
    resolved = (
        wanted.join(tails, ["repo", "tail"])
        .where(F.endswith("path", F.col("suffix")))
        .groupBy("repo", "suffix")
        .agg(F.min("path").alias("dst"))
    )
    package_edges = packages.join(resolved, ["repo", "suffix"]).select("repo", "src", "dst")
    return script_edges.unionByName(package_edges).distinct()


# -- cycles -----------------------------------------------------------------------------------


def _members(table: pa.Table) -> pa.Table:
    """Strong components of one small repository: two walks, forward for the order, backward for the members."""
    repo = table.column("repo")[0].as_py()
    ahead, back = defaultdict(list), defaultdict(list)
    for a, b in zip(table.column("src").to_pylist(), table.column("dst").to_pylist(), strict=True):
        ahead[a].append(b)
        back[b].append(a)
    order, seen = [], set()
    for start in list(ahead):
        if start in seen:
            continue
        seen.add(start)
        walk = [(start, iter(ahead[start]))]
        while walk:
            node, rest = walk[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                order.append(node)
                walk.pop()
            else:
                seen.add(step)
                walk.append((step, iter(ahead.get(step, ()))))
    out, placed = [], set()
    for start in reversed(order):
        if start in placed:
            continue
        group, todo = [], [start]
        placed.add(start)
        while todo:
            node = todo.pop()
            group.append(node)
            fresh = [x for x in back.get(node, ()) if x not in placed]
            placed.update(fresh)
            todo += fresh
        if len(group) > 1 or start in ahead.get(start, ()):
            out += [(repo, min(group), node) for node in group]
    return pa.table({k: pa.array([r[i] for r in out], pa.string()) for i, k in enumerate(("repo", "scc", "node"))})


def _first_cycle(table: pa.Table) -> pa.Table:
    """A shortest cycle of one small component through its first member, breadth first; the least one of several."""
    repo, root = table.column("repo")[0].as_py(), table.column("scc")[0].as_py()
    ahead = defaultdict(list)
    for a, b in sorted(zip(table.column("src").to_pylist(), table.column("dst").to_pylist(), strict=True)):
        ahead[a].append(b)
    parent, layer = {}, [root]
    while root not in parent:
        following = []
        for node in layer:
            for x in ahead[node]:
                if x not in parent:
                    parent[x] = node
                    following.append(x)
        layer = following
    trail = [parent[root]]
    while trail[-1] != root:
        trail.append(parent[trail[-1]])
    trail.reverse()
    return pa.table({
        "repo": pa.array([repo]), "scc": pa.array([root]),
        "cycle": pa.array([trail[:CYCLE_EVIDENCE]], pa.list_(pa.string())), "length": pa.array([len(trail)], pa.int64()),
    })


def _routed(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows of groups up to ``limit`` rows, and of larger ones."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    return tuple(df.join(sizes.where(cond), keys, "left_semi") for cond in (c._size <= limit, c._size > limit))


def _rake(edges: DataFrame) -> DataFrame:
    """Edges without those from nodes that nothing enters and to nodes that nothing leaves."""
    entered = edges.select("repo", F.col("dst").alias("src")).distinct()
    left = edges.select("repo", F.col("src").alias("dst")).distinct()
    return edges.join(entered, ["repo", "src"], "left_semi").join(left, ["repo", "dst"], "left_semi")


def _paths(edges: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """For every node with one way in and one way out: where its path ends, found by pointers that double.

    ``(repo, node, to, last, least, length, head, open)``: ``to`` is the first node behind it with other ways, ``last``
    the node before that one, ``head`` the first two nodes behind ``node``. On a ring of such nodes pointers stay
    ``open`` and ``least`` is its least node. ``pinned`` nodes ``(repo, node)`` end a path whatever their ways are.
    """
    out = edges.groupBy("repo", F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias("n"), F.min("dst").alias("to"), F.min("length").alias("length"), F.min("head").alias("head")
    )
    into = edges.groupBy("repo", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("m"))
    single = out.where((c.n == 1) & (c.to != c.node)).join(into.where(c.m == 1), ["repo", "node"])
    if pinned is not None:
        single = single.join(pinned, ["repo", "node"], "left_anti")
    now = single.select("repo", "node", "to", F.col("node").alias("last"), F.col("node").alias("least"), "length", "head")
    now = cut_lineage(now.withColumn("open", F.lit(True)))
    state = None
    while True:
        then = now.select("repo", F.col("node").alias("to"), *[F.col(k).alias(f"_{k}") for k in ("to", "last", "least", "length", "head", "open")])
        now = cut_lineage(
            now.join(then, ["repo", "to"], "left").select(
                "repo", "node", F.coalesce("_to", "to").alias("to"), F.coalesce("_last", "last").alias("last"), F.least("least", "_least").alias("least"),
                (c.length + F.coalesce("_length", F.lit(0))).alias("length"),
                F.when(c._head.isNull(), c.head).otherwise(F.slice(F.concat("head", "_head"), 1, CYCLE_EVIDENCE - 1)).alias("head"),
                F.coalesce("_open", F.lit(False)).alias("open"),
            )
        )
        # a ring is done when its least node is known all around: one more doubling changes nothing
        before, state = state, tuple(now.where("open").agg(F.count(F.lit(1)), F.sum(F.xxhash64("repo", "least").cast("decimal(38,0)"))).first())
        if not state[0] or state == before:
            return now


def _contract(edges: DataFrame, pinned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges with every path as one edge, and the paths: ``(repo, node, a, b, ring)``, ``ring`` the least node of a closed one."""
    paths = _paths(edges, pinned)
    inner = paths.select("repo", "node")
    plain = edges.join(inner.withColumnRenamed("node", "src"), ["repo", "src"], "left_anti")
    direct = plain.join(inner.withColumnRenamed("node", "dst"), ["repo", "dst"], "left_anti").select(*edges.columns)
    behind = paths.where("not open").select("repo", F.col("node").alias("dst"), "to", "last", F.col("length").alias("_length"), F.col("head").alias("_head"))
    entering = plain.join(behind, ["repo", "dst"]).select(
        "repo", "src", F.col("to").alias("dst"), (c.length + c._length).alias("length"),
        F.slice(F.concat("head", "_head"), 1, CYCLE_EVIDENCE - 1).alias("head"), "last",
    )
    merged = direct.unionByName(entering.drop("last")).groupBy("repo", "src", "dst").agg(F.min(F.struct("length", "head")).alias("way"))
    spans = entering.select("repo", "last", F.col("src").alias("a"), F.col("dst").alias("b"))
    placed = paths.join(spans, ["repo", "last"], "left").select("repo", "node", "a", "b", F.when(c.open, c.least).alias("ring"))
    return cut_lineage(merged.select("repo", "src", "dst", "way.length", "way.head")), cut_lineage(placed)


def _weighted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("length", F.lit(1).cast("long")).withColumn("head", F.array("dst"))


def _spread(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Push the least label along edges until nothing changes."""
    while True:
        pushed = (
            state.select("repo", F.col("node").alias("src"), F.col("label").alias("_in"))
            .join(edges.select("repo", "src", "dst"), ["repo", "src"])
            .groupBy("repo", F.col("dst").alias("node"))
            .agg(F.min("_in").alias("_in"))
        )
        after = cut_lineage(
            state.join(pushed, ["repo", "node"], "left").select(
                "repo", "node", F.least("label", "_in").alias("label"), (c._in < c.label).alias("_new")
            )
        )
        changed = after.where("_new").limit(1).count()
        state = after.drop("_new")
        if not changed:
            return state


def strong_components(edges: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """Members of all strongly connected components ``(repo, scc, node)`` that contain a cycle; ``scc`` is the least.

    A repository of up to ``block_edges`` imports is walked at once. A larger one is shrunk first: dead ends are raked
    off and paths become single edges, alternately, so trees, chains and rings of any length are gone after a number
    of rounds that grows with their logarithm; what is left goes on in :func:`_core`, and paths whose two ends
    are in one component join it.
    """
    edges = cut_lineage(edges.select("repo", "src", "dst").where(c.src.isNotNull() & c.dst.isNotNull()).distinct())
    small, large = _routed(edges, ["repo"], block_edges)
    found = small.groupBy("repo").applyInArrow(_members, MEMBERS)
    rest = cut_lineage(large)
    if rest.isEmpty():
        return found
    rest, levels = _weighted(rest), []
    while True:
        size = rest.count()
        rest = cut_lineage(_rake(rest).select("repo", "src", "dst", "length", "head"))
        rest, placed = _contract(rest)
        levels.append(placed)
        if rest.count() == size:
            break
    grown = cut_lineage(_core(rest.select("repo", "src", "dst")))
    for placed in reversed(levels):
        ends = [grown.select("repo", F.col("node").alias(x), F.col("scc").alias(f"_{x}")) for x in ("a", "b")]
        between = placed.where("ring is null").join(ends[0], ["repo", "a"]).join(ends[1], ["repo", "b"]).where("_a = _b")
        rings = placed.where("ring is not null").select("repo", F.col("ring").alias("scc"), "node")
        grown = cut_lineage(grown.unionByName(between.select("repo", F.col("_a").alias("scc"), "node")).unionByName(rings))
    least = grown.groupBy("repo", "scc").agg(F.min("node").alias("_least"))
    return found.unionByName(grown.join(least, ["repo", "scc"]).select("repo", F.col("_least").alias("scc"), "node"))


def _core(rest: DataFrame) -> DataFrame:
    """Components of what can't be shrunk.

    Rounds of: spread the least node forward, then walk backward inside each color from the node that gave it its
    name. What is reached from both sides is a component; it leaves the graph and the next round looks at the rest.
    Every step is a join on (repo, node), so neither a repository nor a component has to fit in one task.
    """
    found = cut_lineage(rest.select("repo", F.col("src").alias("scc"), F.col("dst").alias("node")).where(F.lit(False)))
    while not rest.isEmpty():
        nodes = rest.select("repo", F.col("src").alias("node")).unionByName(rest.select("repo", F.col("dst").alias("node"))).distinct()
        colored = _spread(nodes.withColumn("label", c.node), rest)
        inside = (
            rest.join(colored.select("repo", F.col("node").alias("src"), F.col("label").alias("a")), ["repo", "src"])
            .join(colored.select("repo", F.col("node").alias("dst"), F.col("label").alias("b")), ["repo", "dst"])
            .where(c.a == c.b)
        )
        inside = cut_lineage(inside.select("repo", "src", "dst", F.col("a").alias("color")))
        reached = colored.where(c.node == c.label).select("repo", "node", F.col("label").alias("scc"))
        frontier = reached
        while True:
            back = inside.select("repo", F.col("dst").alias("node"), "src", F.col("color").alias("scc"))
            step = frontier.join(back, ["repo", "node", "scc"]).select("repo", F.col("src").alias("node"), "scc").distinct()
            frontier = cut_lineage(step.join(reached, ["repo", "node", "scc"], "left_anti"))
            if frontier.isEmpty():
                break
            reached = cut_lineage(reached.unionByName(frontier))
        sizes = reached.groupBy("repo", "scc").agg(F.count(F.lit(1)).alias("n"))
        loops = rest.where(c.src == c.dst).select("repo", F.col("src").alias("scc")).distinct().withColumn("loop", F.lit(True))
        kept = reached.join(sizes, ["repo", "scc"]).join(loops, ["repo", "scc"], "left").where((c.n > 1) | c.loop)
        found = cut_lineage(found.unionByName(kept.select("repo", "scc", "node")))
        gone = reached.select("repo", F.col("node").alias("src"))
        gone_to = reached.select("repo", F.col("node").alias("dst"))
        rest = cut_lineage(_rake(rest.join(gone, ["repo", "src"], "left_anti").join(gone_to, ["repo", "dst"], "left_anti")).select("repo", "src", "dst"))
    return found


def shortest_cycles(edges: DataFrame, components: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """Length and first members ``(repo, scc, cycle, length)`` of a shortest cycle through the first member of each component.

    A component of up to ``block_edges`` imports is walked at once. In a larger one paths become single edges first;
    then the least distance from the first member spreads along them, with the first nodes of the way there.
    """
    members = cut_lineage(components)
    m_src = members.select("repo", F.col("scc"), F.col("node").alias("src"))
    m_dst = members.select("repo", F.col("scc"), F.col("node").alias("dst"))
    inner = cut_lineage(
        edges.select("repo", "src", "dst").distinct().join(m_src, ["repo", "src"]).join(m_dst, ["repo", "scc", "dst"])
    )
    small, large = _routed(inner, ["repo", "scc"], block_edges)
    found = small.groupBy("repo", "scc").applyInArrow(_first_cycle, "repo string, scc string, cycle array<string>, length long")
    rest = cut_lineage(large)
    if rest.isEmpty():
        return found
    roots = rest.select("repo", "scc").distinct()
    ways, _ = _contract(_weighted(rest.select("repo", "src", "dst")), roots.select("repo", F.col("scc").alias("node")))
    ways = cut_lineage(ways.join(m_src, ["repo", "src"]))
    frontier = roots.select("repo", "scc", F.col("scc").alias("node"), F.lit(0).cast("long").alias("length"), F.array().cast("array<string>").alias("head"))
    known = cut_lineage(frontier.where(F.lit(False)))
    while True:
        step = frontier.select("repo", "scc", F.col("node").alias("src"), F.col("length").alias("_l"), F.col("head").alias("_h")).join(ways, ["repo", "scc", "src"])
        step = step.select(
            "repo", "scc", F.col("dst").alias("node"), (c._l + c.length).alias("length"), F.slice(F.concat("_h", "head"), 1, CYCLE_EVIDENCE - 1).alias("head"), F.lit(True).alias("new")
        )
        ranked = known.withColumn("new", F.lit(False)).unionByName(step).groupBy("repo", "scc", "node").agg(F.min(F.struct("length", "head", "new")).alias("way"))
        state = cut_lineage(ranked.select("repo", "scc", "node", "way.*"))
        known = state.drop("new")
        frontier = state.where("new and node != scc").drop("new")
        if frontier.isEmpty():
            break
    closed = known.where(c.node == c.scc)
    cycle = F.slice(F.concat(F.array("scc"), "head"), F.lit(1), F.least(c.length, F.lit(CYCLE_EVIDENCE)).cast("int"))
    return found.unionByName(closed.select("repo", "scc", cycle.alias("cycle"), "length"))


def circular_dependencies(edges: DataFrame) -> DataFrame:
    """One finding per component with a cycle; the evidence is the start of a shortest cycle."""
    components = cut_lineage(strong_components(edges))
    sizes = components.groupBy("repo", "scc").agg(F.count(F.lit(1)).alias("members"))
    cycles = shortest_cycles(edges, components).join(sizes, ["repo", "scc"])
    return emit(
        cycles,
        finding(
            "no-circular-dependency", "high", text("Import cycle: ", c.scc, " → … → ", c.scc),
            F.transform("cycle", lambda f: place(f)),
        ),
    )


