"""Graph operators over edges (src, dst, kind, ...): closures, degrees, sites, components, orders, hubs and orphans.

Iterations are level-synchronous; each level is a distinct join whose result is written once, to a folder of its own, by
one job that also gives its size. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.columns import display_priority, file_of, is_entry_point, package_of, risk, risk_score
from ..plans.store import measured, stored


@dataclass
class Limits:
    """Budgets of a walk; None is unlimited. A level is admitted whole or not at all, in which case it is cut by name."""

    depth: int | None = None
    nodes: int | None = None
    edges: int | None = None
    name_bytes: int | None = None


@dataclass
class Walk:
    nodes: DataFrame  # (node, depth), the starts at depth 0
    truncated: bool
    reason: str | None
    visited_nodes: int


def adjacency(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """(src, dst) distinct, turned round for reverse."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct() if reverse else edges.select("src", "dst").distinct()


def walk(adj: DataFrame, starts: DataFrame, limits: Limits | None = None) -> Walk:
    """Breadth-first closure of starts (node) with least depths. adj is read once a level: pass a stored table.

    The levels seen are immutable folders; a level is what one more step reaches and none of them holds."""
    limits = limits or Limits()
    bytes_of = F.coalesce(F.sum(F.octet_length("node")), F.lit(0)).alias("bytes")
    count = F.count(F.lit(1)).alias("n")
    first, size = measured(starts.select("node").distinct().withColumn("depth", F.lit(0)), count)
    levels, depth, total, reason, spent, named = [first], 0, size["n"], None, 0, 0
    while total:
        step = adj.join(levels[-1].select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node"))
        tried = Observation() if limits.edges is not None else None
        if tried is not None:
            step = step.observe(tried, count)
        seen = reduce(DataFrame.union, levels).select("node")
        fresh, size = measured(step.distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth + 1)), count, bytes_of)
        if tried is not None:
            spent += tried.get["n"]
            if spent >= limits.edges:
                reason = "edges"
                break
        if not size["n"]:
            break
        if limits.depth is not None and depth >= limits.depth:
            reason = "depth"
            break
        depth += 1
        n = size["n"]
        if limits.nodes is not None and total + n > limits.nodes:
            n, reason = max(0, limits.nodes - total), "nodes"
            fresh = stored(fresh.orderBy("node").limit(n))
        named += size["bytes"]
        if limits.name_bytes is not None and named > limits.name_bytes:
            reason = "bytes"
            break
        levels.append(fresh)
        total += n
        if reason:
            break
    return Walk(reduce(DataFrame.union, levels), reason is not None, reason, total)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree): distinct neighbours."""
    adj = edges.select("src", "dst").distinct()
    ends = adj.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(adj.select("src", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("i").cast("long").alias("in_degree"), F.sum("o").cast("long").alias("out_degree"))


def impact(edges: DataFrame, starts: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(symbol, depth, in_degree, risk, score) of everything that depends on the starts."""
    return impact_within(edges, starts, limits)[0]


def impact_within(edges: DataFrame, starts: DataFrame, limits: Limits | None = None) -> tuple[DataFrame, Walk]:
    """``impact`` and its walk, which tells whether a limit cut it."""
    adj = stored(adjacency(edges, reverse=True))
    found = walk(adj, starts, limits)
    into = adj.groupBy("src").agg(F.count("*").alias("in_degree"))
    reached = found.nodes.filter("depth > 0")
    joined = reached.join(into, reached.node == into.src, "left").select(F.col("node").alias("symbol"), "depth", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"))
    return joined.withColumns({"risk": risk(F.col("depth"), F.col("in_degree")), "score": risk_score(F.col("depth"), F.col("in_degree"))}), found


def diff_impact(edges: DataFrame, changed: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Per symbol the worst risk over all changed nodes (node) that the graph has; depth and score go with it, of the least
    such origin.

    One walk serves all origins. A node's risk falls with depth only from 1 to 2 and from 3 to 4, so it needs the least
    origins within 1, 3 and any number of steps. Each step hands on a node's two least origins (two, as a node's own name
    doesn't count for itself), which it got first by the shortest way."""
    limits = limits or Limits()
    adj = stored(adjacency(edges, reverse=True))
    known = adj.select(F.col("src").alias("node")).union(adj.select("dst")).distinct()
    state = stored(changed.select("node").distinct().join(known, "node", "left_semi").select("node", F.col("node").alias("origin"), F.lit(0).alias("depth")))
    within, level, depth = {}, state, 0
    least = F.row_number().over(Window.partitionBy("node").orderBy("origin"))
    count = F.count(F.lit(1)).alias("n")
    while limits.depth is None or depth < limits.depth:
        depth += 1
        step = level.join(adj.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node"), "origin").distinct().withColumn("depth", F.lit(depth))
        both = state.union(step).groupBy("node", "origin").agg(F.min("depth").alias("depth"))
        state, size = measured(both.withColumn("_at", least).filter("_at <= 2").drop("_at"), F.count_if(F.col("depth") == depth).alias("n"), count.alias("all"))
        if not size["n"]:
            break
        level = state.filter(F.col("depth") == depth)
        if depth in (1, 3):
            within[depth] = state
    foreign = lambda df, name: df.filter("origin <> node").groupBy("node").agg(F.min(F.struct("origin", "depth")).alias(name))
    rows = foreign(state, "_any")
    for steps, name in ((1, "_near"), (3, "_mid")):
        rows = rows.join(foreign(within.get(steps, state), name), "node", "left")
    into = adj.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("in_degree"))
    rows = rows.join(into, "node", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)).cast("long"))
    near = lambda c, most: F.when(F.col(f"{c}.depth") <= most, F.col(f"{c}.depth"))
    chosen = F.when(F.col("in_degree") > 10, F.col("_any.depth")).otherwise(F.coalesce(near("_near", 1), F.when(F.col("in_degree") < 2, near("_mid", 3)), F.col("_any.depth")))
    rows = rows.withColumn("depth", chosen)
    return rows.select(F.col("node").alias("symbol"), "depth", "in_degree", risk(F.col("depth"), F.col("in_degree")).alias("risk"), risk_score(F.col("depth"), F.col("in_degree")).alias("score"))


def site_order() -> list[Column]:
    return [display_priority(F.col("kind")).asc(), F.col("source_path").asc_nulls_first(), F.col("line").asc_nulls_first(), F.col("src").asc(), F.col("dst").asc()]


def sites(edges: DataFrame, node: str, reverse: bool = True, after: int = 0, limit: int = 50) -> DataFrame:
    """The relations at a node in display order from position after + 1, limit of them: position and total come with each.

    Only the first after + limit are ordered; the rest is counted where it is."""
    found = edges.filter(F.col("dst" if reverse else "src") == node)
    first = found.orderBy(*site_order()).limit(after + limit).withColumn("position", F.row_number().over(Window.orderBy(*site_order())))
    return first.filter(F.col("position") > after).crossJoin(found.agg(F.count("*").alias("total")))


ROLLUP_DEPTH, MOST_ROLLUP_DEPTH = 3, 10


def rollup_depth(mode: str) -> int:
    """The depth that a rollup's mode asks for: ``dir`` or ``directory``, or either with ``:N`` of 1 to 10."""
    name, colon, depth = mode.partition(":")
    if name not in ("dir", "directory") or colon and not (depth.isascii() and depth.isdigit() and 1 <= int(depth) <= MOST_ROLLUP_DEPTH):
        raise ValueError(f"no such rollup: {mode}")
    return int(depth) if colon else ROLLUP_DEPTH


def reference_sites(edges: DataFrame, symbols: DataFrame, node: str, reverse: bool = True, after: int = 0, limit: int = 50) -> DataFrame:
    """A page of ``sites`` with the qualified name of the other end (its node where no symbol has it), the number of sites
    of the row's kind, and the position to go on from (null at the end)."""
    page = sites(edges, node, reverse, after, limit)
    other = F.col("src" if reverse else "dst")
    kinds = edges.filter(F.col("dst" if reverse else "src") == node).groupBy("kind").agg(F.count("*").alias("of_kind"))
    names = symbols.groupBy("id").agg(F.min("qualified").alias("qualified"))
    out = page.join(kinds, "kind").join(names, other == F.col("id"), "left")
    more = F.when(F.col("total") > after + limit, F.lit(after + limit))
    return out.select("position", other.alias("node"), F.coalesce("qualified", other).alias("name"), "kind", "source_path", "line", "of_kind", "total", more.cast("int").alias("next_after"))


def rollup_sites(found: DataFrame, group: Column, file: Column, top: int = 12) -> DataFrame:
    """Sites and distinct files per group, the top groups and ``(other)`` with the number of groups in it."""
    grouped = found.select(group.alias("prefix"), file.alias("file")).groupBy("prefix").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))
    grouped = stored(grouped)
    first = grouped.orderBy(F.col("n").desc(), "prefix").limit(top)
    rest = grouped.join(first.select(F.col("prefix").alias("_p")), F.col("prefix").eqNullSafe(F.col("_p")), "left_anti")
    other = rest.agg(F.sum("n").alias("n"), F.sum("files").alias("files"), F.count("*").alias("groups")).filter("groups > 0")
    return first.select("prefix", "n", "files", F.lit(1).cast("long").alias("groups")).unionByName(other.select(F.lit("(other)").alias("prefix"), "n", "files", "groups"))


def collapse(edges: DataFrame, name, keep_loops: bool = True) -> DataFrame:
    """Distinct edges between the names of nodes (packages or files)."""
    out = edges.select(name(F.col("src")).alias("src"), name(F.col("dst")).alias("dst")).distinct()
    return out if keep_loops else out.filter("src <> dst")


def package_graph(edges: DataFrame) -> DataFrame:
    return collapse(edges, package_of)


def file_graph(edges: DataFrame) -> DataFrame:
    return collapse(edges, file_of, keep_loops=False)


def strong_components(adj: DataFrame) -> DataFrame:
    """(node, component) of nodes in cycles of two or more; component is the least member.

    Nodes without a predecessor or successor go first. Then the least name that reaches each node is spread forward;
    within a name's region, what reaches that name backward is its component. Found components leave; regions repeat."""
    count = F.count(F.lit(1)).alias("n")
    adj, size = measured(adj.filter("src <> dst").distinct(), count)
    found: DataFrame | None = None
    while True:
        while True:  # trim
            n = size["n"]
            heads, tails = adj.select(F.col("dst").alias("n")).distinct(), adj.select(F.col("src").alias("n")).distinct()
            live = heads.join(tails, "n", "left_semi")
            adj, size = measured(adj.join(live.withColumnRenamed("n", "src"), "src", "left_semi").join(live.withColumnRenamed("n", "dst"), "dst", "left_semi"), count)
            if size["n"] == n:
                break
        if not n:
            break
        colour = stored(adj.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:  # the least name upstream
            into = adj.join(colour, adj.src == colour.node).groupBy("dst").agg(F.min("colour").alias("c"))
            after = stored(colour.join(into, colour.node == into.dst, "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("colour"), F.col("colour").alias("was")))
            changed = not after.filter("colour <> was").isEmpty()
            colour = after.drop("was")
            if not changed:
                break
        own = colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd"))
        inside = stored(adj.join(own[0], "src").join(own[1], "dst").filter("cs = cd").select("src", "dst"))
        roots = colour.filter("node = colour").select("node")
        reached = walk(stored(adjacency(inside, reverse=True)), roots).nodes.select("node").join(colour, "node")
        found = stored(reached if found is None else found.unionByName(reached))
        adj, size = measured(adj.join(reached.select(F.col("node").alias("src")), "src", "left_anti").join(reached.select(F.col("node").alias("dst")), "dst", "left_anti"), count)
    if found is None:
        return adj.select(F.col("src").alias("node"), F.col("src").alias("component"))
    # A region's least name may be upstream of the cycle only if it is itself on it, or it would have been trimmed or left.
    size = Window.partitionBy("colour")
    return found.withColumn("_n", F.count("*").over(size)).filter("_n > 1").select("node", F.min("node").over(size).alias("component"))


def topological_layers(adj: DataFrame) -> DataFrame | None:
    """(node, layer) by longest path from the sources; None if there is a cycle or a self-loop."""
    count = F.count(F.lit(1)).alias("n")
    adj = stored(adj.distinct())
    left, size = measured(adj.select(F.col("src").alias("node")).union(adj.select("dst")).distinct(), count)
    layers: list[DataFrame] = []
    while size["n"]:
        ready, found = measured(left.join(adj.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"), count)
        if not found["n"]:
            return None
        layers.append(ready.withColumn("layer", F.lit(len(layers))))
        left, size = measured(left.join(ready, "node", "left_anti"), count)
        adj = stored(adj.join(ready.withColumnRenamed("node", "src"), "src", "left_anti"))
    return reduce(DataFrame.union, layers) if layers else None


def hubs(edges: DataFrame, top: int = 20) -> DataFrame:
    """The nodes with most distinct predecessors, ties by name."""
    return degrees(edges).filter("in_degree > 0").orderBy(F.col("in_degree").desc(), "node").limit(max(1, top))


def orphans(edges: DataFrame, symbols: DataFrame, manifest: list[str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """Names of nodes that nothing refers to though they refer to others, and of symbols outside the graph; entry points don't count."""
    degree = degrees(edges)
    named = degree.filter("in_degree = 0 and out_degree > 0").join(symbols.select("id", "name", "path"), F.col("node") == F.col("id"), "left")
    first = named.select(F.coalesce("name", "node").alias("name"), F.coalesce("path", "node").alias("path"))
    second = symbols.join(degree.select(F.col("node").alias("id")), "id", "left_anti").select("name", "path")
    both = first.unionByName(second).filter(~is_entry_point(F.col("name"), F.col("path")))
    for path in manifest or []:
        both = both.filter((F.col("path") != path) & (F.element_at(F.split("path", "/"), -1) != path.split("/")[-1]))
    for marker in extra or []:
        both = both.filter(~F.col("path").contains(marker))
    return both.select("name").distinct()


def export_dot(adj: DataFrame) -> DataFrame:
    """One row: the package graph as DOT text; nodes in topological order (none in a cyclic graph), edges sorted.

    The text is one value, as asked for: packages are few."""
    order = topological_layers(adj)
    lines = adj.select(F.lit(2).alias("part"), F.lit(0).alias("layer"), F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('";')).alias("line")).distinct()
    if order is not None:
        lines = lines.unionByName(order.select(F.lit(1).alias("part"), "layer", F.concat(F.lit('  "'), "node", F.lit('" [style=rounded];')).alias("line")))
    head = "digraph packages {\n  rankdir=LR;\n  node [shape=box, style=rounded];\n"
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "layer", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return lines.agg(F.concat(F.lit(head), text, F.lit("}")).alias("dot"))
