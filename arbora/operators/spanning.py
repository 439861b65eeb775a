"""Minimum spanning trees: per subgraph, merged in a tree, and of edge tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.points import edge_order
from arbora.operators import kernels
from arbora.operators.blocks import regroup
from arbora.operators.components import chase, one_group
from arbora.operators.curve import (
    FEW_DIMENSIONS,
    FINE_BLOCK,
    box_levels,
    curve_blocks,
    near_pairs,
    packed_labels,
)
from arbora.operators.features import checked_points, with_dense_id
from arbora.operators.tiles import (
    Block,
    block_cap,
    block_count,
    home_runs,
    map_pairs,
    map_squares,
    pack,
    ragged_parts,
    square_side,
    widened,
)
from arbora.runtime import LOCAL_EDGES, MAX_ROUNDS, cut, lookup, parallelism

EDGE = "left long, right long, weight double"


def tree_kernel(subgraph: int, left: Block, right: Block | None) -> dict:
    """Spanning tree of a block, or of all edges between two blocks."""
    pair = None if right is None else (right.ids, right.coords)
    a, b, weight = kernels.spanning_tree((left.ids, left.coords), pair)
    return {"left": a, "right": b, "weight": weight}


def tree_kernels(pairs: list[tuple[Block, Block | None]]) -> dict:
    """:func:`tree_kernel` of all pairs of a square, small ones together."""
    sides = {id(block): (block.ids, block.coords) for pair in pairs for block in pair if block is not None}
    pair, a, b, weight = kernels.spanning_trees([(sides[id(x)], sides.get(id(y))) for x, y in pairs])
    return {"pair": pair, "left": a, "right": b, "weight": weight}


def subgraph_mst(
    blocked: DataFrame, s: int, which: str = "all", block_points: int | None = None, listed: bool = False
) -> DataFrame:
    """``(subgraph, left, right, weight)``: the tree of every subgraph of ``s`` blocks.

    One grouped map over all subgraphs; ``which`` restricts it to those inside blocks
    ("within") or across ("between"). A subgraph needs both of its blocks: across an
    empty one there are no edges. Blocks too big for a task are solved in parts, and only
    the trees of their subgraphs are merged. With ``listed`` a tree is one row
    ``(subgraph, edges)``, made in the task that finds it; this needs :func:`blocks_fit`.
    """
    parts = widened(ragged_parts(blocked, block_points))
    wants = {"all": None, "within": lambda a, b, i, j: a == b, "between": lambda a, b, i, j: a != b}[which]
    reach = home_runs(parts) if which == "within" else None
    if listed and parts.split:
        raise ValueError("trees of blocks that don't fit a task are not listed")
    fold = _forests_of_parts if parts.split else None
    # Listed edges are compared by their weight first.
    schema = ", ".join(reversed(EDGE.rsplit(", ", 1))) if listed else EDGE
    column = "edges" if listed else None
    trees = map_pairs(parts, s, tree_kernel, schema, wants, reach, fold, together=tree_kernels, listed=column)
    if not parts.split:
        return trees.drop("whole")
    trees = cut(trees)
    once, several = trees.where("whole").drop("whole"), trees.where("not whole").drop("whole")
    return once.unionByName(merge_msts(several))


def blocks_fit(blocked: DataFrame) -> bool:
    """Whether :func:`subgraph_mst` splits no block of ``blocked``."""
    sizes = blocked.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("coords")).alias("dim"))
    rows, dim = sizes.agg(F.max("rows"), F.max("dim")).first()
    return (rows or 0) <= block_cap(dim or 1)


def _forests_of_parts(rows: dict) -> dict:
    """Whole trees as they are, and one forest per subgraph of the trees of its parts."""
    kept = [np.flatnonzero(rows["whole"])]
    part = np.flatnonzero(~rows["whole"])
    for subgraph in np.unique(rows["subgraph"][part]):
        at = part[rows["subgraph"][part] == subgraph]
        left, right, weight = (rows[c][at] for c in ("left", "right", "weight"))
        kept.append(at[kernels.forest(left, right, weight, left, right)])
    kept = np.concatenate(kept)
    return {name: column[kept] for name, column in rows.items()}


def clique_mst(blocked: DataFrame, s: int) -> DataFrame:
    """Trees of the subgraphs within one block."""
    return subgraph_mst(blocked, s, "within")


def bipartite_mst(blocked: DataFrame, s: int) -> DataFrame:
    """Trees of the subgraphs between two blocks."""
    return subgraph_mst(blocked, s, "between")


def square_forest(
    pairs: list[tuple[Block, Block]], radius: float | None = None, slack: float = 1.0, short: str = "no"
) -> dict:
    """Spanning forest of the edges across the listed block pairs.

    Of all edges, or with ``radius`` of a part that holds every edge up to that length
    between points of different components. ``short`` tells whether longer ones are left out:
    "no", "if any" are shorter, so that the two blocks are linked all the same, or "yes".
    """
    trees = [(np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0))]
    for a, b in pairs:
        if radius is None:
            trees.append(kernels.spanning_tree((a.ids, a.coords), (b.ids, b.coords)))
        else:
            parts = [(p, q) for p, q in kernels.close_pairs(a, b, radius, slack) if len(p[0]) and len(q[0])]
            near = [kernels.spanning_tree(p, q, radius) for p, q in parts] if short != "no" else []
            if short != "yes" and not any(len(tree[0]) for tree in near):
                near = [kernels.spanning_tree(p, q) for p, q in parts]
            trees += near
    left, right, weight = (np.concatenate([t[i] for t in trees]) for i in range(3))
    kept = kernels.forest(left, right, weight, left, right)
    return {"left": left[kept], "right": right[kept], "weight": weight[kept]}


def checked_edges(edges: DataFrame) -> DataFrame:
    """``edges`` that fail when read if an end is null or a weight is null or NaN.

    Such rows have no place in the order of edges; every path would treat them its own way.
    """
    weight = F.col("weight").cast("double")
    bad = F.col("left").isNull() | F.col("right").isNull() | weight.isNull() | F.isnan(weight)
    refused = F.raise_error(F.lit("edges need both ends and a weight that is a number")).cast("double")
    return edges.withColumn("weight", F.when(bad, refused).otherwise(weight))


def sort_edges(edges: DataFrame) -> DataFrame:
    """Edges in their total order (a range sort)."""
    return edges.orderBy(*edge_order())


def edges_by_subgraph(edges: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """``(subgraph, run, edges)``: each subgraph's edges, lightest first, in runs of ``most``.

    A subgraph's tree is linear in its two blocks and makes one run; edges merged since may
    be more, and any number of them is cut into runs by one range sort. Trees listed by
    :func:`subgraph_mst` have one row per subgraph, and are sorted and cut where they are.
    """
    if "edges" in edges.columns:
        size = F.size("edges")
        last = F.floor((size - 1) / F.lit(most)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda r: F.slice("edges", r * most + 1, F.lit(most)))
        runs = F.when(size <= most, F.array("edges")).otherwise(parts)
        lists = edges.select("subgraph", F.array_sort("edges").alias("edges"))
        lists = lists.select("subgraph", F.posexplode(runs).alias("run", "edges"))
        return lists.select("subgraph", F.col("run").cast("bigint").alias("run"), "edges")
    placed = cut(with_dense_id(edges, ["subgraph", "weight", "left", "right"], name="__place"))
    starts = placed.groupBy("subgraph").agg(F.min("__place").alias("__start"))
    named = starts.withColumnRenamed("subgraph", "__of")
    rows = lookup(placed, "subgraph", named, "__of", starts.count(), "inner")
    run = F.floor((F.col("__place") - F.col("__start")) / F.lit(most)).alias("run")
    packed = F.collect_list(F.struct("weight", "left", "right"))
    return rows.groupBy("subgraph", run).agg(F.array_sort(packed).alias("edges"))


def _forest_of(table: pa.Table) -> pa.Table:
    names = ["left", "right"] if "cl" not in table.column_names else ["cl", "cr"]
    u, v = (table[name].to_numpy() for name in names)
    left, right, weight = (table[c].to_numpy() for c in ("left", "right", "weight"))
    kept = kernels.forest(u, v, weight, left, right)
    return pa.table({"left": left[kept], "right": right[kept], "weight": weight[kept]})


# Edges that a task thins at a time.
THINNED = 1_000_000


def thinned(edges: DataFrame, per_group: bool) -> DataFrame:
    """``edges(subgraph, left, right, weight)`` without those that close a cycle of lighter
    edges in the task that has them, as a combiner does; with ``per_group`` of their subgraph.

    A task holds at most ``THINNED`` edges, or twice those of one forest.
    """
    names = ["subgraph", "left", "right", "weight"]

    def forest(table: pa.Table) -> pa.Table:
        group, left, right, weight = (table[c].to_numpy() for c in names)
        u, v = left, right
        if per_group:
            _, node = np.unique(np.concatenate([left, right]), return_inverse=True)
            _, of = np.unique(group, return_inverse=True)
            u, v = (of * (node.max(initial=0) + 1) + end for end in np.split(node, 2))
        return table.take(kernels.forest(u, v, weight, left, right))

    def run(batches):
        held, rows, limit = [], 0, THINNED
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= limit:
                held = [forest(pa.concat_tables(held))]
                rows = held[0].num_rows
                if per_group and rows > limit // 2:
                    yield from held[0].to_batches()
                    held, rows = [], 0
                limit = max(THINNED, 2 * rows)
        if rows:
            yield from forest(pa.concat_tables(held)).to_batches()

    return edges.select(*names).mapInArrow(run, "subgraph long, " + EDGE)


def merge_msts(edges: DataFrame, local_edges: int | None = None) -> DataFrame:
    """Spanning forest of each ``subgraph`` group's edges: cycle edges are dropped.

    The largest group is measured first. Groups that fit a task are merged in one; when
    one does not, all groups are merged together by :func:`mst_of_edges`, over nodes
    numbered per group.
    """
    limit = LOCAL_EDGES if local_edges is None else local_edges
    edges = cut(thinned(checked_edges(edges), per_group=True))
    sizes = edges.groupBy("subgraph").agg(F.count(F.lit(1)).alias("edges"))
    if (sizes.agg(F.max("edges")).first()[0] or 0) > limit:
        return _merge_big(edges, local_edges)
    return _merge_small(edges)


def _merge_small(edges: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        merged = _forest_of(table)
        key = pa.array([table["subgraph"][0].as_py()] * merged.num_rows, pa.int64())
        return merged.add_column(0, "subgraph", key)

    return edges.groupBy("subgraph").applyInArrow(run, "subgraph long, " + EDGE)


def _merge_big(edges: DataFrame, local_edges: int | None) -> DataFrame:
    low, high = F.min(F.least("left", "right")), F.max(F.greatest("left", "right"))
    facts = edges.agg(low.alias("low"), high.alias("high"), F.min("subgraph").alias("first"), F.max("subgraph").alias("last"))
    low, high, first, last = facts.first()
    span = high - low + 1
    if (last - first + 1) * span >= 1 << 62:
        return _merge_numbered(edges, local_edges)
    # Group and id fit one number, so that no table of nodes is needed.
    for end in ("left", "right"):
        edges = edges.withColumn(end, (F.col("subgraph") - first) * span + (F.col(end) - low))
    forest = mst_of_edges(edges.select("left", "right", "weight"), local_edges)
    return forest.select(
        F.expr(f"`left` div {span} + {first}").alias("subgraph"),
        *[(F.pmod(F.col(end), F.lit(span)) + low).alias(end) for end in ("left", "right")],
        "weight",
    )


def _merge_numbered(edges: DataFrame, local_edges: int | None) -> DataFrame:
    ends = edges.select("subgraph", F.explode(F.array("left", "right")).alias("id")).distinct()
    numbered = with_dense_id(ends, ["subgraph", "id"], name="node")
    count = numbered.count()
    key = F.struct("subgraph", "id")
    table = numbered.select(key.alias("key"), "node")
    for end in ("left", "right"):
        edges = edges.withColumn("at", F.struct("subgraph", F.col(end).alias("id")))
        edges = lookup(edges, "at", table, "key", count, "inner").drop("at", end)
        edges = edges.withColumnRenamed("node", end)
    forest = mst_of_edges(edges.select("left", "right", "weight"), local_edges)
    for end in ("left", "right"):
        forest = lookup(forest, end, numbered.select("node", "subgraph", "id"), "node", count, "inner")
        forest = forest.drop(end, *(["subgraph"] if end == "left" else [])).withColumnRenamed("id", end)
    return forest.select("subgraph", "left", "right", "weight")


def merge_tree(
    edges: DataFrame, k: int, subgraphs: int, local_edges: int | None = None
) -> DataFrame:
    """Merge subgraph trees ``k`` at a time until one is left.

    Before each level the largest merge group is measured. When it would exceed what
    one task may hold, the remaining levels are left out and the trees are united by
    :func:`mst_of_edges`, which has no single-task stage. Both give the same tree.
    """
    limit = LOCAL_EDGES if local_edges is None else local_edges
    level = cut(thinned(checked_edges(edges), per_group=False))
    while subgraphs > 1:
        grouped = regroup(level, k)
        sizes = grouped.groupBy("subgraph").agg(F.count(F.lit(1)).alias("edges"))
        if (sizes.agg(F.max("edges")).first()[0] or 0) > limit:
            return mst_of_edges(level, local_edges)
        level = cut(_merge_small(grouped))
        subgraphs = -(-subgraphs // k)
    return level.select("left", "right", "weight")


def mst_of_edges(edges: DataFrame, local_edges: int | None = None) -> DataFrame:
    """Minimum spanning forest of any weighted edge table.

    Boruvka rounds: every component takes its lightest outgoing edge (a partially
    aggregated ``min``), components joined by these are contracted, edges inside a
    component vanish and of parallel ones the lightest stays. At least half of the
    components disappear per round. What is left is finished in one task once it is
    small enough. Null ends or weights and NaN are refused.
    """
    limit = LOCAL_EDGES if local_edges is None else local_edges
    edges = checked_edges(edges)
    live = cut(_lightest_parallel(edges.where("left <> right"), F.col("left"), F.col("right")))
    chosen: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        left = live.count()
        if left <= limit:
            break
        picks = cut(lightest_outgoing(live))
        count = picks.count()
        chosen.append(picks.select("left", "right", "weight"))
        roots = chase(merge_parents(picks, count), count, limit)
        for end in ("cl", "cr"):
            live = lookup(live, end, roots, "node", count).withColumn(
                end, F.coalesce("parent", end)
            ).drop("node", "parent")
        live = cut(_lightest_parallel(live.where("cl <> cr"), F.col("cl"), F.col("cr")))
    else:
        raise RuntimeError(f"the spanning forest did not settle in {MAX_ROUNDS} rounds")
    tail = one_group(live, _forest_of, EDGE)
    if not chosen:
        return tail
    # Two components may have chosen the same edge.
    return reduce(DataFrame.unionAll, chosen).distinct().unionAll(tail)


def _lightest_parallel(edges: DataFrame, cl: Column, cr: Column) -> DataFrame:
    best = F.min(F.struct("weight", "left", "right")).alias("e")
    return (
        edges.groupBy(F.least(cl, cr).alias("cl"), F.greatest(cl, cr).alias("cr"))
        .agg(best)
        .select("cl", "cr", "e.left", "e.right", "e.weight")
    )


def lightest_outgoing(edges: DataFrame) -> DataFrame:
    """The lightest edge leaving each component, with the component it leads to."""
    both = edges.select("cl", "cr", "left", "right", "weight").unionAll(
        edges.select("cr", "cl", "left", "right", "weight")
    )
    best = F.min(F.struct("weight", "left", "right", "cr")).alias("e")
    return (
        both.groupBy(F.col("cl").alias("node"))
        .agg(best)
        .select("node", F.col("e.cr").alias("to"), "e.left", "e.right", "e.weight")
    )


def merge_parents(picks: DataFrame, rows: int) -> DataFrame:
    """Parent pointers without cycles from each component's chosen neighbour.

    Under a total order of edges only two components that chose each other form a
    cycle; the smaller of the two becomes the root.
    """
    back = picks.select(F.col("node").alias("__at"), F.col("to").alias("__back"))
    parent = F.when(
        F.col("__back") == F.col("node"), F.least("node", "to")
    ).otherwise(F.col("to"))
    return lookup(picks.select("node", "to"), "to", back, "__at", rows).select(
        "node", parent.alias("parent")
    )


def non_cycle_edges(edges: DataFrame, rank: str, local_edges: int | None = None) -> DataFrame:
    """The edges that join two components when taken in order of ``rank``, any type with one.

    Equal ranks go by the ends. Edges are numbered by a range sort, so no rank is rounded;
    null ranks are refused.
    """
    known = F.when(F.col(rank).isNull(), F.raise_error(F.lit("edges need a rank")).cast("long")).otherwise(F.col("left"))
    ranked = edges.select(known.alias("left"), "right", rank).where("left <> right or left is null or right is null")
    numbered = with_dense_id(ranked, [rank, "left", "right"], name="__number")
    forest = mst_of_edges(
        numbered.select("left", "right", F.col("__number").cast("double").alias("weight")), local_edges
    )
    chosen = forest.select(F.col("weight").cast("long").alias("__number"))
    return numbered.join(chosen, "__number", "left_semi").select("left", "right", rank)


def nearest_outside(blocked: DataFrame, s: int) -> DataFrame:
    """Lightest edge leaving each ``component``, over the complete graph of the points.

    ``blocked`` has ``(block, id, coords, component)``. Each square keeps one edge per
    component it sees; pairs are never rows.
    """
    extra = {"component": "i8"}
    # What is found doesn't depend on the blocks, so small ones are put together.
    facts = blocked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("coords")).alias("dim")).first()
    least = block_count(facts["n"], facts["dim"] or 1, parallelism(blocked.sparkSession))
    joined = F.floor(F.col("block") / F.lit(max(1, s // least))).cast("int")
    parts = ragged_parts(blocked.withColumn("block", joined), extra=extra)

    def kernel(subgraph: int, left: Block, right: Block | None) -> dict:
        return kernels.outgoing(left, right)

    best = F.min(F.struct("weight", "left", "right", "to")).alias("e")
    schema = "node long, to long, left long, right long, weight double"
    found = map_pairs(parts, s, kernel, schema, fold=kernels.lightest_per_node, extra=extra)
    return found.groupBy("node").agg(best).select("node", "e.to", "e.left", "e.right", "e.weight")


def mst_direct(points: DataFrame, blocks: int | None = None, report: list[dict] | None = None) -> DataFrame:
    """Spanning tree of the complete graph by Boruvka rounds over its distances.

    Uses neither the subgraph trees nor their merge, so it is the independent check
    of :func:`arbora.plans.trees.mst`. Blocks are runs of points along a curve, at least
    ``blocks`` of them and none bigger than a task can pair with another. In each
    round blocks are first compared with themselves and the next one, which gives every
    component an edge to leave by, then with the blocks whose boxes are nearer than the
    longest such edge of the components in either. Blocks of one component don't meet.
    Where boxes overlap, as in many dimensions, a round is quadratic. ``report`` gets, per
    round, the ``pairs`` of blocks compared, and ``of`` how many.
    """
    n, dim = checked_points(points)
    spark = points.sparkSession
    points = points.select("id", "coords")
    if n < 2 or dim == 0:
        first = F.lit(points.agg(F.min("id")).first()[0]).cast("bigint")
        rest = points.where(F.col("id") > first)
        return rest.select(first.alias("left"), F.col("id").alias("right"), F.lit(0.0).alias("weight"))
    most = FINE_BLOCK if dim <= FEW_DIMENSIONS else None
    # Blocks asked for may be too few: a tile of theirs has to fit a task.
    size = min(block_cap(dim, most), -(-n // (blocks or block_count(n, dim, parallelism(spark), most))))
    s = -(-n // size)
    blocked = cut(curve_blocks(points, dim, size))
    packed = cut(pack(blocked))
    levels = box_levels(packed.select("block", "lo", "hi"), s)
    labelled = cut(blocked.select("id", "block", F.col("id").alias("component")))
    side = square_side(s, dim, parallelism(spark))
    alone = spark.createDataFrame([], EDGE)
    return boruvka(packed, levels, labelled, alone, alone, n, side, report)


def boruvka(
    packed: DataFrame,
    levels: list[DataFrame],
    labelled: DataFrame,
    tree: DataFrame,
    known: DataFrame,
    parts: int,
    side: int,
    report: list[dict] | None = None,
) -> DataFrame:
    """The spanning tree that has the edges ``tree``, by rounds over its components.

    ``labelled`` names the ``(id, block, component)`` of all points, of ``parts`` components.
    ``known`` are further edges; those between components are lengths to search up to.
    """
    spark = packed.sparkSession
    every = levels[0].select(F.col("number").alias("a"))
    last = every.agg(F.max("a")).first()[0]
    ends = F.array(F.col("a"), F.least(F.col("a") + 1, F.lit(last)))
    first_pairs = cut(_in_squares(every.select("a", F.explode(ends).alias("b")).distinct(), side))
    hints = known.select(F.col("left").alias("cl"), F.col("right").alias("cr"), "left", "right", "weight")
    moves = labelled.select(F.col("id").alias("node"), F.col("component").alias("parent"))
    hints, chosen = _moved(hints, moves, labelled.count()), [tree]
    for _ in range(MAX_ROUNDS):
        if parts <= 1:
            # Two components may have chosen the same edge.
            return reduce(DataFrame.unionAll, chosen).distinct()
        labels = packed.join(packed_labels(labelled), "block")
        found = _outgoing(labels, first_pairs).unionByName(lightest_outgoing(hints))
        seen = cut(_lightest_out(found))
        pairs = cut(_open_pairs(levels, labelled, seen, parts, first_pairs, side))
        if report is not None:
            blocks = last + 1
            report.append({"pairs": first_pairs.count() + pairs.count(), "of": blocks * (blocks + 1) // 2})
        picks = cut(_lightest_out(seen.unionByName(_outgoing(labels, pairs))))
        chosen.append(picks.select("left", "right", "weight"))
        roots = chase(merge_parents(picks, parts), parts)
        moved = lookup(labelled, "component", roots, "node", parts)
        labelled = cut(moved.select("id", "block", F.coalesce("parent", "component").alias("component")))
        hints = _moved(hints, roots, parts)
        parts = roots.where("node = parent").count()
    raise RuntimeError(f"the spanning tree did not settle in {MAX_ROUNDS} rounds")


def _moved(edges: DataFrame, roots: DataFrame, rows: int) -> DataFrame:
    """``edges`` between the components that ``roots(node, parent)`` lead to."""
    for end in ("cl", "cr"):
        edges = lookup(edges, end, roots, "node", rows).withColumn(end, F.coalesce("parent", end)).drop("parent")
    return cut(edges.where("cl <> cr"))


def _in_squares(pairs: DataFrame, side: int) -> DataFrame:
    """``(square, low, high)`` of block pairs ``(a, b)``."""
    low, high = F.least("a", "b").cast("int"), F.greatest("a", "b").cast("int")
    square = F.shiftleft(F.floor(low / side), 32).bitwiseOR(F.floor(high / side)).alias("square")
    return pairs.select(square, low.alias("low"), high.alias("high"))


def _outgoing(packed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per square, the lightest edge that leaves each component between the listed blocks."""

    def kernel(listed):
        found = [kernels.outgoing(a, None if a is b else b) for a, b in listed]
        return kernels.lightest_per_node({name: np.concatenate([f[name] for f in found]) for name in found[0]})

    squares = pairs.select("square").distinct().count()
    schema = "node long, to long, left long, right long, weight double"
    return map_squares(packed, pairs, kernel, schema, squares, {"component": "i8"})


def _lightest_out(found: DataFrame) -> DataFrame:
    best = F.min(F.struct("weight", "left", "right", "to")).alias("e")
    return found.groupBy("node").agg(best).select("node", "e.to", "e.left", "e.right", "e.weight")


def _open_pairs(
    levels: list[DataFrame], labelled: DataFrame, seen: DataFrame, parts: int, done: DataFrame, side: int
) -> DataFrame:
    """Block pairs that may hold a lighter edge than those ``seen``, without those ``done``."""
    lightest = seen.select(F.col("node").alias("of"), "weight")
    members = labelled.select("block", "component").distinct()
    known = lookup(members, "component", lightest, "of", parts)
    limit = F.max(F.coalesce("weight", F.lit(float("inf")))).alias("limit")
    one = F.when(F.min("component") == F.max("component"), F.min("component")).alias("home")
    facts = cut(known.groupBy(F.col("block").alias("number")).agg(limit, one))
    near = near_pairs(levels, facts.select("number", "limit"))
    homes = [facts.select(F.col("number").alias(x), F.col("home").alias(f"home_{x}")) for x in "ab"]
    near = near.join(homes[0], "a").join(homes[1], "b")
    near = near.where(~F.coalesce(F.col("home_a") == F.col("home_b"), F.lit(False)))
    return _in_squares(near.select("a", "b"), side).join(done, ["square", "low", "high"], "left_anti")
