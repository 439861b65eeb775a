"""The minimum spanning tree of a points table, planned for its size and shape."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions.points import box_distance
from arbora.operators import spanning, tiles
from arbora.operators.blocks import assign_blocks, subgraph_count
from arbora.operators.components import edge_components
from arbora.operators.copies import fold_copies
from arbora.operators.curve import FEW_DIMENSIONS, FINE_BLOCK, SLACK, box_levels, curve_blocks, packed_labels
from arbora.operators.features import checked_points
from arbora.runtime import MAX_ROUNDS, cut, lookup, parallelism

# Tiles per core up to which all block pairs are simply solved.
WAVES = 16
# Factor by which the search radius grows from round to round.
GROWTH = 4.0


def mst(
    points: DataFrame,
    blocks: int | None = None,
    k: int = 4,
    block_points: int | None = None,
    local_edges: int | None = None,
) -> DataFrame:
    """Minimum spanning tree ``(left, right, weight)`` of the complete Euclidean graph.

    Exact, and unique: edges are ordered by ``(weight, left, right)``, so neither the
    number of blocks nor the partitioning changes the result.

    With ``blocks`` given, every block and every pair of blocks is solved and the trees
    are merged ``k`` at a time. Otherwise copies of a point are first folded into one,
    blocks are runs of points along a space-filling curve, and block pairs are visited
    in growing radius, leaving out those that cannot hold a tree edge. In few dimensions,
    once there are no more components than blocks, each looks for its lightest edge only.
    """
    if k < 2:
        raise ValueError("the merge fan-in must be at least 2")
    n, dim = checked_points(points)
    points = points.select("id", "coords")
    if n < 2 or dim == 0:
        return _trivial(points, n)
    if blocks is not None:
        trees = spanning.subgraph_mst(assign_blocks(points, blocks), blocks)
        return spanning.merge_tree(trees, k, subgraph_count(blocks), local_edges)
    # Under the edge order copies hang on the first of them by zero edges, and every
    # other tree edge touches the first: the rest can be solved without the copies.
    folded, distinct, copies = fold_copies(points, ["coords"])
    stars = None if copies is None else _star(copies)
    if distinct < 2:
        return cut(stars)
    reps = folded.select(F.col("first").alias("id"), "coords")
    tree = _grown(reps, distinct, dim, block_points, local_edges)
    return cut(tree if stars is None else tree.unionAll(stars))


def _trivial(points: DataFrame, n: int) -> DataFrame:
    """No edges for fewer than two points; points without dimensions all coincide."""
    first = points.agg(F.min("id")).first()[0]
    return _star(points.where(F.col("id") > first).select(F.lit(first).cast("bigint").alias("first"), "id"))


def _star(copies: DataFrame) -> DataFrame:
    return copies.select(
        F.col("first").alias("left"), F.col("id").alias("right"), F.lit(0.0).alias("weight")
    )


def _grown(
    points: DataFrame, n: int, dim: int, block_points: int | None, local_edges: int | None
) -> DataFrame:
    cores = parallelism(points.sparkSession)
    s = tiles.block_count(n, dim, cores, block_points)
    if block_points is None and subgraph_count(s) <= WAVES * cores:
        # So few tiles that visiting all of them is quicker than choosing.
        trees = spanning.subgraph_mst(assign_blocks(points, s), s)
        return spanning.mst_of_edges(trees, local_edges)
    if block_points is None and dim <= FEW_DIMENSIONS:
        s = tiles.block_count(n, dim, cores, FINE_BLOCK)
    size = math.ceil(n / s)
    s = math.ceil(n / size)
    blocked = cut(curve_blocks(points, dim, size))
    members = cut(blocked.select("id", "block"))
    packed = cut(tiles.pack(blocked))
    own = cut(tiles.map_tiles(tiles.own_tiles(packed), spanning.tree_kernel, spanning.EDGE, s))
    boxes = packed.select("block", "lo", "hi")
    levels = box_levels(boxes, s)
    tree = own.select("left", "right", "weight")
    # In many dimensions a block's own edges are long beside those of the whole tree, so that
    # mostly this radius holds all of it; a round more would form all distances again.
    done, radius, labelled, spans = -1.0, _first_radius(own, boxes, 0.9), None, False
    for _ in range(MAX_ROUNDS):
        homes = None if labelled is None else _single_components(labelled)
        pairs = cut(_pairs_within(levels, homes, s, -1.0, radius))
        facts = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("square").alias("squares")).first()
        if facts["pairs"]:
            # Where most points are near each other, a tile's longer edges are work for nothing.
            short = "no" if dim <= FEW_DIMENSIONS else "yes" if spans else "if any"
            new = _solved(packed, pairs, facts["squares"], labelled, radius, short)
            tree = cut(spanning.mst_of_edges(tree.unionAll(new), local_edges))
        done = radius
        row = tree.agg(F.count(F.lit(1)).alias("edges"), F.max("weight").alias("longest")).first()
        spans = row["edges"] == n - 1
        if spans and row["longest"] <= done:
            return tree
        # Once the tree spans all points, its longest edge bounds what can still matter.
        radius = min(GROWTH * done, row["longest"]) if spans else GROWTH * done
        labelled = _labelled(members, tree, n, done, local_edges)
        parts = labelled.select("component").distinct().count()
        if dim <= FEW_DIMENSIONS and parts <= s:
            # Components of many blocks: a radius that joins two holds nearly all their pairs.
            known, side = tree.where(F.col("weight") > done), tiles.square_side(s, dim, cores)
            return spanning.boruvka(packed, levels, labelled, tree.where(F.col("weight") <= done), known, parts, side)
    raise RuntimeError(f"the search radius did not settle in {MAX_ROUNDS} rounds")


def _solved(
    packed: DataFrame, pairs: DataFrame, squares: int, labelled: DataFrame | None, radius: float, short: str
) -> DataFrame:
    """Forests of the edges up to ``radius`` across the listed block pairs, per square."""
    extra = {}
    if labelled is not None:
        packed, extra = packed.join(packed_labels(labelled), "block"), {"component": "i8"}

    def kernel(listed):
        return spanning.square_forest(listed, radius, SLACK, short)

    return tiles.map_squares(packed, pairs, kernel, spanning.EDGE, squares, extra)


def _first_radius(own: DataFrame, boxes: DataFrame, share: float) -> float:
    """A length that this share of the edges of the blocks' own trees do not exceed."""
    radius = own.agg(F.percentile_approx("weight", share)).first()[0]
    if not radius:
        sides = F.zip_with("hi", "lo", lambda h, low: h - low)
        radius = boxes.agg(F.max(F.aggregate(sides, F.lit(0.0), lambda a, x: a + x))).first()[0]
    return radius or 1.0


def _labelled(
    members: DataFrame, tree: DataFrame, n: int, radius: float, local_edges: int | None
) -> DataFrame:
    """``(id, block, component)`` with the components of the tree's edges <= radius."""
    short = tree.where(F.col("weight") <= radius)
    labels = edge_components(short.select(F.col("left").alias("a"), F.col("right").alias("b")), local_edges)
    found = lookup(members, "id", labels.withColumnRenamed("id", "__id"), "__id", n)
    return cut(found.withColumn("component", F.coalesce("component", "id")))


def _single_components(labelled: DataFrame) -> DataFrame:
    """``(block, home)`` of the blocks that lie in one component."""
    return cut(
        labelled.groupBy("block")
        .agg(F.min("component").alias("home"), F.max("component").alias("last"))
        .where("home = last")
        .select("block", "home")
    )


def _pairs_within(
    levels: list[DataFrame], homes: DataFrame | None, s: int, done: float, radius: float
) -> DataFrame:
    """``(square, low, high)`` of block pairs more than ``done``, at most ``radius`` apart.

    A round looks only at the edges up to its radius, so that pairs are visited again.

    Pairs that lie in one component already are left out: an edge between them closes
    a cycle of shorter edges. Pairs are refined down the box hierarchy: boxes meet only
    below a pair of boxes near each other, by equi-joins on the box above.
    """
    spark = levels[0].sparkSession
    # Squares as big as leaves a few tasks per core.
    side = max(1, min(tiles.SQUARE, math.isqrt(subgraph_count(s) // (4 * parallelism(spark)))))
    near = spark.createDataFrame([(0, 0)], "a int, b int")
    for depth in range(len(levels) - 1, -1, -1):
        table = levels[depth]
        if depth == 0:
            table = table.withColumn("home", F.lit(None).cast("bigint")) if homes is None else table.join(
                homes.withColumnRenamed("block", "number"), "number", "left"
            )
        a = table.select(*[F.col(c).alias(c + "_a") for c in table.columns])
        b = table.select(*[F.col(c).alias(c + "_b") for c in table.columns])
        apart = box_distance(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b")) * SLACK
        both = near.join(a, near["a"] == a["up_a"]).join(b, F.col("b") == b["up_b"]).where(apart <= radius)
        if depth:
            both = both.where("number_a <= number_b")
        else:
            joined = F.coalesce(F.col("home_a") == F.col("home_b"), F.lit(False))
            both = both.where("number_a < number_b").where(~joined & (apart > done))
        near = both.select(F.col("number_a").alias("a"), F.col("number_b").alias("b"))
    low, high = F.col("a"), F.col("b")
    square = F.shiftleft(F.floor(low / side), 32).bitwiseOR(F.floor(high / side)).alias("square")
    return near.select(square, low.alias("low"), high.alias("high"))
