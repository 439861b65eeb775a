"""Blocks along a space-filling curve, and the boxes around runs of them."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.points import box_distance
from arbora.operators.features import with_dense_id
from arbora.runtime import cut

# In few dimensions distances are cheap and boxes tight, so finer blocks prune better.
FEW_DIMENSIONS, FINE_BLOCK = 8, 512
# Neighbours along the curve that share a box on the next level of the hierarchy.
FAN = 64
# A box distance is a sum of rounded terms; this much slack keeps it a lower bound.
SLACK = 1 - 1e-9


def curve_key(points: DataFrame, dim: int) -> Column:
    """Position of a point along a Morton curve over its widest dimensions.

    Only the order of points depends on it, never a result. The statistics are one
    row per dimension.
    """
    stats = (
        points.select(F.posexplode("coords").alias("axis", "x"))
        .groupBy("axis")
        .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
        .orderBy(F.desc("sd"), "axis")
        .limit(min(dim, 12))
        .collect()
    )
    axes = [r for r in stats if r["sd"] > 0] or stats[:1]
    bits = min(16, 60 // len(axes))
    cells = []
    for r in axes:
        low, width = r["mean"] - 3 * r["sd"], max(6 * r["sd"], 5e-324)
        cell = F.floor((F.col("coords")[r["axis"]] - low) / width * (1 << bits))
        cells.append(F.greatest(F.lit(0), F.least(cell, F.lit((1 << bits) - 1))).cast("bigint"))
    terms = []
    for level in range(bits):
        for i, cell in enumerate(cells):
            bit = F.shiftright(cell, level).bitwiseAND(F.lit(1).cast("bigint"))
            terms.append(F.shiftleft(bit, level * len(cells) + i))
    key = terms[0]
    for term in terms[1:]:
        key = key.bitwiseOR(term)
    return key


def curve_blocks(points: DataFrame, dim: int, size: int) -> DataFrame:
    """Blocks of exactly ``size`` points (the last may be smaller) along the curve."""
    keyed = points.withColumn("curve", curve_key(points, dim))
    placed = with_dense_id(keyed, ["curve", "id"], name="position")
    block = F.floor(F.col("position") / F.lit(size)).cast("int")
    return placed.select("id", "coords", block.alias("block"))


def packed_labels(labelled: DataFrame) -> DataFrame:
    """``(block, component)`` buffers in id order, to go with the packed blocks."""

    def encode(table: pa.Table) -> pa.Table:
        label = table.sort_by("id")["component"].to_numpy().astype("<i8")
        return pa.table(
            {"block": table["block"].slice(0, 1), "component": pa.array([label.tobytes()], pa.binary())}
        )

    return labelled.groupBy("block").applyInArrow(encode, "block int, component binary")


def box_levels(boxes: DataFrame, s: int, fan: int = FAN) -> list[DataFrame]:
    """``(number, up, lo, hi)`` per level: the boxes of blocks, of runs of ``fan`` blocks,
    of ``fan`` such runs and so on, up to a level of at most ``fan``.

    ``up`` is the number of the box above. Bounds are reduced per axis, as rows.
    """
    up = F.floor(F.col("number") / fan).cast("int").alias("up")
    levels = [cut(boxes.withColumnRenamed("block", "number").select("number", up, "lo", "hi"))]
    while s > fan:
        s = math.ceil(s / fan)
        axes = levels[-1].select(F.col("up").alias("number"), F.posexplode(F.arrays_zip("lo", "hi")).alias("axis", "x"))
        bounds = axes.groupBy("number", "axis").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
        whole = bounds.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("axis", "lo", "hi"))).alias("x"))
        levels.append(cut(whole.select("number", up, F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))))
    return levels


def near_pairs(levels: list[DataFrame], limits: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: blocks whose boxes are no farther apart than the greater of their limits.

    ``limits`` is ``(number, limit)`` per block. Boxes meet only below two boxes that are near
    enough for the greatest limit in either, by equi-joins on the box above.
    """
    bounds = [limits]
    for level in levels[:-1]:
        known = level.select("number", "up").join(bounds[-1], "number")
        bounds.append(cut(known.groupBy(F.col("up").alias("number")).agg(F.max("limit").alias("limit"))))
    near = limits.sparkSession.createDataFrame([(0, 0)], "a int, b int")
    for depth in range(len(levels) - 1, -1, -1):
        table = levels[depth].join(bounds[depth], "number")
        a, b = (table.select(*[F.col(c).alias(f"{c}_{x}") for c in table.columns]) for x in "ab")
        apart = box_distance(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b")) * SLACK
        both = near.join(a, near["a"] == a["up_a"]).join(b, F.col("b") == b["up_b"])
        both = both.where(apart <= F.greatest("limit_a", "limit_b"))
        both = both.where("number_a <= number_b" if depth else "number_a < number_b")
        near = both.select(F.col("number_a").alias("a"), F.col("number_b").alias("b"))
    return near
