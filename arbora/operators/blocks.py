"""Blocks of points and the subgraphs (block pairs) that cover the complete graph.

Subgraph numbering for ``s`` blocks: the ``s(s-1)/2`` pairs of different blocks
come first, ordered by their higher block, then the ``s`` blocks by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def subgraph_count(s: int | Column) -> int | Column:
    """How many subgraphs ``s`` blocks have; a number, or a column for a column."""
    if isinstance(s, Column):
        s = s.cast("bigint")
        return F.shiftright(s * (s - 1), 1) + s
    return s * (s - 1) // 2 + s


def assign_blocks(points: DataFrame, s: int, by: str = "hash") -> DataFrame:
    """Add ``block`` in 0..s-1, a pure function of the id and so safe under retries.

    ``by="hash"`` gives even blocks for any unique ids, ``by="id"`` is the plain
    remainder, which is even for dense ids.
    """
    if s < 1:
        raise ValueError("there must be at least one block")
    key = {"hash": F.xxhash64("id"), "id": F.col("id")}[by]
    return points.withColumn("block", F.pmod(key, F.lit(s)).cast("int"))


def pair_subgraph(a: Column, b: Column, s: int) -> Column:
    """Subgraph number of two blocks, in either order."""
    low, high = F.least(a, b).cast("bigint"), F.greatest(a, b).cast("bigint")
    between = F.shiftright(high * (high - 1), 1) + low
    return F.when(low == high, F.lit(s * (s - 1) // 2) + low).otherwise(between)


def subgraph_plan(spark: SparkSession, s: int) -> DataFrame:
    """``(subgraph, left, right, is_bipartite)`` for every subgraph of ``s`` blocks."""
    pairs = s * (s - 1) // 2
    p = F.col("id")
    root = F.floor(F.sqrt((p * 8 + 1).cast("double"))).cast("bigint")
    guess = F.shiftright(root + 1, 1)
    # The square root is a double and may round up; one step back makes it exact.
    guess = F.when(F.shiftright(guess * (guess - 1), 1) > p, guess - 1).otherwise(guess)
    right = F.when(p < pairs, guess).otherwise(p - pairs)
    left = F.when(p < pairs, p - F.shiftright(guess * (guess - 1), 1)).otherwise(p - pairs)
    return spark.range(subgraph_count(s)).select(
        p.alias("subgraph"),
        left.cast("int").alias("left"),
        right.cast("int").alias("right"),
        (p < pairs).alias("is_bipartite"),
    )


def points_by_subgraph(blocked: DataFrame, s: int) -> DataFrame:
    """Send each point to the ``s`` subgraphs of its block; side 0 is the lower block.

    A narrow step: the copies are made by ``explode`` and shuffled only by what
    follows. The tree operators ship packed blocks instead (see ``tiles``).
    """
    other = F.explode(F.sequence(F.lit(0), F.lit(s - 1))).alias("other")
    copies = blocked.select("id", "coords", "block", other)
    side = F.when(F.col("block") <= F.col("other"), 0).otherwise(1)
    return copies.select(
        pair_subgraph(F.col("block"), F.col("other"), s).alias("subgraph"),
        side.alias("side"),
        "id",
        "coords",
    )


def subgraph_sizes(delivered: DataFrame) -> DataFrame:
    """Points per subgraph, pre-aggregated before the shuffle."""
    return delivered.groupBy("subgraph").agg(F.count(F.lit(1)).alias("points"))


def block_subgraph_sizes(blocked: DataFrame, s: int) -> DataFrame:
    """:func:`subgraph_sizes` without delivery: points are counted per block, and only the
    counts go to the block's subgraphs."""
    counts = blocked.groupBy("block").agg(F.count(F.lit(1)).alias("points"))
    other = F.explode(F.sequence(F.lit(0), F.lit(s - 1))).alias("other")
    ends = counts.select("points", "block", other)
    key = pair_subgraph(F.col("block"), F.col("other"), s).alias("subgraph")
    return ends.groupBy(key).agg(F.sum("points").alias("points"))


def regroup(edges: DataFrame, k: int, key: str = "subgraph") -> DataFrame:
    """Merge group of each subgraph for a fan-in of ``k``: the key divided by k."""
    if k < 2:
        raise ValueError("the merge fan-in must be at least 2")
    return edges.withColumn(key, F.floor(F.col(key) / F.lit(k)).cast("bigint"))
