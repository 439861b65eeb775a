"""Aggregates and comparisons of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.functions.points import edge_order


def edge_counts(edges: DataFrame, key: str = "subgraph") -> DataFrame:
    return edges.groupBy(key).agg(F.count(F.lit(1)).alias("edges"))


def first_edges(edges: DataFrame, k: int, key: str = "subgraph") -> DataFrame:
    """The ``k`` lightest edges of each key; the rank limit also runs before the shuffle."""
    order = Window.partitionBy(key).orderBy(*edge_order())
    ranked = edges.withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= k).select(key, "position", "left", "right", "weight")


def total_weight(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"))


def graph_size(edges: DataFrame) -> DataFrame:
    """Distinct endpoints and edges, each edge counted once whatever its direction."""
    return _graph_facts(edges).select("nodes", "edges")


def _graph_facts(edges: DataFrame) -> DataFrame:
    """One row ``(nodes, edges, total_weight)``: three counts added up, with no join."""
    zero = F.lit(0).cast("bigint")
    ends = edges.select(F.explode(F.array("left", "right")).alias("id")).distinct()
    pairs = edges.select(
        F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")
    ).distinct()
    one, none = F.count(F.lit(1)), F.lit(0.0).alias("total_weight")
    rows = (
        ends.agg(one.alias("nodes")).select("nodes", zero.alias("edges"), none)
        .unionAll(pairs.agg(one.alias("edges")).select(zero.alias("nodes"), "edges", none))
        .unionAll(total_weight(edges).select(zero.alias("nodes"), zero.alias("edges"), "total_weight"))
    )
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns])


def compare_graphs(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Whether node count, edge count and total weight of two graphs agree.

    Sums of the same weights may differ in the last digits with the order of addition,
    hence the relative ``tolerance``.
    """
    facts = _graph_facts(a).unionAll(_graph_facts(b))
    low, high = F.min("total_weight"), F.max("total_weight")
    close = high - low <= tolerance * F.greatest(F.abs(low), F.abs(high))
    same = (
        (F.min("nodes") == F.max("nodes")) & (F.min("edges") == F.max("edges")) & close
    )
    return facts.agg(same.alias("same"))


def edge_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges that occur more often in one table: ``side`` is ``"a"`` or ``"b"``.

    One aggregation over both tables, combined before the shuffle.
    """
    columns = ["left", "right", "weight"]
    both = a.select(*columns, F.lit(1).alias("n")).unionAll(b.select(*columns, F.lit(-1).alias("n")))
    extra = both.groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0")
    return extra.select(
        F.when(F.col("n") > 0, "a").otherwise("b").alias("side"), *columns, F.abs("n").alias("copies")
    )


def adjacency(edges: DataFrame) -> DataFrame:
    """Symmetric sparse matrix of an edge table; a zero weight is no entry."""
    edges = edges.where(F.col("weight") != 0)
    return edges.select(
        F.inline(
            F.array(
                F.struct(F.col("left").alias("row"), F.col("right").alias("col"), F.col("weight").alias("value")),
                F.struct(F.col("right").alias("row"), F.col("left").alias("col"), F.col("weight").alias("value")),
            )
        )
    )
