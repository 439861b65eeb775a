"""Clustering of raw points in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame

from arbora.operators import hierarchy
from arbora.operators.agglomerate import agglomerate
from arbora.operators.features import checked_points, with_dense_id
from arbora.plans.trees import mst
from arbora.runtime import cut, lookup


def dense_points(points: DataFrame) -> tuple[DataFrame, int]:
    """``(node, id, coords)`` with nodes 0..n-1 in id order, and n."""
    n, _ = checked_points(points)
    return with_dense_id(points.select("id", "coords"), ["id"], name="node"), n


def points_linkage(points: DataFrame, method: str = "single", leaf_edges: int | None = None) -> DataFrame:
    """Merge table of the points; leaf ``i`` is the point with the i-th smallest id."""
    if method == "single":
        _, edges, n = hierarchy.dense_nodes(points, mst(points))
        return hierarchy.linkage(edges, n, leaf_edges)
    numbered, n = dense_points(points)
    leaves = numbered.select(numbered["node"].alias("id"), "coords")
    return agglomerate(leaves, n, method)


def cluster_points(
    points: DataFrame,
    n_clusters: int | None = None,
    threshold: float | None = None,
    method: str = "single",
) -> DataFrame:
    """``(id, label)`` of the points under a linkage; give a count or a threshold."""
    if method == "single":
        return hierarchy.labels(hierarchy.cut_tree(points, mst(points), n_clusters, threshold))
    numbered, n = dense_points(points)
    leaves = numbered.withColumnRenamed("id", "point").withColumnRenamed("node", "id")
    table = agglomerate(leaves.select("id", "coords"), n, method)
    found = hierarchy.labels(hierarchy.cut_linkage(cut(table), n, n_clusters, threshold))
    named = found.withColumnRenamed("id", "node")
    return lookup(numbered.select("id", "node"), "node", named.withColumnRenamed("node", "at"), "at", n).select(
        "id", "label"
    )
