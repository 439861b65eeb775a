"""Merge tables, cuts, labels and dendrogram layouts from spanning trees."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators import kernels
from arbora.operators.components import components, edge_components
from arbora.operators.features import with_dense_id
from arbora.runtime import LOCAL_EDGES, MAX_ROUNDS, cut, lookup

# Most edges that a cut finds by a top-k instead of a sort.
TOP_EDGES = 10_000

STEP = "step long, child_a long, child_b long, height double, size long"


def dense_nodes(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Nodes numbered 0..n-1 by id, and the edges rewritten to these numbers.

    A table whose ids already are 0..n-1 is passed through.
    """
    row = nodes.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    n = row["n"]
    if n == 0 or (row["lo"] == 0 and row["hi"] == n - 1):
        return nodes.select("id", F.col("id").alias("node")), edges, n
    numbered = with_dense_id(nodes.select("id"), ["id"], name="node")
    for end in ("left", "right"):
        edges = lookup(edges, end, numbered, "id", n, "inner").drop(end)
        edges = edges.withColumnRenamed("node", end)
    # The order of edges is kept: numbering is monotone in the ids.
    return numbered, edges.select("left", "right", "weight"), n


def linkage(edges: DataFrame, n: int, leaf_edges: int | None = None) -> DataFrame:
    """Single-linkage merge table ``(step, child_a, child_b, height, size)``.

    ``edges`` is a spanning tree or forest over nodes 0..n-1 (see ``dense_nodes``); the
    cluster formed at step ``t`` gets id ``n + t``. Edges are ranked and the ranks
    bisected: the components of a lower half are contracted, which makes the upper half
    an independent problem, so all problems of a level are solved at once. Intervals of
    at most ``leaf_edges`` ranks are finished by a grouped map, one task each.
    """
    leaf = LOCAL_EDGES // 4 if leaf_edges is None else leaf_edges
    ranked = with_dense_id(edges.select("left", "right", "weight"), ["weight", "left", "right"], name="step")
    problem = ranked.select(
        "step",
        F.col("left").alias("a"),
        F.lit(1).cast("bigint").alias("size_a"),
        F.col("right").alias("b"),
        F.lit(1).cast("bigint").alias("size_b"),
        F.col("weight").alias("height"),
    )
    bits = 0
    while (leaf << bits) < n - 1:
        bits += 1
    width = leaf << bits
    while width > leaf:
        half = width // 2
        low = (F.col("step") % width) < half
        problem = cut(_halve(problem, low, n))
        width = half

    def finish(table: pa.Table) -> pa.Table:
        table = table.sort_by("step")
        a, size_a, b, size_b, step = (
            table[c].to_numpy() for c in ("a", "size_a", "b", "size_b", "step")
        )
        first, second, size = kernels.merge_steps(a, size_a, b, size_b, step, n)
        columns = {"child_a": first, "child_b": second, "height": table["height"], "size": size}
        return pa.table({"step": table["step"], **columns})

    keyed = problem.withColumn("interval", F.floor(F.col("step") / width))
    return keyed.groupBy("interval").applyInArrow(lambda t: finish(t.drop(["interval"])), STEP)


def _halve(problem: DataFrame, low, n: int) -> DataFrame:
    """Contract the components of every lower half in the endpoints of its upper half.

    A cluster id occurs in one interval only, the one holding the step that merges it,
    so the lower halves of all intervals are labelled together.
    """
    lower, upper = problem.where(low), problem.where(~low)
    labels = cut(edge_components(lower.select("a", "b")))
    count = labels.count()
    at = labels.select(F.col("id").alias("__at"), "component")
    tops = (
        lookup(lower.select("a", "step"), "a", at, "__at", count, "inner")
        .groupBy("component")
        .agg((F.lit(n) + F.max("step")).alias("top"))
    )
    ends = F.array(F.struct(F.col("a").alias("id"), F.col("size_a").alias("size")),
                   F.struct(F.col("b").alias("id"), F.col("size_b").alias("size")))
    sizes = lower.select(F.inline(ends)).distinct()
    total = (
        sizes.join(labels, "id").groupBy("component").agg(F.sum("size").alias("total"))
    )
    formed = cut(labels.join(tops.join(total, "component"), "component").select("id", "top", "total"))
    for end in ("a", "b"):
        upper = lookup(upper, end, formed, "id", count).select(
            *[c for c in problem.columns if c not in (end, "size_" + end)],
            F.coalesce("top", end).alias(end),
            F.coalesce("total", "size_" + end).alias("size_" + end),
        ).select(*problem.columns)
    return lower.unionAll(upper)


def _exactly_one(n_clusters, threshold) -> None:
    if (n_clusters is None) == (threshold is None):
        raise ValueError("give exactly one of n_clusters and threshold")
    if n_clusters is not None and n_clusters < 1:
        raise ValueError("n_clusters must be at least 1")


def cut_tree(
    nodes: DataFrame,
    edges: DataFrame,
    n_clusters: int | None = None,
    threshold: float | None = None,
) -> DataFrame:
    """``(id, component)`` after removing the heaviest edges of a spanning tree.

    ``n_clusters`` removes the heaviest ``n_clusters - 1`` edges in edge order,
    ``threshold`` every edge of at least that weight. A component is named by its
    smallest id.
    """
    _exactly_one(n_clusters, threshold)
    if threshold is not None:
        kept = edges.where(F.col("weight") < threshold)
    elif n_clusters == 1:
        kept = edges
    else:
        kept = _without_heaviest(edges, n_clusters - 1)
    return components(nodes.select("id"), kept)


def _without_heaviest(edges: DataFrame, count: int) -> DataFrame:
    """All but the ``count`` last edges in edge order, with no join.

    For few, the lightest removed edge is found by a top-k, which keeps ``count`` rows
    per task; for many, edges are numbered by a range sort.
    """
    if count > TOP_EDGES:
        numbered = with_dense_id(edges.select("left", "right", "weight"), ["weight", "left", "right"], name="rank")
        total = numbered.count()
        _enough(total, count)
        return numbered.where(F.col("rank") < total - count).drop("rank")
    heaviest = [F.desc("weight"), F.desc("left"), F.desc("right")]
    top = edges.orderBy(*heaviest).limit(count).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("weight", "left", "right")).alias("e")
    ).first()
    _enough(top["n"], count)
    last = top["e"]
    w, left, right = (F.lit(last[c]) for c in ("weight", "left", "right"))
    same = F.col("weight") == w
    return edges.where(
        (F.col("weight") < w)
        | (same & (F.col("left") < left))
        | (same & (F.col("left") == left) & (F.col("right") < right))
    )


def _enough(edges: int, count: int) -> None:
    if edges < count:
        raise ValueError(f"cannot cut {edges} edges into {count + 1} clusters")


def labels(clusters: DataFrame) -> DataFrame:
    """``(id, label)`` with labels 0..k-1 in order of each component's smallest id."""
    clusters = cut(clusters)
    names = with_dense_id(clusters.select("component").distinct(), ["component"], name="label")
    return lookup(clusters, "component", names, "component", names.count(), "inner").select("id", "label")


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("points"))


def cut_linkage(
    table: DataFrame, n: int, n_clusters: int | None = None, threshold: float | None = None
) -> DataFrame:
    """``(id, component)`` of leaves 0..n-1 after cutting any merge table.

    Keeps the first ``n - n_clusters`` steps, or the steps below ``threshold``; each
    kept step joins its two children to the cluster it forms.
    """
    _exactly_one(n_clusters, threshold)
    if n_clusters is not None and n_clusters > n:
        raise ValueError(f"cannot cut {n} leaves into {n_clusters} clusters")
    kept = (
        table.where(F.col("height") < threshold)
        if threshold is not None
        else table.where(F.col("step") < n - n_clusters)
    )
    ups = kept.select(
        F.explode(F.array("child_a", "child_b")).alias("a"), (F.col("step") + n).alias("b")
    )
    leaves = table.sparkSession.range(n)
    found = edge_components(ups).where(F.col("id") < n).withColumnRenamed("id", "__id")
    return leaves.join(found, leaves["id"] == found["__id"], "left").select(
        leaves["id"], F.coalesce("component", leaves["id"]).alias("component")
    )


def dendrogram_layout(table: DataFrame, n: int, orientation: str = "top") -> DataFrame:
    """Leaf order and link coordinates of a merge table.

    A leaf's place is the number of leaves to its left: the sizes of the left siblings
    of all right children above it, summed by pointer doubling in about log2(depth)
    rounds. One row per leaf and per step: ``first`` leaf place, ``size``, middle
    ``position`` (places are 10 apart, starting at 5) and ``height``, turned to
    ``(x, y)`` by ``orientation`` ("top", "bottom", "left", "right").
    """
    if orientation not in ("top", "bottom", "left", "right"):
        raise ValueError("orientation must be top, bottom, left or right")
    spark = table.sparkSession
    formed = table.select((F.col("step") + n).alias("node"), "size", "height")
    sizes = spark.range(n).select(
        F.col("id").alias("node"), F.lit(1).cast("bigint").alias("size"), F.lit(0.0).alias("height")
    ).unionAll(formed)
    steps = table.withColumn("up", F.col("step") + n)
    left_size = lookup(
        steps.select("child_a", "child_b", "up"), "child_a",
        sizes.select("node", "size"), "node", 2 * n, "inner",
    )
    hops = cut(
        left_size.select(
            F.inline(
                F.array(
                    F.struct(F.col("child_a").alias("node"), "up", F.lit(0).cast("bigint").alias("offset")),
                    F.struct(F.col("child_b").alias("node"), "up", F.col("size").alias("offset")),
                )
            )
        )
    )
    for _ in range(MAX_ROUNDS):
        next_hop = hops.select(
            F.col("node").alias("__at"), F.col("up").alias("__up"), F.col("offset").alias("__more")
        )
        hops = cut(
            lookup(hops, "up", next_hop, "__at", 2 * n).select(
                "node",
                F.coalesce("__up", "up").alias("up"),
                (F.col("offset") + F.coalesce("__more", F.lit(0))).alias("offset"),
                F.col("__up").isNotNull().alias("moved"),
            )
        )
        if hops.where("moved").isEmpty():
            break
        hops = hops.drop("moved")
    place = sizes.join(hops.select("node", "offset"), "node", "left").withColumn(
        "first", F.coalesce("offset", F.lit(0))
    )
    middle = F.col("first") * 10 + F.col("size") * 5
    position, height = middle.cast("double"), F.col("height")
    x, y = {
        "top": (position, height),
        "bottom": (position, -height),
        "right": (height, position),
        "left": (-height, position),
    }[orientation]
    return place.select("node", "first", "size", x.alias("x"), y.alias("y"))
