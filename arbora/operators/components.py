"""Connected components of an edge table, named by their smallest id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators import kernels
from arbora.runtime import LOCAL_EDGES, MAX_ROUNDS, cut, lookup


def one_group(df: DataFrame, run, schema: str) -> DataFrame:
    """Finish a table whose size the caller has checked in a single task."""
    whole = df.withColumn("__all", F.lit(0))
    return whole.groupBy("__all").applyInArrow(lambda table: run(table.drop(["__all"])), schema)


def chase(parents: DataFrame, rows: int, local_rows: int | None = None) -> DataFrame:
    """Replace each ``parent`` by the root of its chain, by pointer doubling.

    ``parents`` has one row per ``node``; ``rows`` is their counted number.
    """
    if rows <= (LOCAL_EDGES if local_rows is None else local_rows):

        def finish(table: pa.Table) -> pa.Table:
            node, parent = table["node"].to_numpy(), table["parent"].to_numpy()
            order = np.argsort(node)
            at = np.minimum(np.searchsorted(node[order], parent), len(node) - 1)
            known = node[order][at] == parent
            up = np.where(known, order[at], np.arange(len(node)))
            root = kernels.compress(up)
            return pa.table({"node": node, "parent": parent[root]})

        return cut(one_group(parents, finish, "node long, parent long"))
    for _ in range(MAX_ROUNDS):
        up = parents.select(F.col("node").alias("__at"), F.col("parent").alias("__up"))
        parents = cut(
            lookup(parents, "parent", up, "__at", rows).select(
                "node",
                F.coalesce("__up", "parent").alias("parent"),
                (F.coalesce("__up", "parent") != F.col("parent")).alias("moved"),
            )
        )
        if parents.where("moved").isEmpty():
            return parents.select("node", "parent")
        parents = parents.select("node", "parent")
    raise RuntimeError(f"pointer doubling did not settle in {MAX_ROUNDS} rounds")


def edge_components(edges: DataFrame, local_edges: int | None = None) -> DataFrame:
    """``(id, component)`` for every node that occurs in ``edges(a, b)``.

    Each round every node points at its smallest neighbour if that is smaller than
    itself, chains are followed to their roots, and the edges are contracted. At least
    half of the nodes that still have edges disappear per round. Once few enough edges
    are left one task finishes them; the labels of the rounds are then composed from
    the last, smallest one back to the first.
    """
    limit = LOCAL_EDGES if local_edges is None else local_edges
    edges = cut(edges.where("a <> b").select("a", "b"))
    rounds = []
    for _ in range(MAX_ROUNDS):
        left = edges.count()
        if left <= limit:
            break
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointing = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        pointing = cut(pointing.select("node", F.least("node", "parent").alias("parent")))
        nodes = pointing.count()
        roots = chase(pointing, nodes, limit)
        rounds.append((roots, nodes))
        for end in ("a", "b"):
            edges = lookup(edges, end, roots, "node", nodes, "inner")
            edges = edges.drop(end).withColumnRenamed("parent", end)
        edges = edges.where("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        )
        edges = cut(edges.distinct())
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")

    def finish(table: pa.Table) -> pa.Table:
        nodes, label = kernels.component_labels(table["a"].to_numpy(), table["b"].to_numpy())
        return pa.table({"id": nodes, "component": label})

    labels, known = one_group(edges, finish, "id long, component long"), 2 * left
    for roots, nodes in reversed(rounds):
        final = labels.select(F.col("id").alias("__at"), F.col("component").alias("__to"))
        labels = cut(
            lookup(roots, "parent", final, "__at", known).select(
                F.col("node").alias("id"),
                F.coalesce("__to", "parent").alias("component"),
            )
        )
        known = nodes
    return labels


def components(nodes: DataFrame, edges: DataFrame, local_edges: int | None = None) -> DataFrame:
    """``(id, component)`` for every row of ``nodes(id)``, isolated ones included."""
    ends = edges.select(F.col("left").alias("a"), F.col("right").alias("b"))
    labels = edge_components(ends, local_edges).withColumnRenamed("id", "__id")
    return nodes.join(labels, nodes["id"] == labels["__id"], "left").select(
        nodes["id"], F.coalesce("component", nodes["id"]).alias("component")
    )


def component_count(labels: DataFrame) -> DataFrame:
    """Number of components; distinct labels are reduced before they are counted."""
    return labels.select("component").distinct().agg(F.count(F.lit(1)).alias("components"))


def connected(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each ``(u, v)`` whether both lie in one component. Unknown ids give null."""
    labels = cut(labels)
    count = labels.count()
    for end, name in (("u", "cu"), ("v", "cv")):
        named = labels.select("id", F.col("component").alias(name))
        pairs = lookup(pairs, end, named, "id", count)
    return pairs.select("u", "v", (F.col("cu") == F.col("cv")).alias("connected"))
