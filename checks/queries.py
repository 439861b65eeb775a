"""One query per operator over the test tables, for the side-by-side check.

Every query reads whole tables. Trees used by several queries are kept per session.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import points as P
from arbora.operators import (
    blocks,
    components,
    edges,
    features,
    hierarchy,
    pairs,
    silhouette,
    spanning,
)
from arbora.operators.agglomerate import agglomerate
from arbora.plans import adjacency, clusters
from arbora.plans.trees import mst
from arbora.runtime import cut
from arbora.sources import points_bin, tables

# Codes of the market segments (fixed values); MACHINERY is left unmapped on purpose.
SEGMENT_CODES = {"AUTOMOBILE": 0.0, "BUILDING": 1.0, "FURNITURE": 2.0, "HOUSEHOLD": 3.0}
# All segments, for the queries over every customer.
ALL_CODES = SEGMENT_CODES | {"MACHINERY": 4.0}
# Limits far below the tables' sizes, so that the distributed ways are taken.
FEW_EDGES, FEW_RANKS, FEW_CLUSTERS = 100, 50, 200
CUSTOMER_SCHEMA = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
# Supplier keys are shifted by this much where parts and suppliers are nodes of one graph.
SUPPLIER_BASE = 1_000_000_000
# And return flags by so much, times their letter.
FLAG_BASE = 10_000_000_000

_KEPT: dict = {}


def kept(spark: SparkSession, sf: str, name: str, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _KEPT:
        _KEPT[key] = cut(make())
    return _KEPT[key]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder next to the session's checkpoints, which every executor can reach."""
    cut(spark.range(1))
    folder = spark.sparkContext.getCheckpointDir().replace("file:/", "file:///", 1)
    return f"{folder}/table-{uuid.uuid4().hex}"


def emb(spark, sf):
    return features.array_points(table(spark, sf, "embeddings"), "vec_id", "embedding")


def coded(spark, sf):
    raw = table(spark, sf, "customer")
    return features.encode_category(raw, "c_mktsegment", SEGMENT_CODES)


def cust(spark, sf):
    """Every customer as a point."""
    raw = features.encode_category(table(spark, sf, "customer"), "c_mktsegment", ALL_CODES)
    rows = raw.withColumn("balance", F.col("c_acctbal") / 1000)
    return features.assemble_points(rows, ["c_mktsegment", "balance", "c_nationkey"], "c_custkey")


def tied(spark, sf):
    return features.assemble_points(table(spark, sf, "part"), ["p_size"], "p_partkey")


def supply(spark, sf):
    """Edges between parts and suppliers, from every line item."""
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("left"),
        (F.col("l_suppkey") + SUPPLIER_BASE).alias("right"),
        F.col("l_extendedprice").alias("weight"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"),
    )


def block_number(spark, sf) -> int:
    """Blocks of about 100 vectors: the number grows with the table."""
    return max(1, -(-table(spark, sf, "embeddings").count() // 100))


def blocked(spark, sf):
    s = block_number(spark, sf)
    return blocks.assign_blocks(emb(spark, sf), s, by="id"), s


def tree(spark, sf):
    return kept(spark, sf, "tree", lambda: mst(emb(spark, sf)))


def subtrees(spark, sf):
    """Trees of all subgraphs. They grow with the square of the table, so they are not stored."""
    return spanning.subgraph_mst(*blocked(spark, sf))


def subtree_lists(spark, sf):
    """The edges of all subgraphs, listed in the tasks that find them unless a block was split."""
    points, s = blocked(spark, sf)
    return spanning.edges_by_subgraph(spanning.subgraph_mst(points, s, listed=spanning.blocks_fit(points)))


def merge_table(spark, sf):
    def make():
        _, dense, n = hierarchy.dense_nodes(emb(spark, sf), tree(spark, sf))
        return hierarchy.linkage(dense, n)

    return kept(spark, sf, "linkage", make)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns or ("weight",):
        df = df.withColumn(c, F.round(c, digits))
    return df


def facts(df: DataFrame) -> DataFrame:
    """Points as plain columns: a row per id and coordinate."""
    return df.select("id", F.posexplode("coords").alias("pos", "x")).withColumn("x", F.round("x", 6))


# Scans, sources, sinks


def a1(spark, sf):
    path = scratch(spark)
    table(spark, sf, "customer").write.option("header", True).csv(path)
    schema = spark.createDataFrame([], CUSTOMER_SCHEMA).schema
    return tables.read_csv(spark, path, schema)


def a2(spark, sf):
    path = scratch(spark)
    points_bin.write_points_bin(emb(spark, sf), path)
    return facts(points_bin.read_points_bin(spark, path))


def flow(spark, sf):
    """CSV to points, to parquet by block, to a tree of every customer."""
    source, target = scratch(spark), scratch(spark)
    table(spark, sf, "customer").select(
        "c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey"
    ).write.option("header", True).csv(source)
    schema = "c_custkey long, c_mktsegment string, c_acctbal double, c_nationkey int"
    schema = spark.createDataFrame([], schema).schema
    raw = features.encode_category(tables.read_csv(spark, source, schema), "c_mktsegment", ALL_CODES)
    clean = features.to_double(features.drop_incomplete(raw).withColumn("key", F.col("c_custkey")))
    numbered = features.with_dense_id(clean, ["key"])
    tables.write_points(features.assemble_points(numbered, ["c_mktsegment", "c_acctbal", "c_nationkey"]), target, 4, by="id")
    return rounded(mst(tables.read_points(spark, target).select("id", "coords")))


def a3(spark, sf):
    path = scratch(spark)
    points_bin.write_points_bin(tied(spark, sf), path)
    return points_bin.read_points_bin(spark, path).select("id", F.col("coords")[0].alias("x"))


def a4(spark, sf):
    path = scratch(spark)
    tables.write_points(emb(spark, sf), path, 4, by="id")
    stored = tables.read_points(spark, path)
    return stored.select("block", "id", F.posexplode("coords").alias("pos", "x")).withColumn("x", F.round("x", 6))


def a5(spark, sf):
    path = scratch(spark)
    tables.write_points(emb(spark, sf), path, 4, by="id")
    stored = tables.read_points(spark, path, blocks=[1, 2])
    return facts(stored)


def a6(spark, sf):
    path = scratch(spark)
    tables.write_points_text(emb(spark, sf), path)
    return facts(tables.read_points_text(spark, path))


def a8(spark, sf):
    path = scratch(spark)
    tables.write_edges(tree(spark, sf), path)
    return tables.edge_lines(tables.read_edges(spark, path))


# Projections, filters, featurization


def b2(spark, sf):
    return coded(spark, sf).select("c_custkey", F.col("c_mktsegment").alias("segment"))


def holed(spark, sf):
    """Customers with null and NaN balances here and there."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    holes = F.when(key % 7 == 0, None).when(key % 11 == 0, float("nan")).otherwise(balance)
    return coded(spark, sf).withColumn("c_acctbal", holes)


def b1(spark, sf):
    return features.drop_incomplete(holed(spark, sf)).select(
        "c_custkey", F.col("c_mktsegment").alias("segment"), "c_acctbal"
    )


def b3(spark, sf):
    return features.to_double(coded(spark, sf).select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"))


def b4(spark, sf):
    return features.drop_columns(table(spark, sf, "customer"), "c_custkey", "c_name")


def b5(spark, sf):
    x = F.col("coords")
    rows = features.drop_incomplete(coded(spark, sf)).withColumn("balance", F.col("c_acctbal") / 1000)
    points = features.assemble_points(rows, ["c_mktsegment", "balance", "c_nationkey"], "c_custkey")
    return points.select(
        "id", x[0].alias("segment"), F.round(x[1], 6).alias("balance"), x[2].alias("nation")
    )


def b6(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return features.with_dense_id(rows, ["c_acctbal", "c_custkey"])


def b7(spark, sf):
    return facts(features.first_points(emb(spark, sf), 100))


def b8(spark, sf):
    return facts(features.first_dims(emb(spark, sf), 16))


def b9(spark, sf):
    lists = subtree_lists(spark, sf)
    return rounded(features.edge_columns(lists, "edges"))


def b10(spark, sf):
    return features.profile(emb(spark, sf))


def b11(spark, sf):
    return facts(features.preview(emb(spark, sf), 5))


# Blocks and subgraphs


def c1(spark, sf):
    return blocked(spark, sf)[0].select("id", "block")


def c2(spark, sf):
    s = F.ceil(F.count(F.lit(1)) / 100)
    return table(spark, sf, "embeddings").agg(s.alias("blocks"), blocks.subgraph_count(s).alias("subgraphs"))


def c3(spark, sf):
    return blocks.subgraph_plan(spark, block_number(spark, sf)).withColumnRenamed("left", "low").withColumnRenamed(
        "right", "high"
    )


def c4(spark, sf):
    return blocks.points_by_subgraph(*blocked(spark, sf)).select("subgraph", "side", "id")


def c5(spark, sf):
    return blocks.block_subgraph_sizes(*blocked(spark, sf))


def c5_delivered(spark, sf):
    return blocks.subgraph_sizes(blocks.points_by_subgraph(*blocked(spark, sf)))


# Distances and pairings


def neighbours(spark, sf):
    """Each vector with the one that has the next id."""
    a = emb(spark, sf)
    b = a.select((F.col("id") - 1).alias("at"), F.col("id").alias("id_b"), F.col("coords").alias("coords_b"))
    return a.join(b, a["id"] == b["at"])


def d1(spark, sf):
    w = P.euclidean(F.col("coords"), F.col("coords_b"))
    return neighbours(spark, sf).select("id", F.round(w, 6).alias("weight"))


def d2(spark, sf):
    both = F.explode(F.array(F.lit(0), F.lit(1))).alias("step")
    rows = neighbours(spark, sf).select("id", "coords", "coords_b", both)
    w = P.distance(F.col("id"), F.col("coords"), F.col("id") + F.col("step"), F.col("coords_b"))
    return rows.select("id", "step", F.round(w, 6).alias("weight"))


def pair_facts(df):
    return rounded(rounded(df, "shortest", "longest"), "total", digits=4)


def d3(spark, sf):
    return pair_facts(pairs.pairs_within(*blocked(spark, sf)))


def d4(spark, sf):
    return pair_facts(pairs.pairs_between(*blocked(spark, sf)))


def d5(spark, sf):
    return pair_facts(pairs.united(pairs.complete_graph(*blocked(spark, sf))))


def d6(spark, sf):
    data, s = blocked(spark, sf)
    found = spanning.nearest_outside(data.withColumn("component", F.col("id")), s)
    return rounded(found.select(F.col("node").alias("id"), F.col("to").alias("nearest"), "weight"))


def d7(spark, sf):
    return emb(spark, sf).select("id", P.dimension(F.col("coords")).alias("dim"))


def d8(spark, sf):
    other = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id_b"),
        F.transform(F.col("embedding").cast("array<double>"), lambda c: c + F.col("label") % 2).alias("coords_b"),
    )
    joined = emb(spark, sf).join(other, F.col("id") == F.col("id_b"))
    same = P.same_point(F.col("id"), F.col("coords"), F.col("id_b"), F.col("coords_b"))
    return joined.select("id", same.alias("same"))


def d9(spark, sf):
    return emb(spark, sf).select("id", P.point_hash(F.col("id"), F.col("coords")).alias("hash"))


# Spanning trees


def e1(spark, sf):
    return rounded(spanning.clique_mst(*blocked(spark, sf)))


def e2(spark, sf):
    return rounded(spanning.bipartite_mst(*blocked(spark, sf)))


def e3(spark, sf):
    return rounded(subtrees(spark, sf))


def e4(spark, sf):
    u, v = F.col("l_suppkey"), F.col("l_partkey")
    return table(spark, sf, "lineitem").select(*P.canonical_edge(u, v, F.col("l_quantity")))


def e5(spark, sf):
    return rounded(spanning.sort_edges(tree(spark, sf)))


def e6(spark, sf):
    lists = subtree_lists(spark, sf)
    first, last = F.element_at("edges", 1), F.element_at("edges", -1)
    return lists.select(
        "subgraph",
        F.size("edges").alias("edges"),
        first["left"].alias("first_left"),
        F.round(first["weight"], 6).alias("lightest"),
        last["right"].alias("last_right"),
        F.round(last["weight"], 6).alias("heaviest"),
    )


def e7(spark, sf):
    return rounded(spanning.merge_msts(blocks.regroup(subtrees(spark, sf), 4)))


def e7_rounds(spark, sf):
    return rounded(spanning.merge_msts(blocks.regroup(subtrees(spark, sf), 4), FEW_EDGES))


def e9_rounds(spark, sf):
    s = block_number(spark, sf)
    return rounded(spanning.merge_tree(subtrees(spark, sf), 4, blocks.subgraph_count(s), FEW_EDGES))


def e12_rounds(spark, sf):
    return rounded(spanning.mst_of_edges(supply(spark, sf), FEW_EDGES))


def e8(spark, sf):
    return edges.edge_counts(blocks.regroup(subtrees(spark, sf), 4))


def e9(spark, sf):
    s = block_number(spark, sf)
    return rounded(spanning.merge_tree(subtrees(spark, sf), 4, blocks.subgraph_count(s)))


def e10(spark, sf):
    return rounded(mst(emb(spark, sf), blocks=4, k=4))


def e10_auto(spark, sf):
    return rounded(mst(emb(spark, sf)))


def e10_pruned(spark, sf):
    return rounded(mst(cust(spark, sf), block_points=300))


def e10_tied(spark, sf):
    return mst(tied(spark, sf))


def e11(spark, sf):
    return rounded(spanning.mst_direct(emb(spark, sf)))


def e11_pruned(spark, sf):
    return rounded(spanning.mst_direct(cust(spark, sf), blocks=24))


def e12(spark, sf):
    return rounded(spanning.mst_of_edges(supply(spark, sf)))


# Components


def near_edges(spark, sf):
    return tree(spark, sf).where(F.col("weight") < 1.2)


def forest_labels(spark, sf):
    return components.components(emb(spark, sf).select("id"), near_edges(spark, sf))


def f1(spark, sf):
    return forest_labels(spark, sf)


def f1_supply(spark, sf, local_edges=None):
    """Components of the graph of every line item, in which each return flag is a graph of its own."""
    flag = F.ascii("l_returnflag").cast("long") * FLAG_BASE
    lines = table(spark, sf, "lineitem").select(
        (F.col("l_partkey") + flag).alias("left"), (F.col("l_suppkey") + SUPPLIER_BASE + flag).alias("right")
    )
    nodes = lines.select(F.explode(F.array("left", "right")).alias("id")).distinct()
    return components.components(nodes, lines, local_edges)


def f1_rounds(spark, sf):
    return f1_supply(spark, sf, FEW_EDGES)


def f2(spark, sf):
    return components.component_count(forest_labels(spark, sf))


def f3(spark, sf):
    chain = emb(spark, sf).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    return components.connected(chain, forest_labels(spark, sf))


def f4(spark, sf):
    return spanning.non_cycle_edges(supply(spark, sf), "place")


def f4_rounds(spark, sf):
    return spanning.non_cycle_edges(supply(spark, sf), "place", FEW_EDGES)


# Edge aggregates


def g1(spark, sf):
    return edges.edge_counts(subtrees(spark, sf))


def g2(spark, sf):
    return rounded(edges.first_edges(subtrees(spark, sf), 3))


def g3(spark, sf):
    return rounded(edges.total_weight(tree(spark, sf)), "total_weight")


def g4(spark, sf):
    return edges.graph_size(tree(spark, sf))


def g4_supply(spark, sf):
    return edges.graph_size(supply(spark, sf))


def g5(spark, sf):
    """The tree against itself from other blocks, and against graphs that differ in one way."""
    own = tree(spark, sf)
    first = F.col("left") == own.agg(F.min("left")).first()[0]
    others = {
        "other blocks": mst(emb(spark, sf), blocks=3),
        "other weights": own.withColumn("weight", F.col("weight") * 1.001),
        "an edge more": own.unionAll(own.selectExpr("left", "right + 1 as right", "0d as weight").limit(1)),
        "fewer nodes": own.where(~first),
    }
    found = [edges.compare_graphs(own, g).withColumn("against", F.lit(name)) for name, g in others.items()]
    return reduce(DataFrame.unionAll, found)


def g6(spark, sf):
    cliques = subtrees(spark, sf).where(F.col("subgraph") >= blocks.subgraph_count(block_number(spark, sf)) - block_number(spark, sf))
    return rounded(edges.edge_diff(tree(spark, sf), cliques))


# Hierarchy


def h1(spark, sf):
    return rounded(edges.adjacency(kept(spark, sf, "tied", lambda: mst(tied(spark, sf)))), "value")


def h2(spark, sf):
    s = block_number(spark, sf)
    rows = adjacency.adjacency_rows(emb(spark, sf), tree(spark, sf))
    found = adjacency.adjacency_row_pairs(blocks.assign_blocks(rows, s, by="id"), s)
    return pair_facts(found)


def h2_tree(spark, sf):
    """The weights of the tree, lightest first."""
    weights = adjacency.row_tree(emb(spark, sf), tree(spark, sf)).select("weight", "left", "right")
    numbered = features.with_dense_id(weights, ["weight", "left", "right"], name="place")
    return rounded(numbered.select("place", "weight"), digits=4)


def h3(spark, sf):
    return rounded(merge_table(spark, sf), "height")


def h3_levels(spark, sf):
    _, dense, n = hierarchy.dense_nodes(emb(spark, sf), tree(spark, sf))
    return rounded(hierarchy.linkage(dense, n, FEW_RANKS), "height")


def h4(spark, sf, method="average", final_clusters=None):
    n = emb(spark, sf).count()
    return rounded(agglomerate(emb(spark, sf), n, method, final_clusters), "height")


def h4_rounds(spark, sf):
    return h4(spark, sf, final_clusters=FEW_CLUSTERS)


def h4_tied(spark, sf):
    """Average linkage of parts by size: 50 places, many of them equally far apart."""
    rows = features.with_dense_id(tied(spark, sf).withColumnRenamed("id", "key"), ["key"]).select("id", "coords")
    n = rows.count()
    once = agglomerate(rows, n)
    again = agglomerate(rows, n, final_clusters=20, block_points=16)
    # Heights come in full, and sums of distances may differ in the last bit.
    once, again = (cut(df.withColumn("height", F.round("height", 9))) for df in (once, again))
    same = once.exceptAll(again).isEmpty() and again.exceptAll(once).isEmpty()
    heights = rounded(once.groupBy("height").agg(F.count(F.lit(1)).alias("steps")), "height")
    return heights.withColumn("same", F.lit(same))


def h5(spark, sf):
    n = emb(spark, sf).count()
    return rounded(adjacency.adjacency_linkage(emb(spark, sf), tree(spark, sf), n, "average"), "height")


def h5_rounds(spark, sf):
    """Some rounds, then the last task: most rows are nearest to a few short ones, so that later
    rounds merge only a few pairs each."""
    n = emb(spark, sf).count()
    merges = adjacency.adjacency_linkage(emb(spark, sf), tree(spark, sf), n, "average", final_clusters=n * 7 // 10)
    return rounded(merges, "height")


def h6(spark, sf):
    n = emb(spark, sf).count()
    return rounded(hierarchy.dendrogram_layout(merge_table(spark, sf), n, "right"), "x", "y")


def h7(spark, sf):
    return hierarchy.cut_tree(emb(spark, sf), tree(spark, sf), n_clusters=10)


def h8(spark, sf):
    return hierarchy.cut_tree(emb(spark, sf), tree(spark, sf), threshold=1.15)


def h9(spark, sf):
    return hierarchy.labels(h7(spark, sf))


def h10(spark, sf):
    return clusters.cluster_points(cust(spark, sf), n_clusters=5)


def h10_average(spark, sf):
    return clusters.cluster_points(emb(spark, sf), n_clusters=7, method="average")


def h11_threshold(spark, sf):
    n = emb(spark, sf).count()
    return hierarchy.cut_linkage(merge_table(spark, sf), n, threshold=1.15)


def h11(spark, sf):
    n = emb(spark, sf).count()
    return hierarchy.cut_linkage(merge_table(spark, sf), n, n_clusters=10)


def h12(spark, sf):
    return hierarchy.cluster_sizes(h9(spark, sf))


# Evaluation


def given_labels(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")


def i1(spark, sf):
    return rounded(silhouette.silhouette(emb(spark, sf), given_labels(spark, sf)), "silhouette")


def i2(spark, sf):
    n = emb(spark, sf).count()
    found = adjacency.adjacency_silhouette(emb(spark, sf), tree(spark, sf), n, n_clusters=3)
    return rounded(found, "silhouette")


def i2_average(spark, sf):
    n = emb(spark, sf).count()
    found = adjacency.adjacency_silhouette(emb(spark, sf), tree(spark, sf), n, n_clusters=5, method="average")
    return rounded(found, "silhouette")


def i2_threshold(spark, sf):
    n = emb(spark, sf).count()
    found = adjacency.adjacency_silhouette(emb(spark, sf), tree(spark, sf), n, threshold=2.5)
    return rounded(found, "silhouette")


def i3(spark, sf):
    found = silhouette.silhouette_fast(emb(spark, sf), given_labels(spark, sf))
    return rounded(found, "silhouette_squared")


QUERIES = {
    "a1_read_csv": a1,
    "a2_read_points_bin": a2,
    "a3_write_points_bin": a3,
    "a4_write_points": a4,
    "a5_read_points": a5,
    "a6_points_text": a6,
    "a8_edges_text": a8,
    "a9_csv_to_tree": flow,
    "b1_drop_incomplete": b1,
    "b2_encode_category": b2,
    "b3_to_double": b3,
    "b4_drop_columns": b4,
    "b5_assemble_points": b5,
    "b6_with_dense_id": b6,
    "b7_first_points": b7,
    "b8_first_dims": b8,
    "b9_edge_columns": b9,
    "b10_profile": b10,
    "b11_preview": b11,
    "c1_assign_blocks": c1,
    "c2_subgraph_count": c2,
    "c3_subgraph_plan": c3,
    "c4_points_by_subgraph": c4,
    "c5_subgraph_sizes": c5,
    "c5_subgraph_sizes_delivered": c5_delivered,
    "d1_euclidean": d1,
    "d2_distance": d2,
    "d3_pairs_within": d3,
    "d4_pairs_between": d4,
    "d5_complete_graph": d5,
    "d6_nearest_outside": d6,
    "d7_dimension": d7,
    "d8_same_point": d8,
    "d9_point_hash": d9,
    "e1_clique_mst": e1,
    "e2_bipartite_mst": e2,
    "e3_subgraph_mst": e3,
    "e4_canonical_edge": e4,
    "e5_sort_edges": e5,
    "e6_edges_by_subgraph": e6,
    "e7_merge_msts": e7,
    "e7_merge_msts_rounds": e7_rounds,
    "e8_regroup": e8,
    "e9_merge_tree": e9,
    "e9_merge_tree_rounds": e9_rounds,
    "e10_mst": e10,
    "e10_mst_auto": e10_auto,
    "e10_mst_pruned": e10_pruned,
    "e10_mst_tied": e10_tied,
    "e11_mst_direct": e11,
    "e11_mst_direct_pruned": e11_pruned,
    "e12_mst_of_edges": e12,
    "e12_mst_of_edges_rounds": e12_rounds,
    "f1_components": f1,
    "f1_components_supply": f1_supply,
    "f1_components_rounds": f1_rounds,
    "f2_component_count": f2,
    "f3_connected": f3,
    "f4_non_cycle_edges": f4,
    "f4_non_cycle_edges_rounds": f4_rounds,
    "g1_edge_counts": g1,
    "g2_first_edges": g2,
    "g3_total_weight": g3,
    "g4_graph_size": g4,
    "g4_graph_size_supply": g4_supply,
    "g5_compare_graphs": g5,
    "g6_edge_diff": g6,
    "h1_adjacency": h1,
    "h2_adjacency_row_pairs": h2,
    "h2_adjacency_row_tree": h2_tree,
    "h3_linkage": h3,
    "h3_linkage_levels": h3_levels,
    "h4_agglomerate": h4,
    "h4_agglomerate_rounds": h4_rounds,
    "h4_agglomerate_tied": h4_tied,
    "h4_complete": lambda spark, sf: h4(spark, sf, "complete"),
    "h4_weighted": lambda spark, sf: h4(spark, sf, "weighted"),
    "h4_ward": lambda spark, sf: h4(spark, sf, "ward"),
    "h5_adjacency_linkage": h5,
    "h5_adjacency_linkage_rounds": h5_rounds,
    "h6_dendrogram_layout": h6,
    "h7_cut_clusters": h7,
    "h8_cut_threshold": h8,
    "h9_labels": h9,
    "h10_cluster_points": h10,
    "h10_cluster_points_average": h10_average,
    "h11_cut_linkage": h11,
    "h11_cut_linkage_threshold": h11_threshold,
    "h12_cluster_sizes": h12,
    "i1_silhouette": i1,
    "i2_adjacency_silhouette": i2,
    "i2_adjacency_silhouette_average": i2_average,
    "i2_adjacency_silhouette_threshold": i2_threshold,
    "i3_silhouette_fast": i3,
}
