"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8). Each
query is run to the end, its result written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from arbora.operators import hierarchy, silhouette, spanning  # noqa: E402
from arbora.operators.agglomerate import agglomerate  # noqa: E402
from arbora.plans import adjacency, clusters  # noqa: E402
from arbora.plans.trees import mst  # noqa: E402
from arbora.runtime import cut  # noqa: E402
from checks import queries as q  # noqa: E402


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if "spark.checkpoint.dir" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, make) -> None:
        start = time.time()
        make().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)

    points = cut(q.emb(spark, sf))
    n = points.count()
    # Starts the Python workers, so that the first query does not pay for them.
    spanning.subgraph_mst(points.limit(10).selectExpr("*", "0 as block"), 1).count()

    for s in (2, 4, 8):
        timed(f"e10_mst_s{s}", lambda s=s: mst(points, blocks=s))
    timed("e10_mst_auto", lambda: mst(points))
    tree = cut(mst(points))
    timed("h7_cut_clusters", lambda: hierarchy.cut_tree(points, tree, n_clusters=10))
    timed("h9_labels", lambda: hierarchy.labels(hierarchy.cut_tree(points, tree, n_clusters=10)))
    timed("h3_linkage", lambda: hierarchy.linkage(tree, n))
    timed("i1_silhouette", lambda: silhouette.silhouette(points, q.given_labels(spark, sf)))
    timed("h2_adjacency_row_tree", lambda: adjacency.row_tree(points, tree))
    timed("d5_complete_graph", lambda: q.d5(spark, sf))
    timed("e10_mst_customers", lambda: mst(q.cust(spark, sf)))
    timed("e10_mst_tied", lambda: mst(q.tied(spark, sf)))
    timed("h10_cluster_customers", lambda: clusters.cluster_points(q.cust(spark, sf), n_clusters=5))
    timed("e12_mst_of_line_items", lambda: spanning.mst_of_edges(q.supply(spark, sf)))
    timed("f1_components_of_line_items", lambda: q.f1_supply(spark, sf))
    timed("e12_mst_of_line_items_rounds", lambda: q.e12_rounds(spark, sf))
    timed("f1_components_of_line_items_rounds", lambda: q.f1_rounds(spark, sf))
    timed("h3_linkage_levels", lambda: hierarchy.linkage(tree, n, q.FEW_RANKS))
    timed("h4_average", lambda: agglomerate(points, n, "average"))
    timed("e11_mst_direct", lambda: spanning.mst_direct(points))
    timed("i3_silhouette_fast", lambda: silhouette.silhouette_fast(points, q.given_labels(spark, sf)))
    timed("c5_subgraph_sizes", lambda: q.c5(spark, sf))
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
