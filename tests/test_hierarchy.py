import numpy as np
import pytest

from arbora.operators import hierarchy
from arbora.plans import clusters
from arbora.plans.trees import mst
from tests.conftest import rows

P6_STEPS = [
    (0, 0, 1, 1.0, 2), (1, 2, 6, 2.0, 3), (2, 3, 4, 2.0, 2), (3, 7, 8, 10.0, 5), (4, 5, 9, 109**0.5, 6),
]


def sequential(edges, n):
    parent, size, steps = list(range(2 * n)), [1] * (2 * n), []

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for t, (w, a, b) in enumerate(sorted((w, a, b) for a, b, w in edges)):
        x, y = sorted((root(a), root(b)))
        parent[x] = parent[y] = n + t
        size[n + t] = size[x] + size[y]
        steps.append((t, x, y, w, size[n + t]))
    return steps


def test_golden_merge_table(p6):
    assert rows(clusters.points_linkage(p6)) == P6_STEPS
    assert rows(clusters.points_linkage(p6, leaf_edges=2)) == P6_STEPS


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_bisected_ranks_give_the_sequential_table(spark, shape):
    rng, n = np.random.default_rng(2), 48
    up = {"random": lambda i: rng.integers(0, i), "chain": lambda i: i - 1, "star": lambda i: 0}[shape]
    edges = [(int(up(i)), i, float(rng.integers(0, 9))) for i in range(1, n)]
    df = spark.createDataFrame(edges, "left long, right long, weight double")
    assert rows(hierarchy.linkage(df, n, leaf_edges=12)) == sequential(edges, n)


@pytest.mark.parametrize("top_edges", [10_000, 0])
def test_cuts_and_labels(p6, monkeypatch, top_edges):
    monkeypatch.setattr(hierarchy, "TOP_EDGES", top_edges)
    tree = mst(p6)

    def cut(**by):
        return [c for _, c in rows(hierarchy.cut_tree(p6, tree, **by))]

    assert cut(n_clusters=3) == [0, 0, 0, 3, 3, 5]
    assert cut(threshold=10.0) == [0, 0, 0, 3, 3, 5]
    assert cut(threshold=11.0) == cut(n_clusters=1) == [0] * 6
    assert cut(n_clusters=6) == list(range(6))
    labelled = hierarchy.labels(hierarchy.cut_tree(p6, tree, n_clusters=3))
    assert [c for _, c in rows(labelled)] == [0, 0, 0, 1, 1, 2]
    assert rows(hierarchy.cluster_sizes(labelled)) == [(0, 3), (1, 2), (2, 1)]
    for bad in ({}, {"n_clusters": 2, "threshold": 1.0}, {"n_clusters": 0}, {"n_clusters": 7}):
        with pytest.raises(ValueError):
            cut(**bad)


def test_cutting_the_merge_table_agrees_with_cutting_the_tree(p6):
    table = clusters.points_linkage(p6)
    for k in (1, 2, 4, 6):
        assert rows(hierarchy.cut_linkage(table, 6, n_clusters=k)) == rows(
            hierarchy.cut_tree(p6, mst(p6), n_clusters=k)
        )
    assert [c for _, c in rows(hierarchy.cut_linkage(table, 6, threshold=10.0))] == [0, 0, 0, 3, 3, 5]
    with pytest.raises(ValueError):
        hierarchy.cut_linkage(table, 6)


def test_layout_places_every_cluster_over_its_leaves(spark):
    rng, n = np.random.default_rng(8), 20
    edges = [(int(rng.integers(0, i)), i, float(i % 7)) for i in range(1, n)]
    steps = sequential(edges, n)
    table = spark.createDataFrame(steps, "step long, child_a long, child_b long, height double, size long")
    got = {r.node: r for r in hierarchy.dendrogram_layout(table, n).collect()}
    first = {2 * n - 2: 0}
    size = {i: 1 for i in range(n)} | {n + t: s for t, _, _, _, s in steps}
    for t, a, b, *_ in reversed(steps):
        first[a], first[b] = first[n + t], first[n + t] + size[a]
    assert {k: r["first"] for k, r in got.items()} == first
    assert all(r.x == r["first"] * 10 + r["size"] * 5 for r in got.values())
    turned = {r.node: r for r in hierarchy.dendrogram_layout(table, n, "left").collect()}
    assert all(turned[k].y == r.x and turned[k].x == -r.y for k, r in got.items())


def test_clusters_of_sparse_ids(points):
    table = points([[0.0], [1.0], [10.0], [11.0]], [40, 7, 90, 12])
    assert rows(clusters.cluster_points(table, n_clusters=2)) == [(7, 0), (12, 1), (40, 0), (90, 1)]
    assert rows(clusters.cluster_points(table, n_clusters=2, method="complete")) == [(7, 0), (12, 1), (40, 0), (90, 1)]
    assert rows(clusters.cluster_points(table, threshold=0.5))[-1] == (90, 3)
