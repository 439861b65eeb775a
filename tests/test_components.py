import numpy as np
import pytest

from arbora.operators import components
from tests.conftest import rows


def brute(nodes, edges):
    label = {x: x for x in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted(label.items())


@pytest.mark.parametrize("shape", ["random", "path", "hub"])
def test_labels_with_and_without_distributed_rounds(spark, shape):
    rng = np.random.default_rng(5)
    edges = {
        "random": [(int(a), int(b)) for a, b in rng.integers(0, 60, size=(45, 2))],
        "path": [(i, i + 1) for i in range(40)],
        "hub": [(59, i) for i in range(0, 40)] + [(50, 51)],
    }[shape]
    nodes = spark.range(60)
    df = spark.createDataFrame(edges, "left long, right long")
    want = brute(range(60), edges)
    assert rows(components.components(nodes, df)) == want
    assert rows(components.components(nodes, df, local_edges=6)) == want


def test_counts_and_connections(spark):
    labels = components.components(
        spark.range(4), spark.createDataFrame([(0, 1), (2, 2)], "left long, right long")
    )
    assert components.component_count(labels).first()[0] == 3
    asked = spark.createDataFrame([(0, 1), (0, 2), (3, 9)], "u long, v long")
    assert {tuple(r) for r in components.connected(asked, labels).collect()} == {
        (0, 1, True), (0, 2, False), (3, 9, None),
    }
