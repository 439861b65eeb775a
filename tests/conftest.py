import math
import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from arbora.schema import POINTS  # noqa: E402

P6 = [
    (0, [0.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 3.0]),
    (3, [10.0, 0.0]), (4, [10.0, 2.0]), (5, [20.0, 5.0]),
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def p6(spark):
    return spark.createDataFrame(P6, POINTS)


@pytest.fixture
def points(spark):
    """Make a points table from coordinates, with any ids."""

    def make(coords, ids=None):
        ids = range(len(coords)) if ids is None else ids
        rows = [(int(i), [float(c) for c in x]) for i, x in zip(ids, coords)]
        return spark.createDataFrame(rows, POINTS)

    return make


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def all_distances(coords):
    coords = np.asarray(coords, dtype=float)
    return np.sqrt(((coords[:, None] - coords[None]) ** 2).sum(-1))


def kruskal(edges):
    """Spanning forest of ``(left, right, weight)`` edges in the tie order."""
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    kept = []
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b, w))
    return sorted(kept)


def brute_tree(coords, ids):
    edges = []
    for i in range(len(ids)):
        for j in range(i + 1, len(ids)):
            total = 0.0
            for p, q in zip(coords[i], coords[j]):
                total += (p - q) * (p - q)
            edges.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j])), math.sqrt(total)))
    return kruskal(edges)
