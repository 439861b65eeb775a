import numpy as np
import pytest
from pyspark import TaskContext

from arbora.operators import agglomerate as rounds
from arbora.operators import kernels
from arbora.operators.agglomerate import agglomerate
from arbora.plans import adjacency
from arbora.operators.hierarchy import cut_linkage
from arbora.plans.trees import mst
from tests.conftest import all_distances, kruskal, rows


def greedy(d, method):
    n = len(d)
    d, size, name, live, steps = d.copy(), [1] * n, list(range(n)), set(range(n)), []
    for t in range(n - 1):
        h, i, j = min((d[i, j], i, j) for i in live for j in live if i < j)
        for k in live - {i, j}:
            a, b, si, sj, sk = d[i, k], d[j, k], size[i], size[j], size[k]
            d[i, k] = d[k, i] = {
                "single": min(a, b),
                "complete": max(a, b),
                "average": (si * a + sj * b) / (si + sj),
                "weighted": (a + b) / 2,
                "ward": (max(0.0, (si + sk) * a * a + (sj + sk) * b * b - sk * h * h) / (si + sj + sk)) ** 0.5,
            }[method]
        size[i] += size[j]
        live.remove(j)
        steps.append((t, min(name[i], name[j]), max(name[i], name[j]), round(float(h), 6), size[i]))
        name[i] = n + t
    return steps


def table(df):
    return [(a, b, c, round(h, 6), s) for a, b, c, h, s in rows(df)]


@pytest.mark.parametrize("method", kernels.METHODS)
def test_rounds_give_the_greedy_table(points, method):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(36, 3))
    x[24:] = x[5]
    got = agglomerate(points(x), 36, method, final_clusters=12, block_points=9)
    assert table(got) == greedy(all_distances(x), method)


@pytest.mark.parametrize("method", kernels.METHODS)
def test_the_final_task_gives_the_greedy_table(method):
    d = all_distances(np.random.default_rng(9).normal(size=(25, 3)))
    a, b = np.triu_indices(25, 1)
    merges = kernels.merge_matrix(method, np.arange(25), np.ones(25), a, b, d[a, b])
    got = [(round(float(h), 6), int(s)) for _, _, h, s in merges]
    assert got == [(h, s) for *_, h, s in greedy(d, method)]


def test_small_and_refused_inputs(points):
    assert table(agglomerate(points([[1.0]]), 1)) == []
    assert table(agglomerate(points([[1.0], [1.0]]), 2)) == [(0, 0, 1, 0.0, 2)]
    with pytest.raises(ValueError):
        agglomerate(points([[1.0]]), 1, "centroid")


def matrix(tree, n):
    a = np.zeros((n, n))
    for left, right, weight in tree:
        a[left, right] = a[right, left] = weight
    return a


def test_golden_adjacency_rows(p6):
    tree = mst(p6)
    got = [(a, b, round(w, 6)) for a, b, w in rows(adjacency.row_tree(p6, tree))]
    assert got == [(0, 2, 10.049876), (1, 2, 3.0), (1, 3, 9.433981), (2, 4, 10.816654), (2, 5, 10.630146)]
    single = adjacency.adjacency_linkage(p6, tree, 6, "single")
    assert [c for _, c in rows(cut_linkage(single, 6, 3))] == [0, 0, 0, 0, 4, 5]
    assert round(adjacency.adjacency_silhouette(p6, tree, 6, n_clusters=3).first()[0], 6) == 0.134937
    want = greedy(all_distances(matrix(rows(tree), 6)), "average")
    assert table(adjacency.adjacency_linkage(p6, tree, 6, "average")) == want


def test_row_tree_of_a_hub_in_parts(spark, monkeypatch):
    rng, n = np.random.default_rng(6), 30
    tree = [(0, i, float(w)) for i, w in enumerate(rng.random(20) + 0.5, 1)]
    tree += [(int(rng.integers(0, i)), i, float(rng.random() + 0.5)) for i in range(21, n)]
    d = all_distances(matrix(tree, n))
    want = sum(e[2] for e in kruskal((i, j, d[i, j]) for i in range(n) for j in range(i + 1, n)))
    monkeypatch.setattr(adjacency, "BLOCK_POINTS", 6)
    found = adjacency.row_tree(spark.range(n), spark.createDataFrame(tree, "left long, right long, weight double"))
    got = rows(found)
    assert len(got) == n - 1 and abs(sum(e[2] for e in got) - want) < 1e-9


@pytest.mark.parametrize("method", [m for m in kernels.METHODS])
def test_ties_do_not_depend_on_limits(points, method):
    grid = [[float(i), float(j)] for i in range(5) for j in range(5)] + [[2.0, 2.0], [2.0, 2.0], [0.0, 4.0]]
    n = len(grid)
    once = table(agglomerate(points(grid), n, method))
    for final, block in ((6, None), (12, 8)):
        assert table(agglomerate(points(grid), n, method, final_clusters=final, block_points=block)) == once


def test_only_clusters_without_a_nearest_one_search_again(points):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(c, 0.2, size=(k, 2)) for c, k in ((0, 30), (9, 12), (30, 18))])
    report = []
    got = agglomerate(points(x), 60, final_clusters=18, block_points=16, report=report)
    assert table(got) == greedy(all_distances(x), "average")
    searched = report[:-1]  # the last entry is the final task
    assert searched[0]["pairs"] == 60 * 59 // 2
    assert all(r["searching"] < 60 and r["pairs"] < 60 * 59 // 2 for r in searched[1:])


def test_heights_are_given_in_full():
    x = np.random.default_rng(3).normal(size=(12, 5))
    d = all_distances(x)
    a, b = np.triu_indices(12, 1)
    merges = kernels.merge_matrix("average", np.arange(12), np.ones(12), a, b, d[a, b])
    assert merges[0][2] == d[a, b].min()


def test_rounds_on_adjacency_rows(points):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 3))
    tree = mst(points(x))
    want = greedy(all_distances(matrix(rows(tree), 30)), "average")
    report = []
    got = adjacency.adjacency_linkage(points(x), tree, 30, "average", final_clusters=15, block_points=9, report=report)
    assert table(got) == want and len(report) > 1


@pytest.mark.parametrize("method", ["average", "ward"])
def test_rows_that_are_all_nearest_to_one_take_few_rounds(spark, method):
    n = 32
    data = [(i, [i], [1.0 + 0.01 * i]) for i in range(n)]
    frame = spark.createDataFrame(data, "id long, cols array<long>, vals array<double>")
    d = all_distances(np.diag([v[0] for *_, v in data]))
    report = []
    got = agglomerate(frame, n, method, final_clusters=8, block_points=20, report=report)
    assert table(got) == greedy(d, method)
    assert len(report) < n // 4


@pytest.mark.parametrize("method", kernels.METHODS)
def test_a_table_that_empties_gives_the_greedy_table(method, monkeypatch):
    monkeypatch.setattr(kernels, "EMPTIED", 4)
    d = all_distances(np.random.default_rng(10).normal(size=(40, 3)))
    a, b = np.triu_indices(40, 1)
    merges = kernels.merge_matrix(method, np.arange(40), np.ones(40), a, b, d[a, b])
    assert [(round(float(h), 6), int(s)) for _, _, h, s in merges] == [(h, s) for *_, h, s in greedy(d, method)]


def test_tiles_are_solved_once(points, monkeypatch, tmp_path):
    def noted(*args, **kwargs):
        found = map_pairs(*args, **kwargs)

        def run(batches):
            with open(tmp_path / str(TaskContext.get().partitionId()), "a") as file:
                file.write(".")
            yield from batches

        return found.mapInArrow(run, found.schema)

    map_pairs = rounds.map_pairs
    monkeypatch.setattr(rounds, "map_pairs", noted)
    x = np.random.default_rng(13).normal(size=(40, 3))
    state, distinct, _ = rounds._start(points(x), ["coords"], 40)
    found = rounds._nearest(rounds._search(state, distinct, distinct, 4, 3), 4, "average", None)
    d = all_distances(x) + np.diag([np.inf] * 40)
    assert [(a, b) for a, _, b, _ in rows(found)] == list(enumerate(d.argmin(axis=1)))
    assert {f.read_text() for f in tmp_path.iterdir()} == {"."}


def test_ward_keeps_one_row_per_cluster(points):
    x = np.random.default_rng(14).normal(size=(48, 3))
    report = []
    got = agglomerate(points(x), 48, "ward", final_clusters=10, block_points=12, report=report)
    assert table(got) == greedy(all_distances(x), "ward")
    assert len(report) > 2 and all(r["searching"] <= r["clusters"] for r in report)


@pytest.mark.parametrize("method", ["complete", "average", "weighted"])
def test_few_clusters_of_many_rows_go_on_from_stored_linkages(points, method, monkeypatch):
    monkeypatch.setattr(rounds, "BAND", 5)
    x = np.random.default_rng(15).normal(size=(90, 3))
    x[80:] = x[3]
    report = []
    got = agglomerate(points(x), 90, method, final_clusters=4, block_points=20, report=report)
    assert table(got) == greedy(all_distances(x), method)
    # All rows are measured once more, then none.
    stored = [r["pairs"] for r in report if r["clusters"] * rounds.SHRUNK <= 80]
    assert len(stored) > 2 and stored[0] == 80 * 79 // 2 and not any(stored[1:])
