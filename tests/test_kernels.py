import math

import numpy as np
import pytest

from arbora.operators import kernels, tiles
from tests.conftest import brute_tree, kruskal


@pytest.mark.parametrize("dim", [1, 2, 7, 8, 9, 64, 130])
@pytest.mark.parametrize("n", [1, 2, 8, 9, 16, 100])
def test_distances_equal_a_running_sum_bit_for_bit(n, dim):
    rng = np.random.default_rng(n * 1000 + dim)
    x, y = rng.normal(size=(n, dim)), rng.normal(size=dim)
    want = []
    for point in x:
        total = 0.0
        for a, b in zip(point, y):
            total += (a - b) * (a - b)
        want.append(math.sqrt(total))
    wide, buf, out = np.zeros((dim, n + 13)), np.empty((dim, n + 13)), np.empty(n + 13)
    wide[:, :n] = x.T
    got = kernels.distances(wide[:, :n], y, buf[:, :n], out[:n])
    assert got.tolist() == want


def test_trees_of_tied_points_match_kruskal():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, dim = rng.integers(0, 25), rng.integers(1, 4)
        x = rng.integers(0, 4, size=(n, dim)).astype(float)
        ids = np.sort(rng.permutation(99)[:n])
        left, right, weight = kernels.spanning_tree((ids, x))
        assert sorted(zip(left, right, weight)) == brute_tree(x, ids)
        cut = rng.integers(0, n + 1)
        mixed = rng.permutation(n)
        mixed = np.concatenate([np.sort(mixed[:cut]), np.sort(mixed[cut:])])
        x, ids = x[mixed], ids[mixed]
        pair = [
            (int(min(ids[i], ids[j])), int(max(ids[i], ids[j])), float(np.sqrt(((x[i] - x[j]) ** 2).sum())))
            for i in range(cut)
            for j in range(cut, n)
        ]
        left, right, weight = kernels.spanning_tree((ids[:cut], x[:cut]), (ids[cut:], x[cut:]))
        assert sorted(zip(left, right, weight)) == kruskal(pair)


def test_forest_and_components_of_random_edges():
    rng = np.random.default_rng(1)
    for _ in range(100):
        m = rng.integers(1, 60)
        u, v = rng.integers(0, 30, m), rng.integers(30, 50, m)
        w = rng.integers(0, 5, m).astype(float)
        kept = kernels.forest(u, v, w, u, v)
        got = sorted(zip(u[kept].tolist(), v[kept].tolist(), w[kept].tolist()))
        assert got == kruskal(zip(u.tolist(), v.tolist(), w.tolist()))
        nodes, label = kernels.component_labels(u, v)
        named = dict(zip(nodes.tolist(), label.tolist()))
        assert all(named[a] == named[b] for a, b in zip(u.tolist(), v.tolist()))
        assert len(set(label.tolist())) == len(nodes) - len(kept)
        assert all(named[c] == c and c <= a for a, c in named.items())


def test_sparse_distances_equal_dense_ones():
    rng = np.random.default_rng(2)
    dense = rng.normal(size=(12, 9)) * (rng.random((12, 9)) < 0.3)

    def sparse(table):
        starts = np.concatenate([[0], np.cumsum((table != 0).sum(axis=1))])
        return starts, np.nonzero(table)[1], table[table != 0]

    got = np.array([r.copy() for r in kernels.sparse_distance_rows(sparse(dense[:5]), sparse(dense))])
    want = np.sqrt(((dense[:5, None] - dense[None]) ** 2).sum(-1))
    assert np.allclose(got, want, atol=1e-7)


def tile_kinds():
    rng = np.random.default_rng(4)
    sphere = rng.normal(size=(150, 16))
    yield sphere / np.linalg.norm(sphere, axis=1)[:, None]
    yield rng.normal(size=(150, 3)) * 0.01 + rng.integers(0, 5, (150, 1)) * 40.0
    yield rng.integers(0, 3, size=(150, 4)).astype(float)
    yield sphere[rng.integers(0, 12, 150)]
    yield sphere * 1e-4 + 1e6


def test_screened_trees_are_those_of_the_whole_table(monkeypatch):
    """Spread, clustered, tied, copied and shifted points; bit for bit."""
    for x in tile_kinds():
        ids, found = np.arange(150) * 3, []
        for least in (1, 1 << 60):
            monkeypatch.setattr(kernels, "SCREENED", least)
            trees = (
                kernels.spanning_tree((ids, x)),
                kernels.spanning_tree((ids[::2], x[::2]), (ids[1::2], x[1::2])),
            )
            found.append([sorted(zip(*(c.tolist() for c in t))) for t in trees])
        assert found[0] == found[1] and [len(t) for t in found[0]] == [149, 149]
        monkeypatch.setattr(kernels, "SCREENED", 1)
        radius = found[0][1][40][2]
        short = kernels.spanning_tree((ids[::2], x[::2]), (ids[1::2], x[1::2]), radius)
        assert {e for e in found[0][1] if e[2] <= radius} <= set(zip(*(c.tolist() for c in short)))


def test_screened_edges_out_of_components_are_those_of_the_whole_table(monkeypatch):
    rng = np.random.default_rng(5)
    for x in tile_kinds():
        ids = np.arange(150) * 3
        for component in (ids, rng.integers(0, 9, 150), np.where(rng.random(150) < 0.9, 0, ids)):
            sides = [
                tiles.Block(ids[part], np.ascontiguousarray(x[part]), None, {"component": component[part]})
                for part in (slice(0, 80), slice(80, None))
            ]
            got = []
            for least in (1, 1 << 60):
                monkeypatch.setattr(kernels, "SCREENED", least)
                found = [kernels.outgoing(sides[0]), kernels.outgoing(*sides)]
                got.append([{k: v.tolist() for k, v in f.items()} for f in found])
            assert got[0] == got[1]


def test_edges_of_repeated_ids_come_once(monkeypatch):
    x = np.random.default_rng(6).normal(size=(60, 5))
    ids, found = np.sort(np.concatenate([np.arange(60), np.arange(60)])), []
    for least in (1, 1 << 60):
        monkeypatch.setattr(kernels, "SCREENED", least)
        found.append(sorted(zip(*(c.tolist() for c in kernels.spanning_tree((ids, np.repeat(x, 2, axis=0)))))))
    assert found[0] == found[1]


def dense_block(x):
    return tiles.Block(np.arange(len(x)), x, None, {})


def test_distances_by_a_product_keep_the_bits_that_count():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 24)) + 5
    x[40:60] = x[20:40] + rng.normal(size=(20, 24)) * 1e-9
    left, right = dense_block(x[:50]), dense_block(x[40:])
    want = kernels.distance_table(left, right)
    got = kernels.point_distances(left, right)
    assert np.abs(got - want).max() <= 1e-12 * want.max()
    near = want < 1e-6
    assert near.any() and (got[near] == want[near]).all()


def test_steady_rounds_to_half_even():
    x = np.array([0.0, 1.0, 1 + 2.0**-32, 1 + 3 * 2.0**-32, 1 / 3, 1e300, np.inf])
    part, power = np.frexp(x)
    assert (kernels.steady(x) == np.ldexp(np.rint(np.ldexp(part, 32)), power - 32)).all()


def test_merges_stop_at_a_bound():
    d = np.sqrt(((np.random.default_rng(2).normal(size=(40, 1, 3)) - np.random.default_rng(2).normal(size=(1, 40, 3))) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    every = list(kernels.merge_table("average", np.ones(40), d.copy()))
    some = list(kernels.merge_table("average", np.ones(40), d.copy(), every[20][2]))
    assert len(every) == 39 and some == every[:20]


def test_linkages_that_are_no_numbers_merge_first():
    d = np.array([[np.inf, 1.0, np.nan], [1.0, np.inf, np.nan], [np.nan, np.nan, np.inf]])
    merges = list(kernels.merge_table("average", np.ones(3), d.copy()))
    assert [(i, j, size) for i, j, _, size in merges] == [(0, 2, 2), (0, 1, 3)]
    assert list(kernels.merge_table("average", np.ones(3), d.copy(), 9.0)) == []


def test_trees_of_many_tiles_are_those_of_each():
    rng = np.random.default_rng(12)
    solo = []
    for made in (
        [rng.normal(size=(n, 5)) for n in (9, 30, 16, 1, 27, 300)],
        [rng.normal(size=(12, 3)) * 1e-3 + 1e6 for _ in range(4)],
        [rng.integers(0, 3, size=(10, 2)).astype(float) for _ in range(4)],
        [np.zeros((4, 2)), np.zeros((3, 2)), rng.normal(size=(6, 2))],
        [np.zeros((4, 0)), np.zeros((3, 0)), np.zeros((3, 0))],
        [rng.normal(size=(8, 2)) * 1e-40, rng.normal(size=(8, 2)) * 1e40, rng.normal(size=(8, 2))],
    ):
        for repeated in (False, True):
            ids = rng.permutation(1000)[: sum(map(len, made))]
            if repeated:
                ids[-2:] = ids[:2]
            sides, start = [], 0
            for x in made:
                order = np.argsort(ids[start : start + len(x)])
                sides.append((ids[start : start + len(x)][order], x))
                start += len(x)
            pairs = [(a, None if i == j else b) for i, a in enumerate(sides) for j, b in enumerate(sides) if j >= i]
            pair, *edges = kernels.spanning_trees(pairs)
            # The rows of a tile come after each other.
            assert np.count_nonzero(np.diff(pair, prepend=-1)) == len(np.unique(pair))
            for p, (a, b) in enumerate(pairs):
                got = sorted(zip(*(column[pair == p].tolist() for column in edges)))
                assert got == sorted(zip(*(column.tolist() for column in kernels.spanning_tree(a, b))))
    assert kernels.spanning_trees([])[0].size == 0


def test_few_tiles_without_ties_are_solved_alone(monkeypatch):
    rng = np.random.default_rng(4)
    sides = [(np.arange(i, 1200, 12), rng.normal(size=(100, 16))) for i in range(12)]
    pairs = [(a, b) for i, a in enumerate(sides) for b in sides[:i]]
    one, calls = kernels.spanning_tree, []
    monkeypatch.setattr(kernels, "spanning_tree", lambda *tile: calls.append(1) or one(*tile))
    kernels.spanning_trees(pairs)
    assert len(calls) < len(pairs) // 10


def linkage_sides(method, sparse, rows):
    """Two blocks in 12 dimensions; the last cluster of the first goes on in the second."""
    rng = np.random.default_rng(rows)
    cluster = np.sort(rng.integers(0, 60, 2 * rows))
    counts = np.bincount(cluster)
    weight = rng.random(2 * rows) + 0.1 if method == "weighted" else np.ones(2 * rows)
    share = weight / np.bincount(cluster, weight)[cluster]
    sides = []
    for part in np.split(np.arange(2 * rows), 2):
        part = rng.permutation(part)
        facts = {"cluster": cluster[part], "members": counts[cluster[part]], "size": counts[cluster[part]]}
        facts |= {"share": share[part], "spread": np.where(facts["size"] > 1, 0.01, 0.0)}
        entries = np.arange(0, 2 * rows + 1, 2), rng.integers(0, 50, 2 * rows), rng.random(2 * rows) + 1
        coords = None if sparse else rng.normal(size=(rows, 12))
        sides.append(tiles.Block(np.sort(part), coords, entries if sparse else None, facts))
    return sides


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize("method", kernels.METHODS)
def test_screened_linkages_are_the_best_of_the_whole_table(method, sparse):
    left, right = linkage_sides(method, sparse, 90)
    for a, b in ((left, None), (left, right)):
        a, same = kernels.Members(a), b is None
        b = a if same else kernels.Members(b)
        found, whole = kernels._screened_linkages(method, a, b, same), kernels._whole_linkages(method, a, b, same)
        for got, want in zip(found, whole):
            rows, cols, value = got[:3]
            by = rows if not got[4] else cols
            order = np.lexsort((cols if not got[4] else rows, kernels.steady(value), by))
            first = order[np.unique(by[order], return_index=True)[1]]
            assert rows[first].tolist() == want[0].tolist() and cols[first].tolist() == want[1].tolist()
            assert np.allclose(value[first], want[2], rtol=1e-12)


@pytest.mark.parametrize("kind", ["distinct", "copies", "tied", "far", "sparse", "narrow"])
def test_pair_facts_of_several_blocks_are_those_of_each_pair(kind):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 3 if kind == "narrow" else 12)) + (100.0 if kind == "far" else 0.0)
    if kind == "copies":
        x[::9] = x[0]
    elif kind == "tied":
        x = np.round(x)
    blocks, at = [], 0
    for n in (50, 1, 40, 29):
        entries = np.arange(0, 2 * n + 1, 2), rng.integers(0, 9, 2 * n), rng.random(2 * n) + 1
        coords, sparse = (None, entries) if kind == "sparse" else (x[at : at + n], None)
        blocks.append(tiles.Block(np.arange(at, at + n), coords, sparse, {}))
        at += n
    pairs = [(a, None if a is b else b) for i, a in enumerate(blocks) for b in blocks[i:]]
    got = kernels.pair_summaries(pairs)
    # A block of one has no pair with itself.
    assert got["pair"].tolist() == [k for k, (a, b) in enumerate(pairs) if b is not None or len(a) > 1]
    want = [kernels.pair_summary(*pairs[k]) for k in got["pair"]]
    for name in ("pairs", "shortest", "longest"):
        assert got[name].tolist() == [w[name][0] for w in want]
    assert np.allclose(got["total"], [w["total"][0] for w in want], rtol=1e-13)
    if kind in ("distinct", "copies", "far"):
        assert kernels._summaries_of_products(blocks[0], blocks[1:], {}) is not None
