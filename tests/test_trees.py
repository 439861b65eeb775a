import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators import blocks, edges, spanning, tiles
from arbora.plans import trees
from arbora.plans.trees import mst
from tests.conftest import brute_tree, kruskal, rows

P6_TREE = [(0, 1, 1.0), (0, 3, 10.0), (1, 2, 2.0), (3, 4, 2.0), (4, 5, 109**0.5)]


def clumps(seed=3):
    """Far groups, a lattice full of ties, and a third of all points in one place."""
    rng = np.random.default_rng(seed)
    x = np.concatenate(
        [
            rng.normal(size=(30, 2)),
            rng.normal(size=(30, 2)) + 200,
            rng.integers(0, 4, size=(20, 2)) + 50.0,
            np.full((40, 2), 7.0),
        ]
    )
    return x, rng.permutation(1000)[: len(x)] * 3


def test_golden_tree(p6):
    assert rows(mst(p6)) == P6_TREE
    for s in (1, 2, 4, 9):
        assert rows(mst(p6, blocks=s)) == P6_TREE
    assert rows(spanning.mst_direct(p6)) == P6_TREE


def test_every_plan_finds_the_same_tree(points):
    x, ids = clumps()
    table, want = points(x, ids), brute_tree(x, ids)
    assert rows(mst(table)) == want
    assert rows(mst(table, blocks=3, k=2)) == want
    assert rows(mst(table, block_points=12)) == want
    assert rows(spanning.mst_direct(table, blocks=2)) == want


def test_beyond_one_task_the_tree_is_the_same(points):
    x, ids = clumps(4)
    want = brute_tree(x, ids)
    assert rows(mst(points(x, ids), blocks=2, local_edges=30)) == want


def test_big_blocks_are_solved_in_parts(points, monkeypatch):
    x, ids = clumps(5)
    blocked = blocks.assign_blocks(points(x, ids), 2)
    whole = rows(spanning.subgraph_mst(blocked, 2))
    assert rows(spanning.subgraph_mst(blocked, 2, block_points=25)) == whole
    monkeypatch.setattr(tiles, "BLOCK_POINTS", 25)
    within = rows(spanning.clique_mst(blocked, 2))
    between = rows(spanning.bipartite_mst(blocked, 2))
    assert sorted(within + between) == whole


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_inputs(points, spark, n):
    table = points([[1.0 * i] for i in range(n)]) if n else spark.createDataFrame([], points([[0.0]]).schema)
    want = [(0, 1, 1.0)] if n == 2 else []
    assert rows(mst(table)) == want
    assert rows(mst(table, blocks=3)) == want
    assert rows(spanning.mst_direct(table)) == want


def test_equal_points_form_a_star(points):
    assert rows(mst(points([[2.0, 2.0]] * 5, [9, 4, 6, 8, 5]))) == [(4, i, 0.0) for i in (5, 6, 8, 9)]


def test_bad_arguments(p6):
    with pytest.raises(ValueError):
        mst(p6, k=1)
    with pytest.raises(ValueError):
        blocks.assign_blocks(p6, 0)


def random_edges(seed, m=80):
    rng = np.random.default_rng(seed)
    hub = rng.random(m) < 0.35
    u = np.where(hub, 0, rng.integers(0, 40, m))
    v = rng.integers(0, 40, m)
    return [(int(min(a, b)), int(max(a, b)), float(w)) for a, b, w in zip(u, v, rng.integers(0, 6, m)) if a != b]


@pytest.mark.parametrize("local_edges", [None, 10])
def test_forest_of_any_edge_table(spark, local_edges):
    table = random_edges(7)
    df = spark.createDataFrame(table, "left long, right long, weight double")
    assert rows(spanning.mst_of_edges(df, local_edges)) == kruskal(table)


@pytest.mark.parametrize("local_edges", [None, 12])
def test_groups_merge_separately_whatever_their_size(spark, local_edges):
    groups = {g: random_edges(g, 30) for g in (3, 8)}
    df = spark.createDataFrame(
        [(g, *e) for g, table in groups.items() for e in table],
        "subgraph long, left long, right long, weight double",
    )
    want = sorted((g, *e) for g, table in groups.items() for e in kruskal(table))
    assert rows(spanning.merge_msts(df, local_edges)) == want


def test_non_cycle_edges_follow_the_given_order(spark):
    df = spark.createDataFrame([(0, 1, 5), (1, 2, 1), (0, 2, 2)], "left long, right long, place long")
    assert rows(spanning.non_cycle_edges(df, "place")) == [(0, 2, 2.0), (1, 2, 1.0)]


def test_edge_aggregates(spark, p6):
    tree = mst(p6)
    assert edges.compare_graphs(tree, mst(p6, blocks=3)).first().same
    assert not edges.compare_graphs(tree, tree.where("weight < 5")).first().same
    assert rows(edges.edge_diff(tree, tree)) == []
    lost = edges.edge_diff(tree.where("weight <> 1"), tree.where("weight < 5"))
    assert [(r[0], r[1]) for r in rows(lost)] == [("a", 0), ("a", 4), ("b", 0)]
    assert edges.graph_size(tree).first() == (6, 5)
    assert round(edges.total_weight(tree).first()[0], 6) == 25.440307
    assert edges.total_weight(tree.where("false")).first()[0] == 0.0
    by_block = spanning.subgraph_mst(blocks.assign_blocks(p6, 2, "id"), 2)
    assert rows(edges.edge_counts(by_block)) == [(0, 5), (1, 2), (2, 2)]
    assert [r[1] for r in rows(edges.first_edges(by_block, 1))] == [1, 1, 1]
    lists = spanning.edges_by_subgraph(by_block).where("subgraph = 0").first().edges
    assert [e.weight for e in lists] == sorted(e.weight for e in lists)


def test_edges_without_a_weight_are_refused_on_every_path(spark):
    edges = spark.createDataFrame([(0, 1, None), (1, 2, 1.0), (0, 2, 2.0)], "left long, right long, weight double")
    for limit in (None, 0):
        with pytest.raises(Exception, match="both ends and a weight"):
            spanning.mst_of_edges(edges, limit).collect()
        with pytest.raises(Exception, match="both ends and a weight"):
            spanning.merge_msts(edges.withColumn("subgraph", F.lit(0).cast("long")), limit).collect()


def test_large_ranks_are_not_rounded(spark):
    big = 1 << 53
    edges = spark.createDataFrame([(0, 1, big), (1, 2, big), (0, 2, big + 1)], "left long, right long, place long")
    for limit in (None, 0):
        assert rows(spanning.non_cycle_edges(edges, "place", limit)) == [(0, 1, big), (1, 2, big)]


def test_large_subgraphs_come_in_runs(spark):
    rng = np.random.default_rng(3)
    made = [(int(g), int(i), int(i) + 1, float(rng.integers(0, 9))) for g in (0, 3) for i in range(7 if g else 40)]
    edges = spark.createDataFrame(made, "subgraph long, left long, right long, weight double")
    assert sorted((r.subgraph, r.run) for r in spanning.edges_by_subgraph(edges).collect()) == [(0, 0), (3, 0)]
    runs = spanning.edges_by_subgraph(edges, 8).orderBy("subgraph", "run").collect()
    assert [(r.subgraph, r.run, len(r.edges)) for r in runs] == [(0, k, 8) for k in range(5)] + [(3, 0, 7)]
    got = [(r.subgraph, e.left, e.right, e.weight) for r in runs for e in r.edges]
    assert got == sorted(made, key=lambda e: (e[0], e[3], e[1], e[2]))


def test_boruvka_leaves_far_blocks_out(points):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, 0.3, size=(40, 2)) for c in (0, 8, 20, 50, 90)])
    x[7] = x[150]
    report = []
    got = rows(spanning.mst_direct(points(x), 20, report))
    want = brute_tree(x, range(200))
    assert [e[:2] for e in got] == [e[:2] for e in want] and np.allclose([e[2] for e in got], [e[2] for e in want])
    assert all(r["of"] == 210 and r["pairs"] < 150 for r in report) and report[0]["pairs"] < 120


def test_block_sizes_without_delivery(points):
    data = blocks.assign_blocks(points([[float(i)] for i in range(23)]), 4, by="id")
    assert rows(blocks.block_subgraph_sizes(data, 4)) == rows(blocks.subgraph_sizes(blocks.points_by_subgraph(data, 4)))


def test_pairs_down_the_box_hierarchy(points):
    """Any fan gives the block pairs that comparing all boxes gives."""
    rng = np.random.default_rng(8)
    data = trees.curve_blocks(points(rng.normal(size=(300, 2))), 2, 10)
    boxes = tiles.pack(data).select("block", "lo", "hi")
    listed = [(r["block"], np.array(r["lo"]), np.array(r["hi"])) for r in boxes.collect()]
    want = []
    for a, lo_a, hi_a in listed:
        for b, lo_b, hi_b in listed:
            gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
            if a < b and np.sqrt((gap * gap).sum()) <= 0.3:
                want.append((a, b))
    for fan in (3, 64):
        levels = trees.box_levels(boxes, 30, fan)
        assert len(levels) == (1 if fan == 64 else 4)
        got = trees._pairs_within(levels, None, 30, -1.0, 0.3)
        assert sorted((r["low"], r["high"]) for r in got.collect()) == sorted(want)


def test_few_blocks_asked_for_are_split_to_fit_a_task(points, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(120, 2))
    monkeypatch.setattr(spanning, "FINE_BLOCK", 10)
    report = []
    got = rows(spanning.mst_direct(points(x), 2, report))
    assert [e[:2] for e in got] == [e[:2] for e in brute_tree(x, range(120))]
    assert report[0]["of"] == 12 * 13 // 2


def test_thinned_edges_give_the_same_forests(spark, monkeypatch):
    monkeypatch.setattr(spanning, "THINNED", 20)
    groups = {g: random_edges(g, 90) for g in (3, 8)}
    table = [(g, *e) for g, listed in groups.items() for e in listed]
    df = spark.createDataFrame(table, "subgraph long, left long, right long, weight double").coalesce(1)
    for per_group in (True, False):
        left = spanning.thinned(df, per_group).collect()
        assert len(left) < len(table) * 3 // 4
    for limit in (None, 12):
        want = sorted((g, *e) for g, listed in groups.items() for e in kruskal(listed))
        assert rows(spanning.merge_msts(df, limit)) == want
    far = df.withColumn("right", F.col("right") + (1 << 61))
    want = sorted((g, a, b + (1 << 61), w) for g, listed in groups.items() for a, b, w in kruskal([(a, b + 1000, w) for a, b, w in listed]) for b in [b - 1000])
    assert rows(spanning.merge_msts(far, 12)) == want


def test_many_dimensions_are_searched_by_radius(points):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(90, 12)) + rng.integers(0, 3, (90, 1)) * 30.0
    want = brute_tree(x, range(90))
    got = rows(mst(points(x), block_points=9))
    assert [e[:2] for e in got] == [e[:2] for e in want]


def test_far_groups_are_joined_without_all_their_pairs(points, monkeypatch):
    """Dense lines a unit apart: only blocks next to each other on two lines are compared."""
    rng = np.random.default_rng(5)
    x = np.stack([np.repeat(np.arange(4.0), 200), rng.random(800) * 2], axis=1)
    compared, lists = [], {}

    def counted(name, function):
        def run(*arguments):
            listed = function(*arguments)
            lists[name] = lists.get(name, 0) + 1
            compared.append(listed.count())
            return listed

        return run

    monkeypatch.setattr(trees, "_pairs_within", counted("radius", trees._pairs_within))
    monkeypatch.setattr(spanning, "_open_pairs", counted("rounds", spanning._open_pairs))
    want = rows(spanning.mst_direct(points(x)))
    compared.clear()
    lists.clear()
    assert rows(mst(points(x), block_points=8)) == want
    # Of 100 blocks, 4,950 pairs; a radius over the gap would take up most of them.
    assert lists["rounds"] >= 1 and max(compared) <= 1_200


def test_only_edges_up_to_the_radius_leave_a_square():
    """A tile gives its short edges, and longer ones only if it has no others."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(160, 12))
    made = [tiles.Block(np.arange(k, k + 80), x[k : k + 80], None, {}) for k in (0, 80)]
    whole, near, none, link = (
        spanning.square_forest([tuple(made)], radius, 1.0, short)
        for radius, short in ((3.0, "no"), (3.0, "if any"), (0.01, "yes"), (0.01, "if any"))
    )
    assert len(whole["left"]) == 159 and len(link["left"]) and not len(none["left"])
    short = {e for e in zip(*(whole[c].tolist() for c in ("left", "right", "weight"))) if e[2] <= 3.0}
    assert set(zip(*(near[c].tolist() for c in ("left", "right", "weight")))) == short and 0 < len(short) < 159


def test_one_round_forms_the_distances_of_many_dimensions(points, monkeypatch):
    rng = np.random.default_rng(19)
    x = rng.normal(size=(120, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    solved, rounds = trees._solved, []
    monkeypatch.setattr(trees, "_solved", lambda *a: rounds.append(a) or solved(*a))
    got = rows(mst(points(x), block_points=12))
    assert [e[:2] for e in got] == [e[:2] for e in brute_tree(x, range(120))]
    assert len(rounds) == 1


def test_listed_trees_are_those_of_the_rows(spark, points):
    """Lists made in the tasks, and without a shuffle of edges; ties, runs and big blocks, too."""
    rng = np.random.default_rng(31)
    for coords in (rng.normal(size=(90, 3)), rng.integers(0, 3, size=(90, 2))):
        data = blocks.assign_blocks(points(coords), 4, "id")
        flat = spanning.subgraph_mst(data, 4)
        assert spanning.blocks_fit(data)
        listed = spanning.subgraph_mst(data, 4, listed=True)
        assert listed.columns == ["subgraph", "edges"] and listed.count() == 10
        for most in (7, 1000):
            lists = spanning.edges_by_subgraph(listed, most)
            wanted = spanning.edges_by_subgraph(flat, most)
            assert lists.schema["edges"].dataType.simpleString() == wanted.schema["edges"].dataType.simpleString()
            assert rows(lists) == rows(wanted)
    # Once listed, edges are not grouped or joined any more.
    plan = spanning.edges_by_subgraph(listed)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("FlatMapGroupsInArrow")] and "Join" not in plan[: plan.index("FlatMapGroupsInArrow")]
    with pytest.raises(ValueError, match="not listed"):
        spanning.subgraph_mst(data, 4, block_points=5, listed=True)
