import pytest
from pyspark.sql import functions as F

from arbora.operators import blocks, pairs, tiles
from arbora.runtime import lookup
from tests.conftest import all_distances, rows

# The subgraphs of four blocks (fixed numbering).
PLAN_4 = [
    (0, 0, 1, True), (1, 0, 2, True), (2, 1, 2, True), (3, 0, 3, True), (4, 1, 3, True), (5, 2, 3, True),
    (6, 0, 0, False), (7, 1, 1, False), (8, 2, 2, False), (9, 3, 3, False),
]


def test_plan_of_four_blocks(spark):
    assert rows(blocks.subgraph_plan(spark, 4)) == PLAN_4
    assert blocks.subgraph_count(4) == 10
    for s in (1, 2, 60):
        plan = rows(blocks.subgraph_plan(spark, s))
        assert len({(r[1], r[2]) for r in plan}) == blocks.subgraph_count(s) == len(plan)


def test_every_pair_of_points_meets_once(spark, p6):
    got = rows(blocks.points_by_subgraph(blocks.assign_blocks(p6, 4, "id"), 4))
    where = {(r[0], r[2]): r[1] for r in got}
    for sub, low, high, _ in PLAN_4:
        ids = {i for (s, i) in where if s == sub}
        assert ids == {i for i in range(6) if i % 4 in (low, high)}
    assert len(got) == 6 * 4


def test_pair_facts_do_not_depend_on_how_blocks_are_split(points, monkeypatch):
    coords = [[i * 7 % 13, i * 5 % 11] for i in range(30)]
    blocked = blocks.assign_blocks(points(coords), 2, "id")
    plain = rows(pairs.complete_graph(blocked, 2))
    monkeypatch.setattr(tiles, "BLOCK_POINTS", 4)
    split = rows(pairs.complete_graph(blocked, 2))
    assert [r[:4] for r in plain] == [r[:4] for r in split]
    assert [round(r[4], 6) for r in plain] == [round(r[4], 6) for r in split]
    d = all_distances(coords)
    assert plain[0][1] == 15 * 15 and sum(r[1] for r in plain) == 30 * 29 // 2
    assert round(pairs.united(pairs.complete_graph(blocked, 2)).first().total, 6) == round(d.sum() / 2, 6)
    assert rows(pairs.pairs_between(blocked, 2, 1, 0))[0][:2] == (0, 225)
    assert [r[0] for r in rows(pairs.pairs_within(blocked, 2))] == [1, 2]


def hot_block(points, small):
    """One block of 300 points among ``small`` blocks of two."""
    coords = [[i * 7 % 31, i * 5 % 37] for i in range(300 + 2 * small)]
    block = F.when(F.col("id") < 300, 0).otherwise(1 + F.floor((F.col("id") - 300) / 2)).cast("int")
    return points(coords).withColumn("block", block)


def test_only_hot_blocks_are_split(points, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK_POINTS", 32)
    parts = tiles.ragged_parts(hot_block(points, 1000))
    assert parts.split and parts.count == 1000 + 10
    homes = parts.packed.groupBy("home").count().where("count > 1").collect()
    assert [tuple(r) for r in homes] == [(0, 10)]
    # A part is copied once per run of parts that it meets, not once per part.
    assert parts.side == tiles.SQUARE
    assert tiles.deliver(parts).count() == parts.count * parts.squares < parts.count**2 / 7
    own = tiles.deliver(parts, tiles.home_runs(parts))
    assert own.count() == 1000 + 10 * 2


def test_a_hot_block_gives_the_same_facts(points, monkeypatch):
    blocked, s = hot_block(points, 20), 21
    plain = [rows(f(blocked, s)) for f in (pairs.pairs_within, pairs.pairs_between)]
    monkeypatch.setattr(tiles, "BLOCK_POINTS", 32)
    split = [rows(f(blocked, s)) for f in (pairs.pairs_within, pairs.pairs_between)]
    for one, other in zip(plain, split):
        assert [(*r[:4], round(r[4], 6)) for r in one] == [(*r[:4], round(r[4], 6)) for r in other]
    assert [len(found) for found in plain] == [21, 210]


def test_blocks_are_bounded_and_keep_all_cores_busy():
    assert tiles.block_count(10, 2, 8) == 1
    assert tiles.block_count(2_000, 64, 8) == 6
    assert tiles.block_count(10_000_000, 64, 8) == -(-10_000_000 // tiles.BLOCK_POINTS)
    assert tiles.block_cap(1_000_000) == 16


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_by_broadcast_shuffle_and_salt_agree(spark, how):
    big = spark.range(300).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(0, 250).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    a = lookup(big, "k", table, "key", 250, how)
    b = lookup(big, "k", table, "key", 250, how, broadcast_rows=0)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    c = lookup(big, "k", table, "key", 250, how, broadcast_rows=0)
    spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")
    columns = ["k", "id", "v"]
    found = [sorted(map(str, df.select(columns).collect())) for df in (a, b, c)]
    assert found[0] == found[1] == found[2]


def test_small_blocks_travel_in_wide_squares(points):
    blocked = points([[i * 7 % 31, i * 5 % 37] for i in range(900)])
    blocked = blocked.withColumn("block", F.floor(F.col("id") / 3).cast("int"))
    parts = tiles.ragged_parts(blocked)
    wide = tiles.widened(parts)
    assert parts.side == tiles.SQUARE < wide.side
    assert tiles.deliver(wide).count() == wide.count * wide.squares < tiles.deliver(parts).count() / 3
    facts = pairs.united(pairs.complete_graph(blocked, 300)).first()
    assert facts["pairs"] == 900 * 899 // 2
