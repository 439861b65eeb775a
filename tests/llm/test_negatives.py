import itertools
import math
import random

import numpy as np
import pytest

from arbora.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, g long, block string, low string, rank int, a string"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", None, 3, "y") for r in rows], SCHEMA)


def brute(rows, every=50, k=5, m=3):
    good = []
    for id, x, label in rows:
        if id is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        good.append((id, [math.floor(256 * float(np.float32(c))) for c in x], label))
    out = []
    for id, q, label in good:
        if id % every:
            continue
        score = [(-sum(a * b for a, b in zip(q, p)), i, other) for i, p, other in good if len(p) == len(q)]
        own = sorted((s, i) for s, i, other in score if other == label and i != id)[:k]
        for s, i in own:
            fits = sorted((t, j) for t, j, o in score if o != label and -50 * s <= -100 * t <= -95 * s)
            out += [(id, i, r, j, -s, -t) for r, (t, j) in enumerate(fits[:m], 1)]
    return sorted(out)


def got(found):
    assert found.columns == COLUMNS
    return sorted(tuple(r) for r in found.collect())


def clustered(n, dims, seed, spread=0.05, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = centres[rng.integers(0, 12, n)] + rng.normal(scale=spread, size=(n, dims))
    return [(i, [float(c) for c in row], int(rng.integers(0, labels))) for i, row in enumerate(x)]


@pytest.mark.parametrize("dims,every,block,group", [(3, 5, 8, 3), (64, 10, 256, 11), (1, 7, 4, 2)])
def test_against_brute_force(spark, monkeypatch, dims, every, block, group):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "GROUP_BITS", group)
    monkeypatch.setattr(negatives, "RUN_BITS", 2)
    monkeypatch.setattr(negatives, "ZONE_BITS", 3)
    rows = clustered(300, dims, dims)
    assert got(negatives.mined(frame(spark, rows).repartition(3), every=every)) == brute(rows, every)


def messy_rows():
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], rng.choice([0, 1, 1, 1, None])) for i in range(0, 200, 5)]
    rows += [(i, [0.5] * 6, i % 3) for i in range(201, 260)]  # a hot vector
    rows += [(50, [0.5] * 6, 1), (50, [0.25] * 6, 2), (100, None, 1), (101, [None] * 6, 1), (102, [math.nan] * 6, 1)]
    rows += [(103, [math.inf] * 6, 1), (None, [1.0] * 6, 0)]
    rows += [(104, [1.0, 2.0], 0), (150, [1.0, 1.5], 0), (151, [1.0, 1.0], 1)]
    rows += [(0, [0.0] * 6, 7), (-50, [-0.5] * 6, 1), (105, [], 1), (200, [], 1), (106, [], 2)]
    return rows


def test_messy(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
    rows = messy_rows()
    assert got(negatives.mined(frame(spark, rows).repartition(4))) == brute(rows)


def test_empty(spark):
    assert got(negatives.mined(frame(spark, []))) == []
    assert got(negatives.mined(frame(spark, [(1, [1.0], 1)]))) == []


def test_far_blocks_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 24)
    monkeypatch.setattr(negatives, "GROUP_BITS", 0)
    seen = {}
    chosen = negatives.chosen_blocks

    def counting(groups, blocks, mode):
        found = chosen(groups, blocks, mode)
        seen[mode] = found.count(), groups.count() * blocks.count()
        return found

    monkeypatch.setattr(negatives, "chosen_blocks", counting)
    rows = clustered(600, 4, 9, spread=0.02, labels=2)
    assert got(negatives.mined(frame(spark, rows))) == brute(rows)
    assert all(read < every / 2 for read, every in seen.values()), seen


def test_bounds_hold_every_product():
    rng = np.random.default_rng(2)
    q = rng.integers(-300, 300, (40, 9))
    boxes = [q[i : i + 8] for i in range(0, 40, 8)]
    least, greatest = negatives.bounds(q, np.array([b.min(0) for b in boxes]), np.array([b.max(0) for b in boxes]))
    for i, box in enumerate(boxes):
        found = q @ box.T
        assert (found.min(axis=1) >= least[:, i]).all() and (found.max(axis=1) <= greatest[:, i]).all()


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 4), (3, 2), (4, 2), (5, 1)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in negatives.hilbert(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[np.argsort(np.array([int.from_bytes(k) for k in keys]))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_scores_that_are_too_large_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        negatives.mined(frame(spark, [(0, [1e30], 1), (1, [1e30], 1)])).collect()
