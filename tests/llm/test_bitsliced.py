import numpy as np
import pytest
import xxhash

from arbora.llm import bitsliced
from tests.llm.conftest import messy_rows


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("tile,local", [(8192, 50_000), (2, 0)])
def test_documents(messy, tile, local):
    rows = [r[:2] for r in messy_rows()]
    got = bitsliced.near_components(messy, tile=tile, local_links=local).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(fps)
    want = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        want.append((doc, fps[i], min(ids) if ids else None))
    assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got), key=repr) == sorted(want, key=repr)


def near_fingerprints(n, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, spread, dtype=np.uint64)
    fps = centres[rng.integers(0, spread, n)]
    for _ in range(4):
        fps ^= np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(fps)


@pytest.mark.parametrize("n,spread", [(1, 1), (64, 1), (65, 2), (300, 9), (500, 2)])
def test_forest_finds_every_component(n, spread):
    fps = near_fingerprints(n, n, spread)
    assert bitsliced.forest(np.zeros(len(fps)), fps).tolist() == brute_components([int(f) for f in fps])


@pytest.mark.parametrize("tile", [4, 8192])
def test_links_span_components_in_large_buckets(spark, tile):
    fps = near_fingerprints(400, 3, 12)
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    place = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    label = np.arange(len(fps))
    pairs = [(place[r[0]], place[r[1]]) for r in bitsliced.links(frame, len(fps), tile).collect()]
    label = bitsliced.joined(label, *(np.array(x) for x in zip(*pairs)))
    assert label.tolist() == brute_components([int(f) for f in fps])


def test_tables_keep_three_differences_apart():
    for rows in (10, 1 << 26, 1 << 36):
        tables = bitsliced.tables(rows)
        rng = np.random.default_rng(rows % 97)
        for _ in range(200):
            differ = {int(b) for b in rng.choice(64, 3, replace=False)}
            assert any(all(not differ & set(range(f, f + n)) for f, n in spans) for spans in tables)


def test_empty(empty):
    assert bitsliced.near_components(empty).count() == 0
    assert bitsliced.kept_documents(empty).columns == empty.columns
