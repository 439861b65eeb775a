import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from arbora.llm import repeats, substring, suffix
from arbora.llm.common import bucketed
from tests.llm.conftest import SCHEMA, messy_rows


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def brute_words(rows, length):
    seen, out = set(), []
    for doc, text in ordered(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_bytes(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    counts = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def invented(n, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdef") * rng.randint(1, 3) for _ in range(12)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(pool) if rng.random() < 0.5 else " ".join(rng.choices("uvwxyz", k=9)) for _ in range(5)]
        texts.append("  ".join(parts)[rng.randint(0, 3) :])
    texts += [texts[0], texts[0], "a " * 60, "é" * 40]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 0, 0, "", True, 0, 0, 0) for r in rows], SCHEMA)


def got(found, columns):
    return sorted((tuple(r) for r in found.select(*columns).collect()), key=repr)


WORDS = ["doc_id", "n_words", "n_removed", "kept_sha256"]
BYTES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("group", [1, 2048])
def test_words(spark, group):
    rows = invented(40, 1)
    assert got(substring.remove_repeats(frame(spark, rows), length=7, k=3, group=group), WORDS) == brute_words(rows, 7)


@pytest.mark.parametrize("group,batches", [(1, 1), (2048, 3), (2, 4)])
def test_bytes(spark, group, batches):
    rows = invented(30, 2)
    found = suffix.remove_repeats(frame(spark, rows), length=24, k=8, group=group, batches=batches)
    assert got(found, BYTES) == brute_bytes(rows, 24)


def test_production_lengths_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 500)
    rng = random.Random(4)
    shared = " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(120))
    rows = [(i, " ".join(f"q{rng.randint(0, 10**9)}" for _ in range(150)) + " " + shared[i:]) for i in range(6)]
    rows.append((6, shared + " " + shared))
    docs = frame(spark, rows)
    assert got(substring.remove_repeats(docs), WORDS) == brute_words(rows, 20)
    assert got(suffix.remove_repeats(docs), BYTES) == brute_bytes(rows, 200)


def test_messy(spark, messy):
    rows = [r[:2] for r in messy_rows()]
    found = got(substring.remove_repeats(messy), WORDS)
    want = brute_words(rows, 20)
    # rows with one id come in the order of a hash of their text, so they are compared as sets
    apart = {9, 10, None}
    assert [r for r in found if r[0] not in apart] == [r for r in want if r[0] not in apart]
    assert Counter(r[:2] for r in found) == Counter(r[:2] for r in want)
    short = [r for r in rows if len(r[1] or "") < 1000] + [(9, "Ünï cödé 中文 😀 é" * 20)] * 2
    assert got(suffix.remove_repeats(frame(spark, short)), BYTES) == brute_bytes(short, 200)


def test_empty(empty):
    assert substring.remove_repeats(empty).count() == 0
    assert suffix.remove_repeats(empty).count() == 0


def test_kept_text(spark):
    docs = frame(spark, [(1, "a b c d"), (2, "x a b c d y")])
    kept = {r["doc_id"]: r["kept"] for r in substring.remove_repeats(docs, length=3, k=1).collect()}
    assert kept == {1: "a b c d", 2: "x y"}


def test_family_matches(spark):
    rows = frame(spark, [(1, "abcdefghijklmnopqrstuvwxyz"), (2, "0123456789 no match")]).selectExpr("doc_id doc", "text")
    family = suffix.SuffixFamily(spark, suffix.Windows(False, 10, 4, False), buckets=2)
    family.add(rows)
    new = frame(spark, [(3, "..abcdefghijkl.."), (4, "nothing shared here")]).selectExpr("doc_id doc", "text")
    assert family.matches(new).count() > 0
    assert family.matches(new.where("doc = 4")).count() == 0
    family.add(new)
    assert [level[0] for level in family.levels] == [2]
    assert family.repeated().count() > 0
    family.close()


def test_blocks_cover_each_window_once():
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, 3, 500).astype(np.uint64)
    ends = np.array([100, 100, 103, 300, 500])
    text, first, last, anchor, whole = repeats.blocks(symbols, ends, 12, 4)
    windows = [w for a, b in zip(first, last) for w in range(a, b + 1)]
    want = [s for b, e in zip([0, 100, 100, 103, 300], ends) for s in range(b, e - 11)]
    assert sorted(windows) == want


def test_bucketed_texts_are_not_shuffled(spark, empty):
    rows = frame(spark, invented(30, 9)).selectExpr("doc_id doc", "doc_id id", "text")
    texts = bucketed(rows, "doc", "texts")
    assert sorted(texts.collect()) == sorted(rows.collect())
    notes = bucketed(rows.selectExpr("doc", "length(text) n"), "doc", "notes")
    plan = texts.join(notes.hint("merge"), "doc", "left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert bucketed(empty.select("doc", "text"), "doc", "texts").count() == 0


def thue_morse(order, symbols):
    word = [0]
    for _ in range(order):
        word += [1 - x for x in word]
    return [symbols[x] for x in word], [symbols[1 - x] for x in word]


def test_words_made_to_collide(spark):
    one, two = ("".join(w) for w in thue_morse(10, "ab"))
    start = " ".join(f"same{i}" for i in range(19))
    rows = [(1, f"{start} {one}"), (2, f"{start} {two}"), (3, "x"), (4, f"{start} {two}")]
    found = got(substring.remove_repeats(frame(spark, rows)), WORDS)
    assert [r[2] for r in found] == [0, 0, 0, 20] and found == brute_words(rows, 20)
    left, right = (" ".join(w) for w in thue_morse(12, ["ab", "ba"]))
    rows = [(1, left), (2, right), (3, right)]
    assert got(substring.remove_repeats(frame(spark, rows), length=2048, k=6), WORDS) == brute_words(rows, 2048)
    rows = [(i, t.replace(" ", "")) for i, t in rows]
    assert got(suffix.remove_repeats(frame(spark, rows), length=4096, k=32), BYTES) == brute_bytes(rows, 4096)


def test_word_hashes_see_every_byte():
    rng = random.Random(8)
    words = {bytes(rng.choices(range(33, 127), k=n)) for n in [1, 2, 7, 8, 9, 16, 63, 64, 65, 200] for _ in range(40)}
    words |= {w + b"\0" for w in words}
    data = b" ".join(sorted(words))
    ends = np.cumsum([len(w) + 1 for w in sorted(words)]) - 1
    starts = np.append(0, ends[:-1] + 1)
    found = repeats.word_hashes(np.frombuffer(data, dtype=np.uint8), starts, ends)
    assert len(set(found.tolist())) == len(words)
