import hashlib

import pytest
from pyspark.sql import functions as F

from arbora.llm import mixing
from tests.llm.conftest import SCHEMA, messy_rows


def budgets(spark, leaves, weights, percent=100, epochs=2):
    frame = spark.createDataFrame(leaves, "a string, b string, tokens long")
    got = mixing.leaf_budgets(frame, ["a", "b"], weights, percent, epochs)
    return {(r["a"], r["b"]): r["budget"] for r in got.collect()}


def test_weights_hold_where_there_is_enough(spark):
    got = budgets(spark, [("x", "p", 1000), ("x", "q", 1000), ("y", "r", 1000)], {(0, "x"): 3, (1, "p"): 2}, percent=40)
    assert got == {("x", "p"): 600, ("x", "q"): 300, ("y", "r"): 300}


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = [("x", "p", 10), ("x", "q", 1000), ("y", "r", 1000)]
    got = budgets(spark, leaves, {}, percent=50, epochs=1)
    assert got == {("x", "p"): 10, ("x", "q"): 493, ("y", "r"): 502}
    # all of x together is short: only then y gets more
    got = budgets(spark, [("x", "p", 10), ("x", "q", 20), ("y", "r", 1000)], {}, percent=50, epochs=1)
    assert got == {("x", "p"): 10, ("x", "q"): 20, ("y", "r"): 485}


def test_all_is_used_at_most(spark):
    got = budgets(spark, [("x", "p", 7), ("y", "q", 5)], {(0, "x"): 9}, percent=1000, epochs=2)
    assert got == {("x", "p"): 14, ("y", "q"): 10}
    with pytest.raises(ValueError):
        budgets(spark, [("x", "p", 7)], {(0, "x"): 0})


@pytest.mark.parametrize("percent", [30, 100, 170])
def test_prefix_of_seeded_epochs(spark, percent):
    rows = [(i, " ".join(["w"] * (i % 9)), "en", f"s{i % 2}") for i in range(80)]
    docs = spark.createDataFrame([(*r, 0, 0, "", True, 0, 0, 0) for r in rows], SCHEMA)
    got = mixing.mix(docs, {"source": F.col("source")}, {(0, "s1"): 3}, percent=percent, epochs=3)
    got = sorted(tuple(r) for r in got.selectExpr("doc.doc_id", "node.source", "epoch", "tokens_used").collect())
    tokens = {s: sum(i % 9 for i in range(80) if f"s{i % 2}" == s) for s in ("s0", "s1")}
    total = sum(tokens.values()) * percent // 100
    used = {s: sum(r[3] for r in got if r[1] == s) for s in tokens}
    assert sum(used.values()) == total
    want = []
    for s, budget in used.items():
        left, epoch = budget, 0
        while left > 0:
            def place(d, epoch=epoch):
                return hashlib.md5(f"7:{epoch}:{d}".encode()).hexdigest(), d % 9

            for d in sorted((i for i in range(80) if f"s{i % 2}" == s), key=place):
                if left > 0 or budget >= tokens[s] * (epoch + 1):
                    want.append((d, s, epoch, min(d % 9, left)))
                    left -= min(d % 9, left)
            epoch += 1
    assert got == sorted(want)


def test_messy_and_empty(messy, empty):
    got = mixing.mixed_documents(messy)
    assert got.columns == messy.columns
    assert got.count() > 0
    used = mixing.mix(messy, mixing.document_tree(), mixing.WEIGHTS).agg(F.sum("tokens_used")).first()[0]
    assert used == sum(len((r[1] or "").encode().split()) for r in messy_rows())
    assert mixing.mixed_documents(empty).count() == 0
