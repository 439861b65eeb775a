import random
import zlib

from pyspark.sql import functions as F

from arbora.llm import compression
from tests.llm.conftest import SCHEMA


def make(spark, n, seed=5):
    rng = random.Random(seed)
    good = [rng.choice("bcdfgklmnprst") + rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        quality = int(rng.random() < 0.7)
        words = rng.choices(good, k=rng.randint(20, 200))
        text = " ".join(words) if quality else " $$ ".join(w.upper() for w in words)
        rows.append((i, text, "en", "s", 0, 0, "", True, 0, 0, 1 - quality))
        labels.append((i, quality, 0))
    labels += [(None, 0, 0), (n + 1, None, 0), (0, labels[0][1], 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = make(spark, 600)
    got = compression.scored(docs, labels).join(labels.dropDuplicates(["doc_id"]), "doc_id").where("held_out").collect()
    assert len(got) > 100
    assert sum(r["predicted"] == r["quality"] for r in got) > 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs, labels = make(spark, 200)
    other = labels.withColumn("quality", F.when(compression.held_out("doc_id"), 0).otherwise(F.col("quality")))
    assert compression.fit(docs, labels) == compression.fit(docs.withColumn("source", F.lit("x")), other)


def test_messy_and_empty(spark, messy, empty):
    docs, labels = make(spark, 100)
    assert compression.scored(messy, labels).count() == messy.count()
    assert compression.scored(empty, labels).count() == 0
    none = compression.scored(messy, labels.limit(0)).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.5]
    assert compression.kept_documents(docs, labels).columns == docs.columns


def test_repeated_ids_do_not_widen_the_sample(spark):
    docs, labels = make(spark, 60)
    shared = next(i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1)
    copies = docs.where(F.col("doc_id") == shared).crossJoin(spark.range(300).toDF("k"))
    copies = copies.withColumn("text", F.concat("text", F.lit(" "), "k"))
    more = docs.unionAll(copies.select(docs.columns))
    got = compression.sample(more, labels, "doc_id", "text", "quality", 60, 4096).collect()
    assert shared in {r[0] for r in got}
    assert len(got) == len({r[0] for r in got}) <= 60


def test_whole_texts_are_fitted_on(spark):
    text = "a plain start " * 400 + "the end"
    docs = spark.createDataFrame([(i, text + str(i)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = compression.sample(docs, labels, "doc_id", "text", "quality", 100).collect()
    assert got and all(r["text"] == text + str(r["doc_id"]) for r in got)
    few = compression.sample(docs, labels, "doc_id", "text", "quality", 100, size=3 * len(text) + 10).collect()
    assert len(few) == 6
    cut = compression.sample(docs, labels, "doc_id", "text", "quality", 100, chars=1000).collect()
    assert {len(r["text"]) for r in cut} == {1000} and any(not r["text"].startswith("a plain") for r in cut)
