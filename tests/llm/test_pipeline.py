import random

import public_tokenizers
import sentencepiece

import corpus_pipeline
from arbora.llm import compression
from tests.llm.test_bitsliced import brute_components, brute_fingerprint
from tests.llm.test_exact import brute as brute_exact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, folder, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def make():
    rng = random.Random(11)
    pool = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(160):
        words = rng.choices(pool, k=60)
        bad = i % 4 == 0
        text = " ".join(words) if not bad else " | ".join(["$$"] * 60 + words[:3])
        if not bad and i > 100:
            text = rows[i - 101][1] + ("  " if i % 2 else "")
        rows.append((i, text, ("en", "de")[i % 2], f"src{i % 5}", len(text)))
        labels.append((i, int(not bad and i <= 100 or "$$" not in text), 0))
    for i in range(170, 180):  # near copies: one word more in a long text
        words = rows[i - 165][1].split() * 6
        rows.append((i, " ".join(words), "en", "src1", 0))
        rows.append((i + 20, " ".join([*words, "more"]), "de", "src2", 0))
        labels += [(i, 1, 0), (i + 20, 1, 0)]
    rows += [(200, None, None, None, None), (201, "", "en", "src0", 0)]
    return rows, labels


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = make()
    write(spark, str(tmp_path), rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, str(tmp_path))
    assert good.columns == COLUMNS
    scores = compression.scored(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    assert {r[0] for r in good.collect()} == {r["doc_id"] for r in scores if r["predicted"]}
    once = stages["exact dedup"](spark, good, str(tmp_path))
    assert once.columns == COLUMNS
    kept = {r[0] for r in brute_exact([(r[0], r[1]) for r in good.collect()]) if r[3]}
    assert {r[0] for r in once.collect()} == kept
    apart = stages["simhash near-dedup"](spark, once, str(tmp_path))
    left = sorted(tuple(r) for r in once.collect())
    label = brute_components([brute_fingerprint(r[1]) for r in left])
    assert {r[0] for r in apart.collect()} == {left[i][0] for i in set(label)}
    assert len(set(label)) < len(left) - 5
    mixed = stages["mixing sources"](spark, apart, str(tmp_path))
    assert mixed.columns == COLUMNS
    assert {r[0] for r in mixed.collect()} <= {r[0] for r in apart.collect()}
    encoded = stages["sentencepiece encoding"](spark, mixed, str(tmp_path)).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r[0]: r[1] or "" for r in rows}
    assert all(r["lossless"] and model.decode(r["ids"]) == texts[r["doc_id"]] for r in encoded)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, encoded))


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
