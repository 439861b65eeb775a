"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import (
    bitsliced,
    byte_bpe,
    compression,
    exact,
    host_rules,
    mixing,
    negatives,
    pieces,
    repair,
    substring,
    suffix,
    token_files,
    warc,
)
from arbora.llm.common import table


def op1(spark: SparkSession, sf: str) -> DataFrame:
    used = mixing.mix(table(spark, sf, "documents"), mixing.document_tree(), mixing.WEIGHTS)
    return used.select("doc.doc_id", "node.*", "epoch", "n_tokens", "tokens_used")


def op2(spark: SparkSession, sf: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf, "documents")).drop("kept")


def op3(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf, "documents")).drop("kept")


def op4(spark: SparkSession, sf: str) -> DataFrame:
    return compression.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op5(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages"))


def op6(spark: SparkSession, sf: str) -> DataFrame:
    return host_rules.host_rules(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "host_docs", "host_failed", "host_bad",
    )


def op7(spark: SparkSession, sf: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf, "documents"), digests=True)


def op8(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9(spark: SparkSession, sf: str) -> DataFrame:
    found = bitsliced.near_components(table(spark, sf, "documents"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op10(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.segmented(table(spark, sf, "documents"), path).drop("ids")


def op11(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op12(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.mined(negatives.shifted_labels(table(spark, sf, "embeddings")))


def op13(spark: SparkSession, sf: str) -> DataFrame:
    return repair.damaged_and_repaired(table(spark, sf, "conversations"))


QUERIES = {
    "op1_mixing": op1,
    "op2_substring_dedup": op2,
    "op3_suffix_array_dedup": op3,
    "op4_quality_classifier": op4,
    "op5_warc": op5,
    "op6_host_rules": op6,
    "op7_exact_dedup": op7,
    "op8_token_files": op8,
    "op9_simhash_near_dedup": op9,
    "op10_sentencepiece": op10,
    "op11_byte_bpe": op11,
    "op12_hard_negatives": op12,
    "op13_conversation_repair": op13,
}
