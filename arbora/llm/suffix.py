"""Substring dedup on bytes, by a logarithmic family of sparse suffix arrays.

A suffix array here holds the suffixes that begin at winnowed anchors (64 bytes, at least
one anchor in every 200-byte string), ordered by the fingerprint of the anchor; each entry
says how many suffixes share the anchor and whether their extents are all one. Only such
suffixes can begin a match of 200 bytes or more, up to a shift. New batches get arrays of
their own, written in sorted buckets; equal-sized arrays of the family are merged by a
merge scan bucket by bucket, without a shuffle, so an entry is rewritten once per doubling.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import bucketed, forget, new_path, stored, unique_rows
from arbora.llm.matching import Windows, anchor_entries, cut_texts, repeated_stretches

LENGTH = 200
SEED_BYTES = 64
BATCHES = 4


class SuffixFamily:
    """Levels of sorted arrays of anchor entries; level sizes are powers of two batches."""

    def __init__(self, spark: SparkSession, windows: Windows, buckets: int | None = None):
        self.spark, self.windows = spark, windows
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str, str]] = []

    def write(self, entries: DataFrame) -> tuple[str, str]:
        name, path = f"arbora_level_{uuid.uuid4().hex}", new_path(self.spark, "level")
        writer = entries.write.format("parquet").bucketBy(self.buckets, "anchor").sortBy("anchor")
        writer.option("path", path).option("compression", "zstd").saveAsTable(name)
        return name, path

    def drop(self, level: tuple[int, str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {level[1]}")
        forget(self.spark, level[2])

    def merge_scan(self, left: str, right: str) -> DataFrame:
        """Entries of two arrays, those of equal anchors combined."""
        a, b = self.spark.table(left), self.spark.table(right)
        return a.join(b, "anchor", "full_outer").select(
            "anchor",
            (F.coalesce(a["n"], F.lit(0)) + F.coalesce(b["n"], F.lit(0))).alias("n"),
            F.least(a["low"], b["low"]).alias("low"),
            F.greatest(a["high"], b["high"]).alias("high"),
        )

    def matches(self, batch: DataFrame) -> DataFrame:
        """Anchor entries of ``batch(doc, text)`` that the family holds already."""
        new = anchor_entries(batch, self.windows)
        found = [new.join(self.spark.table(level[1]).select("anchor"), "anchor", "left_semi") for level in self.levels]
        out = new.limit(0)
        for one in found:
            out = out.unionAll(one)
        return out.distinct()

    def add(self, batch: DataFrame) -> None:
        """Write the array of ``batch(doc, text)`` and merge levels of equal size."""
        size, (name, path) = 1, self.write(anchor_entries(batch, self.windows))
        while self.levels and self.levels[-1][0] == size:
            old = self.levels.pop()
            new = self.write(self.merge_scan(old[1], name))
            self.drop(old)
            self.drop((size, name, path))
            size, (name, path) = 2 * size, new
        self.levels.append((size, name, path))

    def repeated(self) -> DataFrame:
        """Entries of anchors that occur twice or more in all levels together."""
        while len(self.levels) > 1:
            (size, *new), (more, *old) = self.levels.pop(), self.levels.pop()
            merged = self.write(self.merge_scan(old[0], new[0]))
            self.drop((size, *new))
            self.drop((more, *old))
            self.levels.append((size + more, *merged))
        return self.spark.table(self.levels[0][1]).where("n > 1")

    def close(self) -> None:
        while self.levels:
            self.drop(self.levels.pop())


def cut_bytes(text: bytes, firsts: list[int], ends: list[int]) -> tuple[int, int, int, str, bytes]:
    kept = b"".join(text[a:b] for a, b in zip([0, *ends], [*firsts, len(text)]))
    return len(text), len(text) - len(kept), len(firsts), hashlib.sha256(kept).hexdigest(), kept


def remove_repeats(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    k: int = SEED_BYTES,
    batches: int = BATCHES,
    **limits,
) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` for every row of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else,
    in any document. ``n_spans`` counts maximal removed runs; ``kept`` (binary) joins the
    rest. Null and empty texts have no bytes. Rows that repeat an id are documents of
    their own, so copies of a row lose what they share. Texts are shuffled once, into a
    table bucketed by document, which both joins of notes to texts read.
    """
    windows = Windows(words=False, length=length, k=k, keep_first=False)
    rows = unique_rows(docs, id, text)
    family = SuffixFamily(docs.sparkSession, windows)
    for number in range(batches):
        family.add(rows.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == number))
    seeds = stored(family.repeated())
    family.close()
    texts = bucketed(rows, "doc", "texts")
    stretches = repeated_stretches(rows, texts, seeds, windows, **limits)
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return cut_texts(texts, stretches, cut_bytes, schema).withColumnRenamed("id", id)
