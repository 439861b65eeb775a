"""Substring dedup on words, by seed and extend.

Seeds are winnowed anchors (hashes of six words, one in every window of 20). Blocks that
share a seed are joined through it and extended both ways: to the block's whole extent,
then window by window for the extents that differ. What the repeated windows cover,
merged, are the maximal repeats over the length threshold.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from arbora.llm.common import bucketed, stored, unique_rows
from arbora.llm.matching import Windows, anchor_entries, cut_texts, repeated_stretches

LENGTH = 20
SEED_WORDS = 6


def without(words: list, firsts: list[int], ends: list[int]) -> tuple[list, int]:
    kept, at, removed = [], 0, 0
    for first, end in zip(firsts, ends):
        kept += words[at:first]
        removed += end - first
        at = end
    return kept + words[at:], removed


def cut_words(text: bytes, firsts: list[int], ends: list[int]) -> tuple[int, int, str, str]:
    words = text.split()
    kept, removed = without(words, firsts, ends)
    joined = b" ".join(kept)
    return len(words), removed, hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace")


def remove_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = SEED_WORDS, **limits
) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256, kept)`` for every row of ``docs``.

    Words are runs of characters other than the six ASCII spaces. A word goes if it lies
    in a window of ``length`` words that also starts earlier: in a document with a smaller
    id (null first), or earlier in the same one. Rows that repeat an id are documents of
    their own. Null and empty texts have no words. ``kept`` joins the words that stay by
    one space; ``kept_sha256`` is its SHA-256. Texts are shuffled once, into a table
    bucketed by document, which both joins of notes to texts read.
    """
    windows = Windows(words=True, length=length, k=k, keep_first=True)
    rows = unique_rows(docs, id, text)
    seeds = stored(anchor_entries(rows, windows).where("n > 1"))
    texts = bucketed(rows, "doc", "texts")
    stretches = repeated_stretches(rows, texts, seeds, windows, **limits)
    schema = "n_words long, n_removed long, kept_sha256 string, kept string"
    return cut_texts(texts, stretches, cut_words, schema).withColumnRenamed("id", id)
