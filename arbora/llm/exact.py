"""Exact dedup by progressive refinement: length, then hash of a prefix, then full hash.

Only built-in functions. Texts are never shuffled: every key is derived in the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import SPACES, stored, text_or_empty, told_apart, without_ids

# Characters that the second key reads.
PREFIX = 64
# Rows of (length, prefix hash) pairs that may be broadcast: some tens of MB.
BROADCAST_ROWS = 500_000


def exact_dedup(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    prefix: int = PREFIX,
    digests: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
    row: str | None = None,
) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``.

    Texts are equal if they are after deleting white space; a null text counts as empty.
    Of equal texts the row with the most code points in the original text stays, then
    the one with the smallest id (null is smallest). Rows that repeat the id of the row
    that stays can't be told from it and stay as well. An empty table gives an empty one.

    1. Rows alone in their length are settled.
    2. So are rows alone in their length and hash of the first ``prefix`` characters.
    3. Only the others have their full content read for a SHA-256, by which they are
       grouped. ``digests`` asks for the SHA-256 of settled rows too, as output only.

    The pairs of step 2 that are left are broadcast once counted to be at most
    ``broadcast_rows``. Beyond that the full hash is taken of every row, in the scan,
    which is cheaper than shuffling texts.

    ``row`` names a column that tells rows apart; the result then has it as ``row`` and
    that of the one row of a group that stays as ``keep_row``, the first by text hash
    among equally long ones with one id.
    """
    marks = [F.xxhash64(text_or_empty(text)).alias("mark"), F.col(row).alias("row")] if row else []
    order = ["mark", "row"] if row else []
    norm = F.regexp_replace(text_or_empty(text), SPACES, "")
    rows = docs.select(
        F.col(id).alias("__id"),
        F.length(text_or_empty(text)).alias("chars"),
        norm.alias("norm"),
        *marks,
    ).select(
        "__id", "chars", "norm", *order,
        F.octet_length("norm").alias("size"),
        F.xxhash64(F.substring("norm", 1, prefix)).alias("head"),
    )
    keys = stored(rows.groupBy("size", "head").count())
    sizes = keys.groupBy("size").agg(F.sum("count").alias("n")).filter("n > 1").select("size")
    pairs = keys.filter("count > 1").join(sizes, "size", "left_semi").select("size", "head")
    pairs = stored(pairs.withColumn("open", F.lit(True)))
    if pairs.count() <= broadcast_rows:
        rows = rows.join(F.broadcast(pairs), ["size", "head"], "left")
    else:
        rows = rows.withColumn("open", F.lit(True))
    full = F.sha2(F.col("norm").cast("binary"), 256)
    rows = stored(
        rows.select(
            "__id", "chars", *order,
            F.coalesce("open", F.lit(False)).alias("open"),
            (full if digests else F.when(F.col("open"), full)).alias("text_sha256"),
        )
    )
    settled = rows.filter("not open").select(
        F.col("__id").alias(id), F.col("__id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256",
        *([F.col("row"), F.col("row").alias("keep_row")] if row else []),
    )
    suspects = rows.filter("open")
    groups = suspects.groupBy("text_sha256").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct(-F.col("chars"), F.col("__id").alias("i"), *order)).alias("first"),
    ).select("text_sha256", "group_size", "first", F.col("first.i").alias("keep_id"))
    found = suspects.join(groups, "text_sha256").select(
        F.col("__id").alias(id), "keep_id", "group_size",
        F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
        *([F.col("row"), F.col("first.row").alias("keep_row")] if row else []),
    )
    return settled.unionByName(found)


def kept_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", same_id: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Equal texts that repeat the id of the row that stays do so too if ``same_id``, as in
    ``exact_dedup``; else one row of each group stays.
    """
    rows, key = told_apart(docs, id)
    found = exact_dedup(rows, id, text, row=key)
    gone = found.filter("not kept" if same_id else "row <> keep_row").select(F.col("row").alias(key))
    return without_ids(rows, gone, key).select(docs.columns)
