"""Rows with equal values folded into one, without gathering a group of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.runtime import SALTS, cut


def fold_copies(rows: DataFrame, payload: list[str]) -> tuple[DataFrame, int, DataFrame | None]:
    """``(folded, distinct, copies)`` of ``rows(id, *payload)``.

    ``folded`` has per distinct value the smallest id ``first``, the largest ``last`` and
    ``size``; ``distinct`` counts it. ``copies`` lists ``(first, id)`` for every other
    row, or is None when all values differ. That is decided by counting 8-byte hashes, so
    tables without copies are not shuffled. A hot value is reduced per salt before it is
    reduced as a whole, and its copies are found again per salt.
    """
    hashes = rows.select(F.xxhash64(*payload).alias("hash")).groupBy("hash").count()
    seen = hashes.agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    if (seen["most"] or 1) == 1:
        one = F.lit(1).cast("bigint").alias("size")
        alone = rows.select(*payload, F.col("id").alias("first"), F.col("id").alias("last"), one)
        return alone, seen["rows"] or 0, None
    salted = rows.select(
        "id", *payload, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")
    )
    partial = salted.groupBy(*payload, "salt").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("size")
    )
    # At most SALTS entries per array.
    folded = cut(
        partial.groupBy(*payload).agg(
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.sum("size").alias("size"),
            F.collect_list("salt").alias("salts"),
        )
    )
    facts = folded.agg(F.count(F.lit(1)).alias("distinct"), F.max("size").alias("most")).first()
    if (facts["most"] or 1) == 1:
        return folded.drop("salts"), facts["distinct"], None
    hot = folded.where("size > 1").select(*payload, "first", F.explode("salts").alias("salt"))
    copies = salted.join(hot, [*payload, "salt"]).where("id > first").select("first", "id")
    return folded.drop("salts"), facts["distinct"], copies
