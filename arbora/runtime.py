"""Limits, lineage cuts and skew-proof lookups used by the iterative operators.

Nothing here holds data on the driver. Limits decide when a piece of work is
small enough for one task or one broadcast; beyond them every caller has a
distributed way to the same result.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Edges (or rows of a few longs) one task may finish on its own: some tens of MB.
LOCAL_EDGES = 2_000_000
# Rows of a lookup table of a few longs that may be broadcast: likewise.
BROADCAST_ROWS = 1_000_000
# How many ways a hot key is split.
SALTS = 32
# Rounds after which a loop that should take log(n) rounds is reported as stuck.
MAX_ROUNDS = 128


def parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and drop its lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    local session, where driver and executors are one machine, falls back to a
    temporary folder.

    A checkpoint keeps the size that its plan was estimated to have, and a join is
    estimated as the product of its sides. In a loop such numbers square in every round,
    and after ten rounds planning takes longer than the work. So the rows are taken up as
    a table of unknown size.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError(
                    "set spark.checkpoint.dir to a folder every executor can reach"
                )
            folder = tempfile.mkdtemp(prefix="arbora-checkpoint-")
        context.setCheckpointDir(folder)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(kept.javaRDD(), kept.schema()), spark)


def lookup(
    rows: DataFrame,
    key: str,
    table: DataFrame,
    table_key: str,
    table_rows: int,
    how: str = "left",
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Join ``rows`` to a ``table`` that has one row per ``table_key``.

    ``table_rows`` is the counted size of the table. Up to ``broadcast_rows`` the
    table is broadcast. Beyond that the two are shuffled, and a key that is hot in
    ``rows`` is split: by adaptive execution, which cuts a skewed partition of ``rows``
    and reads the matching one of the table several times, or by ``SALTS`` where that is
    switched off. Salted, the table is copied only to the (key, salt) combinations that
    occur, so never for keys that are not hot.
    The remaining columns of the table are appended; ``table_key`` is not.
    """
    bound = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    table = table.withColumnRenamed(table_key, "__key")
    if table_rows <= bound:
        return rows.join(F.broadcast(table), rows[key] == table["__key"], how).drop("__key")
    if splits_skew(rows.sparkSession):
        return rows.join(table, rows[key] == table["__key"], how).drop("__key")
    columns = [c for c in rows.columns if c != key]
    salt = F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int") if columns else F.lit(0)
    salted = rows.withColumn("__salt", salt)
    wanted = salted.select(F.col(key).alias("__key"), "__salt").distinct()
    spread = wanted.join(table, "__key").withColumnRenamed("__salt", "__side")
    return salted.join(
        spread,
        (salted[key] == spread["__key"]) & (salted["__salt"] == spread["__side"]),
        how,
    ).drop("__key", "__salt", "__side")


def splits_skew(spark: SparkSession) -> bool:
    """Whether adaptive execution splits skewed join partitions in this session."""
    settings = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return all(spark.conf.get(name).lower() == "true" for name in settings)
