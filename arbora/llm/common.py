"""Words, written tables, size-checked delivery and row keys shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.runtime import cut

# The characters between words, as a Java, Python and RE2 pattern alike.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
# Bytes of a table that may be broadcast; beyond it rows are shuffled.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which every executor reaches.

    Where it is unset, ``arbora.runtime.cut`` sets one for a local session or refuses.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.getCheckpointDir() is None:
            cut(spark.range(1))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/arbora-{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it again.

    Cuts lineage as a checkpoint does, in a fraction of the space.
    """
    path = new_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Written table of ``df`` with a BIGINT column ``name`` that counts its rows from 0, in
    the order of its partitions and of the rows in them, without gaps."""
    at = free_name(df, "__at")
    kept = stored(df.withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33).alias("__part")
    sizes = kept.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))  # a row per partition
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = F.broadcast(sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before")))
    both = kept.join(firsts, F.shiftright(at, 33) == firsts["__part"])
    place = F.col(at) - F.shiftleft("__part", 33) + F.col("__before")
    return both.select(*df.columns, place.alias(name))


def bucketed(df: DataFrame, key: str, kind: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` dealt by ``key`` and read it again: joins on ``key`` don't shuffle it.

    One bucket per shuffle partition, unless told. The table stays in the catalog as
    ``arbora_<kind>_<number>``, with its files in the shared folder.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"arbora_{kind}_{uuid.uuid4().hex}", new_path(spark, kind)
    writer = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key)
    writer.option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table written by this library under the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unique_rows(docs: DataFrame, id: str, text: str, *more: str) -> DataFrame:
    """``(doc, id, text)`` and columns ``more``: a BIGINT key per row, in the order of the
    ids, and no null text.

    Where ids are unique and not null, the key is the id. Else rows are numbered by id
    and text hash in a written table, nulls first, so that rows with one id count as
    documents of their own.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("id"), text_or_empty(text).alias("text"), *more)
    counted = docs.select(F.col(id).cast("bigint").alias("id")).groupBy("id").count()
    if counted.filter("count > 1 or id is null").isEmpty():
        return rows.select(F.col("id").alias("doc"), "id", "text", *more)
    ordered = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange("id", "mark")
    ordered = ordered.sortWithinPartitions("id", "mark")
    return stored(ordered.select(F.monotonically_increasing_id().alias("doc"), "id", "text", *more))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def told_apart(docs: DataFrame, id: str) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that differs in every row.

    Where ids are unique and not null, that is the id. Else rows are numbered in a further
    column of a written table.
    """
    ids = docs.select(F.col(id).alias("id"))
    if ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").isEmpty():
        return docs, id
    row = free_name(docs, "__row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id())), row


def without_ids(docs: DataFrame, dropped: DataFrame, id: str, limit: int | None = None) -> DataFrame:
    """The rows of ``docs`` whose id isn't in ``dropped``, a table with that one column.

    Ids counted to fit in ``limit`` bytes are broadcast, so that texts stay where they are.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    key = free_name(docs, "__id")
    gone = stored(dropped.select(F.col(id).alias(key)))
    gone = F.broadcast(gone) if 16 * gone.count() <= limit else gone
    return docs.join(gone, docs[id].eqNullSafe(gone[key]), "left_anti")


def delivered(
    docs: DataFrame, notes: DataFrame, key: str, size: Column, limit: int | None = None, how: str = "left"
) -> DataFrame:
    """Join of ``docs`` to ``notes``, a written table with one row per ``key``.

    The sum of ``size`` over the notes is measured. Up to ``limit`` bytes they are
    broadcast and texts stay where they are; beyond it both sides are shuffled.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    total = notes.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return docs.join(F.broadcast(notes) if total <= limit else notes, key, how)
