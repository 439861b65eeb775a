"""Tables at rest: CSV, points and edges in parquet, points as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.functions.points import edge_text, parse_point, point_text
from arbora.operators.blocks import assign_blocks
from arbora.operators.features import with_dense_id
from arbora.runtime import parallelism
from arbora.schema import EDGES, POINTS

# The customer table (fixed column names).
CUSTOMERS = T.StructType(
    [
        T.StructField("CustomerID", T.LongType()),
        T.StructField("Gender", T.StringType()),
        T.StructField("Age", T.DoubleType()),
        T.StructField("Annual Income (k$)", T.DoubleType()),
        T.StructField("Spending Score (1-100)", T.DoubleType()),
    ]
)

# Points that one task writes.
POINTS_PER_TASK = 1_000_000


def read_csv(spark: SparkSession, path: str, schema: T.StructType = CUSTOMERS) -> DataFrame:
    """CSV with a header line. The schema is given: inferring it reads the file twice."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_points(points: DataFrame, path: str, blocks: int, by: str = "hash") -> None:
    """Points in parquet with one folder per block, replacing what was there.

    A block is written by as many tasks as there are cores per block, and by at least one
    per ``POINTS_PER_TASK`` points, so few big blocks do not mean few tasks.
    """
    cores = parallelism(points.sparkSession)
    spread = max(1, -(-cores // blocks), -(-points.count() // (blocks * POINTS_PER_TASK)))
    blocked = assign_blocks(points.select("id", "coords"), blocks, by)
    slot = F.col("block") * spread + F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int")
    (
        blocked.repartition(blocks * spread, slot)
        .write.mode("overwrite")
        .partitionBy("block")
        .parquet(path)
    )


def read_points(spark: SparkSession, path: str, blocks: Sequence[int] | None = None) -> DataFrame:
    """Points with a fixed schema; ``blocks`` prunes folders before any file is opened."""
    schema = T.StructType([*POINTS.fields, T.StructField("block", T.IntegerType())])
    stored = spark.read.schema(schema).parquet(path)
    if blocks is not None:
        stored = stored.where(F.col("block").isin(*blocks))
    return stored


def points_from_rows(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, POINTS)


def write_points_text(points: DataFrame, path: str) -> None:
    """Lines ``id,c1,c2,...``."""
    points.select(point_text(F.col("id"), F.col("coords")).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def read_points_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(*parse_point(F.col("value")))


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select("left", "right", "weight").write.mode("overwrite").parquet(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGES).parquet(path)


def edge_lines(edges: DataFrame) -> DataFrame:
    """Edges as text, ``[(left right) weight]``."""
    return edges.select(edge_text(F.col("left"), F.col("right"), F.col("weight")).alias("value"))


def prepare_csv(
    spark: SparkSession, path: str, codes: dict, schema: T.StructType = CUSTOMERS
) -> DataFrame:
    """Customer CSV to points: encode, drop incomplete rows, assemble, number.

    The category is encoded first, so rows with an unmapped one are dropped as well.
    """
    from arbora.operators import features

    raw = read_csv(spark, path, schema)
    key, category, *numbers = schema.fieldNames()
    clean = features.drop_incomplete(features.encode_category(raw, category, codes))
    clean = features.to_double(clean.withColumn("__key", F.col(key)))
    numbered = with_dense_id(clean, ["__key"])
    return features.assemble_points(numbered, [category, *numbers])
