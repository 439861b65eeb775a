"""From a raw table to points: cleaning, encoding, assembling, numbering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.runtime import cut

# Codes of the customer gender column (fixed values).
GENDER_CODES = {"Male": 1.0, "Female": 0.0}

# A category map up to this size becomes a literal in the plan, a larger one a join.
LITERAL_CODES = 500
BROADCAST_CODES = 200_000

# Coordinates beyond this overflow when squared.
LARGEST = 1e150


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop every row with a null or NaN in any column."""
    return df.na.drop("any")


def encode_category(
    df: DataFrame,
    column: str,
    codes: Mapping[str, float],
    on_unknown: str = "null",
) -> DataFrame:
    """Replace a category by its number; an unmapped category becomes null.

    ``on_unknown="error"`` fails the query on a category that has no code. Apply
    before :func:`drop_incomplete` so that rows with unmapped categories go too.
    """
    if on_unknown not in ("null", "error"):
        raise ValueError("on_unknown must be 'null' or 'error'")
    order = df.columns
    if len(codes) <= LITERAL_CODES:
        pairs = [F.lit(v) for k, c in codes.items() for v in (str(k), float(c))]
        code = F.try_element_at(F.create_map(*pairs), F.col(column)) if pairs else F.lit(None).cast("double")
        coded = df.withColumn("__code", code)
    else:
        table = df.sparkSession.createDataFrame(
            [(str(k), float(c)) for k, c in codes.items()], "__name string, __code double"
        )
        if len(codes) <= BROADCAST_CODES:
            table = F.broadcast(table)
        coded = df.join(table, df[column] == table["__name"], "left").drop("__name")
    value = F.col("__code")
    if on_unknown == "error":
        unknown = F.col(column).isNotNull() & value.isNull()
        message = F.concat(F.lit(f"no code for {column} = "), F.col(column).cast("string"))
        value = F.when(unknown, F.raise_error(message).cast("double")).otherwise(value)
    return coded.withColumn(column, value).select(*order)


def to_double(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in df.columns])


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def assemble_points(df: DataFrame, columns: Sequence[str], id_column: str = "id") -> DataFrame:
    """Put numeric columns, in the given order, into one coordinate array."""
    coords = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    return df.select(F.col(id_column).cast("bigint").alias("id"), coords.alias("coords"))


def array_points(df: DataFrame, id_column: str, array_column: str) -> DataFrame:
    """Points from a table that already stores one numeric array per row."""
    return df.select(
        F.col(id_column).cast("bigint").alias("id"),
        F.col(array_column).cast("array<double>").alias("coords"),
    )


def with_dense_id(df: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """Number rows 0..n-1 in the given order, without a single-partition sort.

    ``order`` should end in a unique column: equal keys cannot be split over range
    partitions. Rows are range-partitioned and sorted once, the partition number and
    position within it come from ``monotonically_increasing_id``, and the stored
    result is read twice: once to count rows per partition, once to add the offsets.
    """
    keys = [F.col(c) for c in order]
    placed = cut(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("__mid", F.monotonically_increasing_id())
    )
    part = F.shiftright("__mid", 33).cast("int")
    within = F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition, so the driver holds as many numbers as there are tasks.
    sizes = placed.groupBy(part.alias("p")).count().orderBy("p").collect()
    offsets, total = [], 0
    for row in sizes:
        while len(offsets) < row["p"]:
            offsets.append(total)
        offsets.append(total)
        total += row["count"]
    start = F.element_at(F.lit(offsets or [0]).cast("array<bigint>"), part + 1)
    return placed.withColumn(name, start + within).drop("__mid")


def first_points(df: DataFrame, n: int) -> DataFrame:
    """Points with dense ids below ``n``: a filter, so it reaches the scan."""
    return df.where(F.col("id") < n)


def first_dims(df: DataFrame, d: int) -> DataFrame:
    return df.withColumn("coords", F.slice("coords", 1, d))


def edge_columns(edges: DataFrame, column: str | None = None) -> DataFrame:
    """Flat ``(left, right, weight)`` rows, from flat or array-of-struct input."""
    if column is not None:
        edges = edges.select(F.inline(column))
    return edges.select("left", "right", "weight")


def profile(points: DataFrame) -> DataFrame:
    """Row count, smallest and largest dimension, and the column types."""
    types = ", ".join(f"{name} {kind}" for name, kind in points.dtypes)
    return points.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.size("coords")).alias("min_dim"),
        F.max(F.size("coords")).alias("max_dim"),
        F.lit(types).alias("column_types"),
    )


def preview(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy("id").limit(k)


def checked_points(points: DataFrame) -> tuple[int, int]:
    """``(rows, dimension)`` of a points table, or an error that says what is wrong."""
    bad_value = F.exists("coords", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST))
    row = points.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("coords")).alias("lo"),
        F.max(F.size("coords")).alias("hi"),
        F.count_if(F.col("id").isNull() | F.col("coords").isNull() | bad_value).alias("bad"),
    ).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} points have a missing id or a coordinate that is not finite or too large")
    if row["n"] and row["lo"] != row["hi"]:
        raise ValueError(f"points have between {row['lo']} and {row['hi']} dimensions; all must agree")
    return row["n"], row["hi"] if row["n"] else 0
