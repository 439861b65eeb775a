"""Column expressions over points and edges. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def euclidean(x: Column, y: Column) -> Column:
    """Euclidean distance of two coordinate arrays, summed in dimension order."""
    squares = F.zip_with(x, y, lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, s: acc + s))


def distance(u: Column, x: Column, v: Column, y: Column) -> Column:
    """Distance of two points; a point is at distance 0 from itself by id."""
    return F.when(u == v, F.lit(0.0)).otherwise(euclidean(x, y))


def dimension(coords: Column) -> Column:
    return F.size(coords)


def same_point(u: Column, x: Column, v: Column, y: Column) -> Column:
    return (u == v) & (x == y)


def point_hash(id_: Column, coords: Column) -> Column:
    """Fixed multipliers: 163 per id, 57 per dimension, plus the truncated sum."""
    total = F.aggregate(coords, F.lit(0.0), lambda acc, c: acc + c)
    return id_ * 163 + F.size(coords) * 57 + total.cast("bigint")


def canonical_edge(u: Column, v: Column, weight: Column) -> list[Column]:
    return [
        F.least(u, v).alias("left"),
        F.greatest(u, v).alias("right"),
        weight.alias("weight"),
    ]


def edge_order() -> list[Column]:
    """The one total order of edges, so every tree here is unique."""
    return [F.col("weight"), F.col("left"), F.col("right")]


def point_text(id_: Column, coords: Column) -> Column:
    values = F.transform(coords, lambda c: c.cast("string"))
    return F.concat_ws(",", id_.cast("string"), F.array_join(values, ","))


def parse_point(line: Column) -> list[Column]:
    parts = F.split(line, ",")
    tail = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return [
        parts[0].cast("bigint").alias("id"),
        F.transform(tail, lambda c: c.cast("double")).alias("coords"),
    ]


def edge_text(left: Column, right: Column, weight: Column) -> Column:
    return F.format_string("[(%d %d) %f]", left, right, weight)


def box_distance(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Smallest possible distance between points of two axis-aligned boxes."""
    gaps = F.zip_with(
        F.zip_with(lo_a, hi_b, lambda lo, hi: lo - hi),
        F.zip_with(lo_b, hi_a, lambda lo, hi: lo - hi),
        lambda p, q: F.greatest(p, q, F.lit(0.0)),
    )
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g))
