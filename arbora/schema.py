"""Row shapes shared by every operator."""

from pyspark.sql import types as T

POINTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("coords", T.ArrayType(T.DoubleType())),
    ]
)

EDGES = T.StructType(
    [
        T.StructField("left", T.LongType()),
        T.StructField("right", T.LongType()),
        T.StructField("weight", T.DoubleType()),
    ]
)

LINKAGE = T.StructType(
    [
        T.StructField("step", T.LongType()),
        T.StructField("child_a", T.LongType()),
        T.StructField("child_b", T.LongType()),
        T.StructField("height", T.DoubleType()),
        T.StructField("size", T.LongType()),
    ]
)
