import pytest
from pyspark.sql import functions as F

from arbora.functions import points as P
from arbora.operators import features
from tests.conftest import P6, rows


def test_unmapped_category_becomes_null_then_drops(spark):
    df = spark.createDataFrame(
        [(1, "Male", 3.0), (2, "Female", float("nan")), (3, "Other", 1.0), (4, None, 2.0), (5, "Female", 4.0)],
        "id long, g string, x double",
    )
    coded = features.encode_category(df, "g", features.GENDER_CODES)
    assert [r.g for r in coded.orderBy("id").collect()] == [1.0, 0.0, None, None, 0.0]
    assert [r.id for r in features.drop_incomplete(coded).orderBy("id").collect()] == [1, 5]
    with pytest.raises(Exception, match="no code for g"):
        features.encode_category(df, "g", features.GENDER_CODES, on_unknown="error").collect()


def test_big_category_maps_become_a_join(spark):
    codes = {str(i): float(i) for i in range(features.LITERAL_CODES + 5)}
    df = spark.createDataFrame([(1, "7"), (2, "x")], "id long, g string")
    assert rows(features.encode_category(df, "g", codes).orderBy("id").na.fill(-1.0)) == [(1, 7.0), (2, -1.0)]


def test_dense_ids_follow_the_order_even_for_a_hot_key(spark):
    df = spark.range(1000).select(
        F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).alias("v")
    )
    numbered = features.with_dense_id(df, ["v", "key"])
    want = sorted((r.v, r.key) for r in df.collect())
    assert [(r.v, r.key) for r in sorted(numbered.collect(), key=lambda r: r.id)] == want
    assert sorted(r.id for r in numbered.collect()) == list(range(1000))
    assert features.with_dense_id(df.where("false"), ["v", "key"]).count() == 0


def test_points_that_cannot_be_measured_are_refused(spark, points):
    with pytest.raises(ValueError, match="dimensions"):
        features.checked_points(points([[1.0], [1.0, 2.0]]))
    with pytest.raises(ValueError, match="not finite"):
        features.checked_points(points([[1.0], [float("nan")]]))
    with pytest.raises(ValueError, match="missing id"):
        features.checked_points(spark.createDataFrame([(None, [1.0])], "id long, coords array<double>"))


def test_point_functions(spark, p6):
    row = p6.where("id = 5").select(
        P.point_hash(F.col("id"), F.col("coords")).alias("h"),
        P.point_text(F.col("id"), F.col("coords")).alias("t"),
        P.edge_text(F.lit(1), F.lit(2), F.lit(0.5)).alias("e"),
        P.distance(F.col("id"), F.col("coords"), F.lit(5), F.array(F.lit(9.0), F.lit(9.0))).alias("self"),
    ).first()
    assert (row.h, row.t, row.e, row["self"]) == (5 * 163 + 2 * 57 + 25, "5,20.0,5.0", "[(1 2) 0.500000]", 0.0)
    back = p6.select(P.point_text(F.col("id"), F.col("coords")).alias("t")).select(*P.parse_point(F.col("t")))
    assert rows(back) == P6
    negative = p6.select(P.point_hash(F.lit(0), F.array(F.lit(-2.9))).alias("h")).first().h
    assert negative == 57 - 2
    assert features.profile(p6).first().min_dim == 2
