import struct

import pytest

from arbora.operators.features import GENDER_CODES
from arbora.sources import points_bin, tables
from tests.conftest import P6, rows


def test_binary_file_is_read_in_parallel_by_offset(spark, tmp_path):
    path = tmp_path / "points.bin"
    path.write_bytes(struct.pack("<ii", 5, 2) + struct.pack("<10d", *range(10)))
    df = points_bin.read_points_bin(spark, str(path), split_bytes=32)
    assert df.rdd.getNumPartitions() == 3
    assert rows(df) == [(i, [2.0 * i, 2.0 * i + 1]) for i in range(5)]
    path.write_bytes(struct.pack("<ii", 5, 2) + b"1234")
    with pytest.raises(Exception, match="header promises"):
        points_bin.read_points_bin(spark, str(path)).collect()


def test_binary_folder_round_trip_and_overwrite(spark, p6, points, tmp_path):
    path = str(tmp_path / "matrix")
    points_bin.write_points_bin(points([[1.0]] * 50), path)
    points_bin.write_points_bin(p6, path)
    assert rows(points_bin.read_points_bin(spark, path)) == P6
    sparse = points([[5.0], [6.0], [7.0]], [30, 10, 20])
    points_bin.write_points_bin(sparse, path)
    assert rows(points_bin.read_points_bin(spark, path)) == [(0, [6.0]), (1, [7.0]), (2, [5.0])]
    with pytest.raises(Exception, match="different dimension"):
        points_bin.write_points_bin(points([[1.0], [1.0, 2.0]]), path)


def test_parquet_points_prune_blocks(spark, p6, tmp_path):
    path = str(tmp_path / "points")
    for _ in range(2):
        tables.write_points(p6, path, 9, by="id")
    assert rows(tables.read_points(spark, path).drop("block")) == P6
    some = tables.read_points(spark, path, blocks=[1, 5, 7])
    assert [r[0] for r in rows(some)] == [1, 5]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [block" in plan


def test_text_edges_and_rows(spark, p6, tmp_path):
    tables.write_points_text(p6, str(tmp_path / "text"))
    assert rows(tables.read_points_text(spark, str(tmp_path / "text"))) == P6
    assert rows(tables.points_from_rows(spark, P6)) == P6
    edges = spark.createDataFrame([(1, 2, 0.25)], "left long, right long, weight double")
    tables.write_edges(edges, str(tmp_path / "edges"))
    assert rows(tables.edge_lines(tables.read_edges(spark, str(tmp_path / "edges")))) == [("[(1 2) 0.250000]",)]


def test_customer_csv_to_points(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text(
        "CustomerID,Gender,Age,Annual Income (k$),Spending Score (1-100)\n"
        "5,Male,19,15,39\n2,Female,,16,81\n3,Unknown,20,16,6\n1,Female,23,16,77\n"
    )
    got = rows(tables.prepare_csv(spark, str(path), GENDER_CODES))
    assert got == [(0, [0.0, 23.0, 16.0, 77.0]), (1, [1.0, 19.0, 15.0, 39.0])]
