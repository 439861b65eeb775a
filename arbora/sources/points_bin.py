"""Binary point matrices as a Spark data source, ``format("points_bin")``.

One file: little-endian int32 rows and dimension, then float64 values row by row; the
id of a point is its row number. Written as a folder of raw blocks with a manifest,
so that tasks write in parallel. Both forms are read in parallel by byte offset.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

HEADER = 8
MANIFEST = "manifest.json"
# Bytes of values per read task, and rows per Arrow batch.
SPLIT_BYTES = 64 << 20
BATCH_ROWS = 10_000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _read_json(system: fs.FileSystem, path: str) -> dict:
    with system.open_input_file(path) as f:
        return json.loads(f.read())


@dataclass
class Rows(InputPartition):
    file: str
    offset: int
    first_id: int
    rows: int


@dataclass
class Written(WriterCommitMessage):
    name: str
    first_id: int
    rows: int
    dim: int


class PointsBinReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes
        system, where = _open(path)
        if system.get_file_info(where).type == fs.FileType.Directory:
            manifest = _read_json(system, f"{where}/{MANIFEST}")
            self.dim = manifest["dim"]
            self.files = [
                (f"{where}/{b['name']}", 0, b["first_id"], b["rows"]) for b in manifest["blocks"]
            ]
        else:
            with system.open_input_file(where) as f:
                n, self.dim = np.frombuffer(f.read(HEADER), dtype="<i4").tolist()
            expected = HEADER + 8 * n * self.dim
            size = system.get_file_info(where).size
            if size < expected:
                raise ValueError(f"{path} holds {size} bytes; its header promises {expected}")
            self.files = [(where, HEADER, 0, n)]

    def partitions(self):
        width = 8 * max(self.dim, 1)
        step = max(1, self.split_bytes // width)
        return [
            Rows(file, offset + width * row, first + row, min(step, rows - row))
            for file, offset, first, rows in self.files
            for row in range(0, rows, step)
        ]

    def read(self, partition: Rows):
        system, _ = _open(self.path)
        with system.open_input_file(partition.file) as f:
            f.seek(partition.offset)
            for start in range(0, partition.rows, BATCH_ROWS):
                rows = min(BATCH_ROWS, partition.rows - start)
                values = np.frombuffer(f.read(8 * rows * self.dim), dtype="<f8")
                ends = np.arange(rows + 1, dtype=np.int32) * self.dim
                ids = np.arange(rows, dtype=np.int64) + partition.first_id + start
                coords = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(ids), coords], ["id", "coords"])


class PointsBinWriter(DataSourceArrowWriter):
    """Each task writes its rows to a file of its own name; the manifest, written on
    commit, lists only the files of tasks that succeeded."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        system, where = _open(path)
        if not overwrite and system.get_file_info(where).type != fs.FileType.NotFound:
            raise ValueError(f"{path} exists; use mode('overwrite')")

    def write(self, iterator):
        system, where = _open(self.path)
        system.create_dir(where, recursive=True)
        name, first, rows, dim = f"block-{uuid.uuid4().hex}.f64", 0, 0, 0
        with system.open_output_stream(f"{where}/{name}") as f:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                lengths = batch["coords"].value_lengths()
                values = np.asarray(batch["coords"].flatten(), dtype="<f8")
                if not rows:
                    first, dim = batch["id"][0].as_py(), lengths[0].as_py()
                if set(lengths.unique().to_pylist()) != {dim}:
                    raise ValueError("points of different dimension cannot share a matrix")
                f.write(values.tobytes())
                rows += batch.num_rows
        return Written(name, first, rows, dim)

    def commit(self, messages):
        system, where = _open(self.path)
        manifest, old = f"{where}/{MANIFEST}", []
        if system.get_file_info(manifest).type == fs.FileType.File:
            old = [b["name"] for b in _read_json(system, manifest)["blocks"]]
        written = sorted((m for m in messages if m and m.rows), key=lambda m: m.first_id)
        if len({m.dim for m in written}) > 1:
            raise ValueError("points of different dimension cannot share a matrix")
        blocks, total = [], 0
        for m in written:
            blocks.append({"name": m.name, "first_id": total, "rows": m.rows})
            total += m.rows
        found = {"rows": total, "dim": written[0].dim if written else 0, "blocks": blocks}
        system.create_dir(where, recursive=True)
        with system.open_output_stream(f"{manifest}.new") as f:
            f.write(json.dumps(found).encode())
        system.move(f"{manifest}.new", manifest)
        for name in old:
            system.delete_file(f"{where}/{name}")

    def abort(self, messages):
        system, where = _open(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{where}/{m.name}")


class PointsBinSource(DataSource):
    @classmethod
    def name(cls):
        return "points_bin"

    def schema(self):
        return "id bigint, coords array<double>"

    def reader(self, schema):
        return PointsBinReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite):
        return PointsBinWriter(self.options["path"], overwrite)


def read_points_bin(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Points of a binary matrix; the path must be one every executor can open."""
    spark.dataSource.register(PointsBinSource)
    return spark.read.format("points_bin").option("splitBytes", split_bytes).load(path)


def write_points_bin(points: DataFrame, path: str) -> None:
    """Points as a binary matrix in id order, written by range partitions in parallel."""
    points.sparkSession.dataSource.register(PointsBinSource)
    ordered = points.select("id", "coords").repartitionByRange("id").sortWithinPartitions("id")
    ordered.write.format("points_bin").mode("overwrite").save(path)
