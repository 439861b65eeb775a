"""Packed blocks and the tiles (block pairs) they are delivered to.

A block of bounded size travels as one row of binary columns, so sending it to a
tile moves a few buffers and not thousands of rows. Every pairing of points in the
library happens inside a tile and is folded there; pairs are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.operators import kernels
from arbora.operators.blocks import pair_subgraph, subgraph_count
from arbora.runtime import cut, lookup, parallelism

# Most points in a block, and most bytes of coordinates.
BLOCK_POINTS = 2048
BLOCK_BYTES = 16 << 20
# Below this size a block is not worth splitting further for parallelism.
SMALL_BLOCK = 128


@dataclass
class Block:
    """The decoded columns of one packed block, rows in id order.

    Either ``coords`` is set (dense points) or ``sparse``: row starts, columns and
    values of the entries, concatenated.
    """

    ids: np.ndarray
    coords: np.ndarray | None
    sparse: tuple[np.ndarray, np.ndarray, np.ndarray] | None
    extra: dict[str, np.ndarray]

    def __len__(self) -> int:
        return len(self.ids)

    def distance_rows(self, other: Block):
        """Distances to all rows of ``other``, one row of this block after the other."""
        if self.sparse is None:
            return kernels.distance_rows(self.coords, other.coords)
        return kernels.sparse_distance_rows(self.sparse, other.sparse)

# Squares that one task solves at most on average, most parts on each side of a square, and
# bytes of coordinates in it.
SQUARES_PER_TASK = 64
SQUARE = 8
SQUARE_BYTES = 256 << 20


def block_cap(dim: int, most: int | None = None) -> int:
    """Most points of a dimension that may share a block."""
    return min(most or BLOCK_POINTS, max(16, BLOCK_BYTES // (8 * max(dim, 1))))


def block_count(n: int, dim: int, cores: int, most: int | None = None) -> int:
    """Number of blocks: bounded blocks first, then enough tiles for all cores."""
    cap = block_cap(dim, most)
    busy = math.ceil(math.sqrt(4 * cores))
    return max(1, math.ceil(n / cap), min(busy, math.ceil(n / SMALL_BLOCK)))


def pack(blocked: DataFrame, extra: Mapping[str, str] | None = None) -> DataFrame:
    """One row per block: ids, coordinates and ``extra`` columns as buffers.

    ``extra`` maps a column to ``"i8"`` or ``"f8"``. Points are dense (``coords``) or
    sparse rows (``cols``, ``vals``). The box of dense points is kept beside the buffers
    as plain arrays, for pruning in the JVM. One shuffle, by block; callers assign blocks
    of bounded size.
    """
    extra = dict(extra or {})
    dense = "coords" in blocked.columns
    payload = ["coords"] if dense else ["cols", "vals"]
    buffers = ["ids", "coords"] if dense else ["ids", "starts", "cols", "vals"]

    def encode(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids = table["id"].to_numpy()
        row = {"block": pa.array([table["block"][0].as_py()], pa.int32())}
        found = {"ids": ids.astype("<i8")}
        if dense:
            flat = table["coords"].combine_chunks().flatten()
            coords = np.asarray(flat, dtype="<f8").reshape(len(ids), -1)
            row["lo"] = pa.array([coords.min(axis=0)], pa.list_(pa.float64()))
            row["hi"] = pa.array([coords.max(axis=0)], pa.list_(pa.float64()))
            found["coords"] = np.ascontiguousarray(coords)
        else:
            cols, vals = table["cols"].combine_chunks(), table["vals"].combine_chunks()
            lengths = cols.value_lengths().to_numpy(zero_copy_only=False)
            found["starts"] = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
            found["cols"] = np.asarray(cols.flatten(), dtype="<i8")
            found["vals"] = np.asarray(vals.flatten(), dtype="<f8")
        for name, kind in extra.items():
            found[name] = table[name].to_numpy().astype("<" + kind)
        for name, values in found.items():
            row[name] = pa.array([values.tobytes()], pa.binary())
        return pa.table(row)

    schema = "block int" + (", lo array<double>, hi array<double>" if dense else "")
    schema += "".join(f", {name} binary" for name in [*buffers, *extra])
    columns = blocked.select("block", "id", *payload, *extra)
    return columns.groupBy("block").applyInArrow(encode, schema)


def own_tiles(packed: DataFrame) -> DataFrame:
    """Only the tile of each block with itself, numbered by the block."""
    copies = packed.withColumn("other", F.col("block"))
    return _as_tiles(copies, F.col("block").cast("bigint"))


def _as_tiles(copies: DataFrame, subgraph) -> DataFrame:
    return copies.select(
        subgraph.alias("subgraph"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
        (F.col("block") != F.col("other")).alias("pair"),
        *[c for c in copies.columns if c not in ("lo", "hi", "other", "subgraph")],
    )


def map_tiles(
    tiles: DataFrame,
    kernel: Callable[[int, Block, Block | None], Mapping[str, np.ndarray]],
    schema: str,
    count: int,
    extra: Mapping[str, str] | None = None,
) -> DataFrame:
    """Run ``kernel(subgraph, left, right)`` on each of ``count`` tiles.

    ``right`` is None for a block with itself; a pair of which one block is empty is
    skipped. Tiles are tiny in bytes and heavy in work, so they go to partitions by
    number, evenly, rather than by hash and coalescing.
    """
    extra = dict(extra or {})

    def run(table: pa.Table) -> pa.Table:
        side = {s: i for i, s in enumerate(table["side"].to_pylist())}
        pair = table["pair"][0].as_py()
        if pair and len(side) < 2:
            return output.empty_table()
        subgraph = table["subgraph"][0].as_py()
        found = kernel(
            subgraph,
            _decode(table, side[0], extra),
            _decode(table, side[1], extra) if pair else None,
        )
        size = len(next(iter(found.values())))
        columns = {"subgraph": np.full(size, subgraph), **found}
        return pa.table({f.name: pa.array(columns[f.name], f.type) for f in output})

    spark = tiles.sparkSession
    output = _arrow_schema("subgraph long, " + schema)
    tasks = max(1, min(count, max(2 * parallelism(spark), count // 32)))
    return (
        tiles.withColumn("slot", F.pmod("subgraph", F.lit(tasks)).cast("int"))
        .repartitionById(tasks, F.col("slot"))
        .groupBy("slot", "subgraph")
        .applyInArrow(run, "subgraph long, " + schema)
    )


def _decode(table: pa.Table, i: int, extra: Mapping[str, str]) -> Block:
    def buffer(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(table[name][i].as_buffer(), dtype="<" + kind)

    ids = buffer("ids", "i8")
    more = {name: buffer(name, kind) for name, kind in extra.items()}
    if "coords" in table.column_names:
        return Block(ids, buffer("coords", "f8").reshape(len(ids), -1), None, more)
    sparse = buffer("starts", "i8"), buffer("cols", "i8"), buffer("vals", "f8")
    return Block(ids, None, sparse, more)


def _arrow_schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [field.split() for field in text.split(",")]
    return pa.schema([(name, kinds[kind]) for name, kind in fields])


def map_squares(
    packed: DataFrame,
    pairs: DataFrame,
    kernel: Callable[[list[tuple[Block, Block]]], Mapping[str, np.ndarray]],
    schema: str,
    squares: int,
    extra: Mapping[str, str] | None = None,
) -> DataFrame:
    """Run ``kernel`` once per square on the listed block pairs that lie in it.

    ``pairs`` has ``(square, low, high)``. A square gets each of its blocks once, however
    many of its pairs are listed, so blocks are copied less often than pairs are solved.
    """
    ends = F.array(
        F.struct(F.col("low").alias("block"), F.col("high").alias("partner")),
        F.struct(F.col("high").alias("block"), F.lit(None).cast("int").alias("partner")),
    )
    # At most one entry per block of the square.
    wanted = (
        pairs.select("square", F.inline(ends))
        .groupBy("square", "block")
        .agg(F.collect_list("partner").alias("partners"))
    )
    # More squares make more tasks, not longer ones.
    tasks = max(1, min(squares, 4 * parallelism(packed.sparkSession)), squares // SQUARES_PER_TASK)
    output = _arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        blocks = {b: _decode(table, i, extra or {}) for i, b in enumerate(table["block"].to_pylist())}
        listed = [
            (blocks[low], blocks[high])
            for low, partners in zip(blocks, table["partners"].to_pylist())
            for high in partners
        ]
        found = kernel(listed)
        return pa.table({f.name: pa.array(found[f.name], f.type) for f in output})

    rows = packed.drop("lo", "hi").join(wanted, "block")
    slot = F.pmod(F.xxhash64("square"), F.lit(tasks)).cast("int")
    return (
        rows.withColumn("slot", slot)
        .repartitionById(tasks, F.col("slot"))
        .groupBy("slot", "square")
        .applyInArrow(run, schema)
    )


@dataclass
class Parts:
    """Packed blocks, a hot one in as many parts as it needs.

    ``packed`` has a row per part: ``block``, its number in 0..count-1, ``home``, the block
    it belongs to, and ``first`` and ``last``, the numbers of the home's parts. ``side`` is
    the number of parts on each side of a square. ``rows`` and ``dim`` are of the points.
    """

    packed: DataFrame
    count: int
    side: int
    split: bool
    rows: int = 0
    dim: int = 1

    @property
    def squares(self) -> int:
        """Squares on each side of the whole plan."""
        return max(1, -(-self.count // self.side))


def square_side(count: int, dim: int, cores: int, most: int | None = None) -> int:
    """Parts per side of a square: some tasks per core, and a bounded number of bytes."""
    fits = SQUARE_BYTES // (16 * max(dim, 1) * block_cap(dim, most))
    return max(1, min(SQUARE, fits, math.isqrt(subgraph_count(max(count, 1)) // (4 * cores))))


def widened(parts: Parts) -> Parts:
    """Small parts in squares of as many points as ``SQUARE`` full ones have.

    A part is copied once per run of parts, so that copies don't grow with the number of
    small blocks. The bytes of a square stay bounded were all its parts full, and so does
    the number of squares from below.
    """
    cores, cap = parallelism(parts.packed.sparkSession), block_cap(parts.dim)
    points = SQUARE * cap * max(parts.count, 1) // max(parts.rows, 1)
    fits = SQUARE_BYTES // (16 * max(parts.dim, 1) * cap)
    busy = math.isqrt(subgraph_count(max(parts.count, 1)) // (4 * cores))
    return replace(parts, side=max(parts.side, min(points, fits, busy)))


def ragged_parts(blocked: DataFrame, most: int | None = None, extra: Mapping[str, str] | None = None) -> Parts:
    """Pack the blocks of ``blocked``; only those too big for a task are split.

    Parts are numbered by a running sum over the blocks, of which there is one narrow row
    each, so a hot block adds its own parts and no others. Block numbers may have gaps.
    """
    spark = blocked.sparkSession
    width = F.max(F.size("coords")) if "coords" in blocked.columns else F.lit(1)
    sizes = cut(blocked.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), width.alias("dim")))
    dim = sizes.agg(F.max("dim")).first()[0] or 1
    need = F.ceil(F.col("rows") / F.lit(block_cap(dim, most))).cast("int")
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(need).over(upto).cast("int")
    index = cut(
        sizes.select(F.col("block").alias("home"), need.alias("need"), (end - need).alias("first"), (end - 1).alias("last"))
    )
    facts = index.agg(
        F.count(F.lit(1)).alias("homes"), F.sum("need").alias("parts"), F.max("need").alias("most")
    ).first()
    rows = sizes.agg(F.sum("rows")).first()[0] or 0
    count, split = facts["parts"] or 0, (facts["most"] or 1) > 1
    starts = index.select(F.col("home").alias("of"), "need", "first")
    placed = lookup(blocked, "block", starts, "of", facts["homes"], "inner")
    part = F.col("first") + F.pmod(F.xxhash64("id", F.lit(facts["homes"])), F.col("need")).cast("int")
    packed = pack(placed.withColumn("block", part).drop("first", "need"), extra)
    homes = index.select(F.explode(F.sequence("first", "last")).alias("part"), "home", "first", "last")
    packed = lookup(packed, "block", homes, "part", count, "inner")
    return Parts(packed, count, square_side(count, dim, parallelism(spark), most), split, rows, dim)


def equal_parts(blocked: DataFrame, s: int, dim: int, extra: Mapping[str, str] | None = None) -> Parts:
    """Pack ``s`` blocks that are bounded already."""
    block = F.col("block")
    packed = pack(blocked, extra).select("*", block.alias("home"), block.alias("first"), block.alias("last"))
    return Parts(packed, s, square_side(s, dim, parallelism(blocked.sparkSession)), False)


def deliver(parts: Parts, reach: tuple[Column, Column] | None = None) -> DataFrame:
    """Copy each part to the squares it takes part in: one for each run of ``side`` parts
    that it meets, so ``side`` times fewer than its pairs.

    ``reach`` gives the first and last run of parts that a part meets; all, unless told.
    """
    n = parts.squares
    own = F.floor(F.col("block") / F.lit(parts.side)).cast("int")
    first, last = reach or (F.lit(0), F.lit(n - 1))
    copies = parts.packed.drop("lo", "hi").withColumn("own", own)
    copies = copies.withColumn("run", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    low, high = F.least("own", "run"), F.greatest("own", "run")
    return copies.select(
        pair_subgraph(low, high, n).alias("square"), low.alias("low"), high.alias("high"),
        *[c for c in copies.columns if c not in ("own", "run")],
    )


def home_runs(parts: Parts) -> tuple[Column, Column]:
    """Reach of a part that only meets parts of its own home."""
    side = F.lit(parts.side)
    return F.floor(F.col("first") / side), F.floor(F.col("last") / side)


def leading(parts: Parts, active: int, only_others: bool = False) -> dict:
    """How :func:`map_pairs` takes the pairs with at least one of the first ``active`` parts;
    with ``only_others``, those with exactly one."""
    runs, last = -(-active // parts.side), parts.squares - 1
    own = F.floor(F.col("block") / F.lit(parts.side))
    reach = F.lit(0), F.when(own < runs, last).otherwise(runs - 1)
    if only_others:
        return {"wants": lambda a, b, low, high: low < active <= high, "reach": reach}
    return {"wants": lambda a, b, low, high: low < active, "reach": reach}


def map_pairs(
    parts: Parts,
    s: int,
    kernel: Callable[[int, Block, Block | None], Mapping[str, np.ndarray]],
    schema: str,
    wants: Callable[[int, int, int, int], bool] | None = None,
    reach: tuple[Column, Column] | None = None,
    fold: Callable[[Mapping[str, np.ndarray]], Mapping[str, np.ndarray]] | None = None,
    extra: Mapping[str, str] | None = None,
    together: Callable[[list[tuple[Block, Block | None]]], Mapping[str, np.ndarray]] | None = None,
    listed: str | None = None,
) -> DataFrame:
    """``(subgraph, whole, ...)``: run ``kernel(subgraph, left, right)`` on all pairs of parts.

    Subgraphs are those of ``s`` blocks. ``right`` is None for a part with itself. ``whole``
    tells that both blocks lie in one part, so that no other row is about the subgraph.
    ``wants(home, other home, part, other part)`` chooses pairs, lower part first. ``fold``
    reduces what a square has found before it leaves the task. ``together`` stands for
    ``kernel``: it gets all pairs of a square and tells by ``pair`` which one a row is of, those
    of one pair after each other. With ``listed`` they come as one list of that name per pair.
    """
    extra = dict(extra or {})
    output = result = _arrow_schema("subgraph long, whole boolean, " + schema)
    names, fields = output.names, list(output)[2:]
    if listed is not None:
        result = pa.schema([*list(output)[:2], (listed, pa.list_(pa.struct(fields)))])
        schema = f"{listed} array<struct<{', '.join(part.strip().replace(' ', ': ') for part in schema.split(','))}>>"

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rows = {name: table[name].to_pylist() for name in ("block", "home", "first", "last")}
        order = np.argsort(rows["block"])
        blocks = [_decode(table, int(i), extra) for i in order]
        number, home, first, last = ([column[i] for i in order] for column in rows.values())
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        run_of = [b // side for b in number]
        parts_of = {r: [i for i, x in enumerate(run_of) if x == r] for r in (low, high)}
        found, tiles = [], []
        for i in parts_of[low]:
            for j in parts_of[high]:
                if j < i or (wants is not None and not wants(home[i], home[j], number[i], number[j])):
                    continue
                a, b = min(home[i], home[j]), max(home[i], home[j])
                subgraph = s * (s - 1) // 2 + a if a == b else b * (b - 1) // 2 + a
                whole = first[i] == last[i] and first[j] == last[j]
                pair = blocks[i], None if i == j else blocks[j]
                tiles.append((subgraph, whole, pair))
                if together is not None:
                    continue
                got = kernel(subgraph, *pair)
                size = len(next(iter(got.values())))
                found.append({"subgraph": np.full(size, subgraph), "whole": np.full(size, whole), **got})
        if not tiles:
            return result.empty_table()
        if together is not None:
            subgraph, whole, pairs = zip(*tiles)
            found = dict(together(list(pairs)))
            of = found.pop("pair")
            if listed is not None:
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                ends = pa.array(np.append(starts, len(of)).astype("i4"))
                items = pa.StructArray.from_arrays([pa.array(found[f.name], f.type) for f in fields], fields=fields)
                first_of = of[starts]
                columns = np.array(subgraph)[first_of], np.array(whole)[first_of], pa.ListArray.from_arrays(ends, items)
                return pa.table([pa.array(column, f.type) for column, f in zip(columns, result)], result)
            columns = {"subgraph": np.array(subgraph)[of], "whole": np.array(whole)[of], **found}
        else:
            columns = {name: np.concatenate([f[name] for f in found]) for name in names}
        columns = columns if fold is None else fold(columns)
        return pa.table({f.name: pa.array(columns[f.name], f.type) for f in output})

    side, squares = parts.side, subgraph_count(parts.squares)
    # Squares are numbered without gaps, so plain remainders deal them out evenly.
    tasks = max(1, min(squares, 4 * parallelism(parts.packed.sparkSession)), squares // SQUARES_PER_TASK)
    return (
        deliver(parts, reach)
        .withColumn("slot", F.pmod("square", F.lit(tasks)).cast("int"))
        .repartitionById(tasks, F.col("slot"))
        .groupBy("slot", "square")
        .applyInArrow(run, "subgraph long, whole boolean, " + schema)
    )
