"""Hard-negative mining over candidate blocks in the order of a Hilbert curve.

Vectors of integers are sorted along the curve and packed into blocks of 256, a Parquet row
each, with the least and greatest value of every dimension beside the buffers. Anchors are
packed in groups. Interval arithmetic on a block's box bounds its inner products with an
anchor from both sides; only blocks that can hold a wanted score are read for a group. That
is done three times: for a first idea of the positives in each anchor's own block, for the
positives, and for the negatives in the windows that the positives set.

Scores are exact. Where boxes are wide, as in many dimensions without clusters, every block
may be chosen, and the work is that of all anchors times all rows, in squares of a group and
32 blocks that are multiplied as matrices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import numbered, stored

BLOCK_ROWS = 256
# Blocks of a square, blocks whose zone maps are compared with a group at once, anchors of a
# group: as powers of two.
RUN_BITS = 5
ZONE_BITS = 9
GROUP_BITS = 11
# Bits of each dimension that the curve sees, and dimensions, those of the largest variance.
CURVE_BITS = 2
CURVE_DIMS = 64
# Scores are multiplied as doubles, which are exact below this.
EXACT = 1 << 53
NONE = -(1 << 62)

SEED, POSITIVES, NEGATIVES = "seed", "positives", "negatives"


def vectors(rows: DataFrame, id: str, vector: str, label: str, scale: float) -> DataFrame:
    """``(id, label, q)``: rows that take part, with ``floor(scale * x)`` of each component x
    as a double."""
    whole = F.col(vector).cast("array<double>")
    bad = F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = rows.where(F.col(id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~bad)
    q = F.transform(whole, lambda x: F.floor(F.lit(float(scale)) * x))
    return found.select(F.col(id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), q.alias("q"))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (unsigned, below ``2 ** bits``) along the Hilbert curve, as
    rows of bytes that compare as the places do. By Skilling's transform, a dimension at a
    time for all rows at once."""
    x = cells.astype(np.uint32).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1)).astype(np.uint32)
            x[0] ^= np.where(up, q - 1, 0).astype(np.uint32) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0).astype(np.uint32)
        q >>= 1
    x ^= turn
    planes = [(x[i] >> b) & 1 for b in range(bits - 1, -1, -1) for i in range(dims)]
    return np.packbits(np.array(planes, dtype=np.uint8), axis=0).T


def spread(found: DataFrame) -> dict[int, list[tuple[int, int, int]]]:
    """For each number of dimensions, ``(dimension, least, greatest)`` of those the curve takes,
    the largest variance first. One row per dimension comes to the driver."""
    each = found.select(F.size("q").alias("dim"), F.posexplode("q").alias("place", "x"))
    facts = each.groupBy("dim", "place").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.var_pop("x").alias("variance")
    )
    best = Window.partitionBy("dim").orderBy(F.desc("variance"), "place")
    rows = facts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= CURVE_DIMS).orderBy("dim", "r")
    out: dict[int, list[tuple[int, int, int]]] = {}
    for row in rows.collect():
        out.setdefault(row["dim"], []).append((row["place"], row["low"], row["high"]))
    return out


def curve_keys(found: DataFrame) -> DataFrame:
    """``found`` with ``key``, the place of ``q`` along the curve among vectors of its size."""
    chosen = spread(found)

    def run(q: pa.Array) -> pa.Array:
        sizes = q.value_lengths().to_numpy(zero_copy_only=False)
        values, begins = q.flatten().to_numpy(), np.cumsum(sizes) - sizes
        out = np.full(len(q), b"", dtype=object)
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            if not dim:
                continue
            take, low, high = (np.array(c) for c in zip(*chosen[int(dim)]))
            x = values[begins[rows][:, None] + take].astype(np.float64)
            width = np.maximum(high.astype(np.float64) - low, 1)
            cells = np.minimum((x - low) / width * (1 << CURVE_BITS), (1 << CURVE_BITS) - 1)
            out[rows] = [k.tobytes() for k in hilbert(cells.astype(np.uint32), CURVE_BITS)]
        return pa.array(out, pa.binary())

    return found.withColumn("key", F.arrow_udf(run, "binary")("q"))


def narrow(x: np.ndarray) -> tuple[str, bytes]:
    """Least kind of integers that holds ``x``, and its bytes."""
    most = int(np.abs(x).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind, x.astype(kind).tobytes()


BLOCK = (
    "dim int, ids binary, labels binary, kind string, q binary, low binary, high binary, "
    "label_low long, label_high long"
)


def blocks_of(found: DataFrame) -> DataFrame:
    """Written table of candidate blocks with zone maps, numbered along the curve.

    Equal vectors may fill any number of partitions: the last sort key tells rows apart.
    """

    def pack(ids, labels, q) -> pa.RecordBatch:
        kind, data = narrow(q)
        row = {
            "dim": q.shape[1], "ids": ids.tobytes(), "labels": labels.tobytes(), "kind": kind, "q": data,
            "low": q.min(axis=0).astype("<i8").tobytes(), "high": q.max(axis=0).astype("<i8").tobytes(),
            "label_low": int(labels.min()), "label_high": int(labels.max()),
        }
        return pa.RecordBatch.from_pylist([row], schema=schema)

    def run(batches):
        for batch in batches:
            sizes = batch["q"].value_lengths().to_numpy(zero_copy_only=False)
            values, ends = batch["q"].flatten().to_numpy(), np.cumsum(sizes)
            ids, labels = batch["id"].to_numpy(), batch["label"].to_numpy()
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                for at in range(0, len(rows), BLOCK_ROWS):
                    some = rows[at : at + BLOCK_ROWS]
                    q = values[(ends[some] - dim)[:, None] + np.arange(dim)]
                    yield pack(ids[some], labels[some], q.reshape(len(some), dim))

    schema = arrow(BLOCK)
    dealt = curve_keys(found).withColumn("row", F.monotonically_increasing_id())
    dealt = dealt.withColumn("dim", F.size("q")).repartitionByRange("dim", "key", "row")
    dealt = dealt.sortWithinPartitions("dim", "key", "id").select("id", "label", "q")
    return numbered(dealt.mapInArrow(run, BLOCK), "block")


def arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, exactly."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most >= EXACT:
        raise ValueError("components are too large: scores must stay below 2 ** 53")
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product that a row of ``a`` can have with anything in each box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


@dataclass
class Group:
    """Anchors of one group: their numbers, and the least and greatest score that is looked
    for in each of their slots."""

    key: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    home: np.ndarray
    q: np.ndarray
    lows: np.ndarray
    highs: np.ndarray

    def wants(self, mode: str, zones: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Whether each anchor must read each block, and the greatest score it may find."""
        low = np.array([np.frombuffer(z["low"], "<i8") for z in zones]).reshape(len(zones), -1)
        high = np.array([np.frombuffer(z["high"], "<i8") for z in zones]).reshape(len(zones), -1)
        least, greatest = bounds(self.q, low, high)
        if mode == SEED:
            return self.home[:, None] == np.array([z["block"] for z in zones]), greatest
        first = np.array([z["label_low"] for z in zones])
        last = np.array([z["label_high"] for z in zones])
        own = self.labels[:, None]
        if mode == POSITIVES:
            return (greatest >= self.lows[:, :1]) & (first <= own) & (own <= last), greatest
        inside = np.zeros(greatest.shape, dtype=bool)
        for slot in range(self.lows.shape[1]):
            inside |= (greatest >= self.lows[:, slot, None]) & (least <= self.highs[:, slot, None])
        return inside & ~((first == own) & (last == own)), greatest


GROUP_COLUMNS = (
    "g long, dim int, key binary, ids binary, labels binary, home binary, kind string, q binary, "
    "slots int, lows binary, highs binary"
)


def decoded(row: dict, names: list[str]) -> list[np.ndarray]:
    out = [np.frombuffer(row[n], "<i8") for n in names]
    return [*out, np.frombuffer(row["q"], row["kind"]).astype(np.int64).reshape(len(out[0]), row["dim"])]


def group_of(row: dict) -> Group:
    key, ids, labels, home, q = decoded(row, ["key", "ids", "labels", "home"])
    windows = [np.frombuffer(row[n], "<i8").reshape(len(key), row["slots"]) for n in ("lows", "highs")]
    return Group(key, ids, labels, home, q, *windows)


def groups_of(anchors: DataFrame, slots: int) -> DataFrame:
    """Written table of packed groups of ``anchors(a, dim, id, label, home, kind, q, lows, highs)``."""
    schema = arrow(GROUP_COLUMNS)

    def pack(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        q = np.array([np.frombuffer(r["q"], r["kind"]) for r in rows]).reshape(len(rows), rows[0]["dim"])
        kind, data = narrow(q)
        windows = {c: np.array([r[c] for r in rows], dtype="<i8").reshape(len(rows), slots) for c in ("lows", "highs")}
        columns = {n: np.array([r[c] for r in rows], dtype="<i8").tobytes() for n, c in
                   (("key", "a"), ("ids", "id"), ("labels", "label"), ("home", "home"))}
        row = {"g": rows[0]["g"], "dim": rows[0]["dim"], "kind": kind, "q": data, "slots": slots, **columns}
        return pa.Table.from_pylist([row | {c: w.tobytes() for c, w in windows.items()}], schema=schema)

    dealt = anchors.withColumn("g", F.shiftright("a", GROUP_BITS))
    return stored(dealt.groupBy("g", "dim").applyInArrow(pack, GROUP_COLUMNS))


def anchors_of(blocks: DataFrame, every: int) -> DataFrame:
    """Written table ``(dim, id, label, home, kind, q, a)`` of the rows whose id is divisible by
    ``every``; ``a`` numbers them."""
    columns = "dim int, id long, label long, home long, kind string, q binary"
    schema = arrow(columns)

    def run(batches):
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                ids, labels, q = decoded(row, ["ids", "labels"])
                some = np.flatnonzero(ids % every == 0)
                found = [
                    {"dim": row["dim"], "id": int(ids[i]), "label": int(labels[i]), "home": row["block"],
                     "kind": row["kind"], "q": q[i].astype(row["kind"]).tobytes()}
                    for i in some
                ]
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    read = blocks.select("block", "dim", "ids", "labels", "kind", "q")
    return numbered(read.mapInArrow(run, columns), "a")


def as_rows(table: pa.Table, like: str) -> list[dict]:
    """Rows of one side of a table that holds groups and blocks."""
    return [r for r in table.to_pylist() if r["side"] == like]


def both_sides(groups: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two tables under each other, with ``side`` saying which, for grouping by ``keys``."""
    left = groups.withColumn("side", F.lit("group"))
    right = blocks.withColumn("side", F.lit("block"))
    return left.unionByName(right, allowMissingColumns=True).groupBy(*keys)


def chosen_blocks(groups: DataFrame, blocks: DataFrame, mode: str) -> DataFrame:
    """Written table ``(g, block)``: blocks that some anchor of a group must read.

    Zone maps alone are compared with the groups, 512 of them at a time.
    """
    zones = blocks.select("block", "dim", "low", "high", "label_low", "label_high")
    zones = zones.withColumn("pack", F.shiftright("block", ZONE_BITS))
    last_group = groups.agg(F.max("g")).first()[0] or 0
    last_pack = zones.agg(F.max("pack")).first()[0] or 0
    zones = zones.withColumn("g", F.explode(F.expr(f"sequence(0L, {last_group}L)")))
    wide = groups.withColumn("pack", F.explode(F.expr(f"sequence(0L, {last_pack}L)")))

    def run(table: pa.Table) -> pa.Table:
        found = []
        zones = as_rows(table, "block")
        for row in as_rows(table, "group"):
            same = [z for z in zones if z["dim"] == row["dim"]]
            if same:
                wants, _ = group_of(row).wants(mode, same)
                found += [(row["g"], z["block"]) for z, w in zip(same, wants.any(axis=0)) if w]
        g, block = zip(*found) if found else ((), ())
        return pa.table({"g": pa.array(g, pa.int64()), "block": pa.array(block, pa.int64())})

    return stored(both_sides(wide, zones, ["g", "pack"]).applyInArrow(run, "g long, block long").distinct())


def best(key: np.ndarray, score: np.ndarray, id: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each key, by falling score, then id; sorted so."""
    order = np.lexsort((id, -score, key))
    sorted_key = key[order]
    begin = np.flatnonzero(np.diff(sorted_key, prepend=sorted_key[:1] - 1))
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < k]


def scan(group: Group, blocks: list[dict], mode: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, slot, score, id)``: the best ``k`` of each anchor and slot in some blocks.

    Blocks come in the order of the greatest score they may hold, and the k-th best so far
    narrows what is looked for in the next.
    """
    slots = group.lows.shape[1] if mode == NEGATIVES else 1
    wants, greatest = group.wants(mode, blocks)
    lows = group.lows[:, :slots].copy()
    none = np.zeros(0, dtype=np.int64)
    held = (none, none, none)  # anchor * slots + slot, score, id
    for b in np.argsort(-np.where(wants, greatest, NONE).max(axis=0, initial=NONE), kind="stable"):
        some = np.flatnonzero(wants[:, b] & (greatest[:, b, None] >= lows).any(axis=1))
        if not len(some):
            continue
        ids, labels, q = decoded(blocks[b], ["ids", "labels"])
        score = products(group.q[some], q)
        same = group.labels[some][:, None] == labels
        allowed = ~same if mode == NEGATIVES else same & (group.ids[some][:, None] != ids)
        parts = [held]
        for slot in range(slots):
            fits = allowed & (score >= lows[some, slot, None])
            if mode == NEGATIVES:
                fits &= score <= group.highs[some, slot, None]
            i, j = np.nonzero(fits)
            parts.append((some[i] * slots + slot, score[i, j], ids[j]))
        key, scores, found = (np.concatenate(c) for c in zip(*parts))
        at = best(key, scores, found, k)
        held = key[at], scores[at], found[at]
        full, first, count = np.unique(held[0], return_index=True, return_counts=True)
        done = count == k
        flat = lows.reshape(-1)
        flat[full[done]] = np.maximum(flat[full[done]], held[1][first[done] + k - 1])
    return held[0] // slots, held[0] % slots, held[1], held[2]


def scored(groups: DataFrame, blocks: DataFrame, mode: str, k: int) -> DataFrame:
    """``(a, slot, score, id)``: the first ``k`` of each anchor and slot, by falling score, then id."""
    picked = chosen_blocks(groups, blocks, mode).withColumn("run", F.shiftright("block", RUN_BITS))
    content = picked.join(blocks, "block")
    copies = picked.select("g", "run").distinct().join(groups, "g")
    schema = "a long, slot int, score long, id long"
    kinds = arrow(schema)

    def run(table: pa.Table) -> pa.Table:
        out = []
        content = as_rows(table, "block")
        for row in as_rows(table, "group"):
            same = [b for b in content if b["dim"] == row["dim"]]
            if same:
                group = group_of(row)
                anchor, slot, score, id = scan(group, same, mode, k)
                out.append(pa.table([group.key[anchor], slot.astype(np.int32), score, id], schema=kinds))
        return pa.concat_tables(out) if out else kinds.empty_table()

    found = both_sides(copies, content, ["g", "run"]).applyInArrow(run, schema)
    first = Window.partitionBy("a", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def mined(
    rows: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    scale: float = 256.0,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Rows without an id or a label, and those whose vector is null or has a component that
    is null or not finite, take no part. A score is the inner product of two vectors of
    ``floor(scale * x)``; vectors of different sizes have none. Anchors are the rows whose
    id is divisible by ``every``; the positives of one are the first ``positives`` rows of
    its label with another id, by falling score, then id. For each positive the first
    ``negatives`` rows of other labels are given whose score is between the two ``window``
    per cents of the positive's. Rows that repeat an id are rows of their own; an anchor or
    positive that occurs n times is given n times. An empty table gives an empty one.
    Scores of 2 ** 53 and beyond are refused.
    """
    blocks = blocks_of(vectors(rows, id, vector, label, scale))
    anchors = anchors_of(blocks, every)
    open_ended = [F.array(F.lit(NONE)).alias("lows"), F.array(F.lit(-NONE)).alias("highs")]
    seeds = scored(groups_of(anchors.select("*", *open_ended), 1), blocks, SEED, positives)
    floors = seeds.where(F.col("rank") == positives).select("a", F.array("score").alias("lows"))
    known = anchors.join(floors, "a", "left")
    known = known.select(*anchors.columns, F.coalesce("lows", F.array(F.lit(NONE))).alias("lows"), open_ended[1])
    best_rows = stored(scored(groups_of(known, 1), blocks, POSITIVES, positives).drop("slot"))
    p = F.col("score").cast("decimal(38,0)")
    least = F.ceil(p * window[0] / 100).cast("bigint")
    most = F.floor(p * window[1] / 100).cast("bigint")
    windows = best_rows.groupBy("a").agg(
        F.sort_array(F.collect_list(F.struct("rank", least.alias("low"), most.alias("high")))).alias("w")
    )
    # an anchor with fewer positives has empty windows in the slots that are left
    rest = F.lit(positives) - F.size("w")
    lists = [
        F.concat(F.col(f"w.{name}"), F.array_repeat(F.lit(none), rest)).alias(alias)
        for name, alias, none in (("low", "lows", -NONE), ("high", "highs", NONE))
    ]
    ready = anchors.join(windows, "a").select(*anchors.columns, *lists)
    found = scored(groups_of(ready, positives), blocks, NEGATIVES, negatives)
    pairs = best_rows.select(
        "a", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    named = anchors.select("a", F.col("id").alias("anchor_id"))
    return found.join(pairs, ["a", "slot"]).join(named, "a").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def shifted_labels(rows: DataFrame, id: str = "vec_id", label: str = "label") -> DataFrame:
    """``rows`` with ``(label + 1) % 10`` as the label where the id is divisible by 7."""
    return rows.withColumn(label, F.when(F.col(id) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label)))
