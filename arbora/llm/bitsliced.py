"""SimHash fingerprints and their comparison on vertical bit planes.

Fingerprints within three differing bits agree in at least all but three of any number of
blocks of bits. Rows meet under every choice of agreeing blocks; rows that meet are
compared 64 at a time: bit planes are stored vertically, a carry-save counter of two bits
per candidate counts differences, and a word of candidates is abandoned once all of them
exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import stored, text_or_empty, told_apart, without_ids
from arbora.operators.components import edge_components
from arbora.runtime import lookup

RADIUS = 3
SEED = 42
SHINGLE = 3
# Rows of a bucket that one task compares with each other; larger buckets are tiled.
TILE = 8_192
# Rows that may share a bucket by chance, which chooses the number of blocks.
BUCKET = 512
# Links that one task may finish; above it components take distributed rounds.
LOCAL_LINKS = 50_000
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(text: bytes) -> int:
    """Fingerprint of lower-cased UTF-8 text; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    hash64 = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return hash64(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    counts = np.zeros(64, dtype=np.int64)
    hashes = np.array([hash64(s, SEED) for s in shingles], dtype="<u8")
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str = "text") -> Column:
    """BIGINT column with the 64 bits of the fingerprint. A null text counts as empty."""

    def run(texts: pa.Array) -> pa.Array:
        found = [simhash(t.as_py() or b"") for t in texts.cast(pa.large_binary())]
        return pa.array(np.array(found, dtype=np.uint64).view(np.int64))

    return F.arrow_udf(run, "bigint")(text_or_empty(text))


def tables(rows: int) -> list[list[tuple[int, int]]]:
    """For each table, the (first bit, bits) of the blocks that must agree.

    The fewest blocks whose key keeps ``rows`` random fingerprints in small buckets.
    """
    for blocks in range(RADIUS + 1, 3 * RADIUS):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        spans = [(a, b - a) for a, b in zip(edges, edges[1:])]
        agree = blocks - RADIUS
        if rows >> sum(sorted(n for _, n in spans)[:agree]) <= BUCKET:
            break
    return [list(c) for c in combinations(spans, agree)]


def bucket_keys(fp: str, rows: int) -> Column:
    """Array of one string-free key per table: the table's number and the agreeing bits."""
    keys = []
    for number, spans in enumerate(tables(rows)):
        key = F.lit(0).cast("bigint")
        for first, bits in spans:
            part = F.shiftrightunsigned(F.col(fp), first).bitwiseAND((1 << bits) - 1)
            key = F.shiftleft(key, bits).bitwiseOR(part)
        keys.append(F.struct(F.lit(number).alias("table"), key.alias("bits")))
    return F.array(*keys)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of words; bit j of word w in row b is bit b of fingerprint 64 w + j."""
    pad = np.zeros(-len(fps) % 64, dtype=np.uint64)
    bits = np.unpackbits(np.concatenate([fps, pad]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def near_words(planes, fps, row, word, valid):
    """Of pairs (row, word of 64 candidates), those with candidates in the radius.

    ``valid`` marks the candidates that count. Returns rows, words and their hits.
    """
    over, low, high = ~valid, np.zeros_like(valid), np.zeros_like(valid)
    for bit in range(64):
        own = np.uint64(0) - ((fps[row] >> np.uint64(bit)) & np.uint64(1))
        differ = planes[bit][word] ^ own
        carry = low & differ
        low ^= differ
        over |= high & carry
        high ^= carry
        if bit % 8 == 7:
            alive = np.flatnonzero(over != FULL)
            if not len(alive):
                return row[:0], word[:0], over[:0]
            if len(alive) < 0.75 * len(row):
                row, word, over, low, high = (x[alive] for x in (row, word, over, low, high))
    alive = np.flatnonzero(over != FULL)
    return row[alive], word[alive], ~over[alive]


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest place of the component so far) after linking ``a`` and ``b``."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def forest(group: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """For each row the first row of its component inside its group; rows sorted by group."""
    n = len(fps)
    label = np.arange(n)
    ends = np.searchsorted(group, group, side="right")
    planes, place = bit_planes(fps), np.arange(n)
    last = (ends - 1) // 64
    row = place[ends - place > 1]
    step = 0
    while len(row):
        word = row // 64 + step
        above = FULL << np.minimum(row % 64 + 1, 63).astype(np.uint64)
        above = np.where(row % 64 == 63, np.uint64(0), above) if step == 0 else np.full(len(row), FULL)
        room = np.minimum(ends[row] - 64 * word, 64)
        valid = above & (FULL >> (64 - room).astype(np.uint64))
        near, at, hits = near_words(planes, fps, row, word, valid)
        if len(near):
            which, bit = np.nonzero(np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            label = joined(label, near[which], 64 * at[which] + bit)
        step += 1
        row = row[row // 64 + step <= last[row]]
    return label


def compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by tile; a tile's rows may span batches."""
    rest = None

    def links(data: pa.Table) -> pa.RecordBatch:
        fps = data["fp"].to_numpy().view(np.uint64)
        names = np.stack([data[c].to_numpy() for c in ("table", "bits", "i", "j")])
        new = np.ones(len(fps), dtype=bool)
        new[1:] = (names[:, 1:] != names[:, :-1]).any(axis=0)
        label = forest(np.cumsum(new), fps)
        moved = np.flatnonzero(label != np.arange(len(fps)))
        a, b = fps[moved].view(np.int64), fps[label[moved]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        data = pa.Table.from_batches([batch])
        data = data if rest is None else pa.concat_tables([rest, data])
        if not len(data):
            continue
        tail = [data[c].to_numpy() for c in ("table", "bits", "i", "j")]
        same = np.ones(len(data), dtype=bool)
        for column in tail:
            same &= column == column[-1]
        cut_at = int(np.flatnonzero(same)[0])
        rest = data.slice(cut_at)
        if cut_at:
            yield links(data.slice(0, cut_at))
    if rest is not None and len(rest):
        yield links(rest)


def links(fps: DataFrame, rows: int, tile: int = TILE) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that span every component of the
    relation "at most three differing bits".

    A bucket of more than ``tile`` rows is dealt into chunks and every pair of chunks
    becomes a tile of its own, so nothing is left out however large a bucket is.
    """
    keyed = stored(fps.select("fp", F.explode(bucket_keys("fp", rows)).alias("k")).select("fp", "k.*"))
    sizes = keyed.groupBy("table", "bits").count()
    large = stored(
        sizes.where(F.col("count") > tile).select(
            F.concat_ws(":", "table", "bits").alias("name"), F.ceil(F.col("count") / tile).cast("int").alias("chunks")
        )
    )
    many = large.count()
    if many:
        named = keyed.withColumn("name", F.concat_ws(":", "table", "bits"))
        keyed = lookup(named, "name", large, "name", many, "left").drop("name")
    else:
        keyed = keyed.withColumn("chunks", F.lit(None).cast("int"))
    chunk = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))
    tiles = keyed.select("fp", "table", "bits", chunk.alias("c"), other.alias("o")).select(
        "fp", "table", "bits", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j")
    )
    tiles = tiles.repartition("table", "bits", "i", "j").sortWithinPartitions("table", "bits", "i", "j", "fp")
    return tiles.mapInArrow(compare_batches, "a long, b long").distinct()


def near_components(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    tile: int = TILE,
    local_links: int = LOCAL_LINKS,
    row: str | None = None,
) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row of ``docs``.

    ``fingerprint`` is BIGINT. ``component_id`` is the smallest id that is reachable by
    links of at most three differing bits (null ids don't name a component unless it has
    no other). Null and empty texts have fingerprint zero and are linked like any other.
    Rows with equal fingerprints are compared once, so groups of copies cost nothing.

    ``row`` names a column that tells rows apart; the result then has it as ``row`` and
    that of the component's first row (by id, text hash, row; null ids last) as ``keep_row``.
    """
    marks = [F.xxhash64(text_or_empty(text)).alias("mark"), F.col(row).alias("row")] if row else []
    order = ["mark", "row"] if row else []
    rows = stored(docs.select(F.col(id).alias("doc"), *marks, fingerprint(text).alias("fp")))
    first = F.min(F.struct(F.col("doc").isNull().alias("unknown"), "doc", *order)).alias("first")
    distinct = stored(rows.groupBy("fp").agg(first))
    count = distinct.count()
    labels = edge_components(links(distinct.select("fp"), count, tile), local_links)
    named = distinct.join(labels.withColumnRenamed("id", "fp"), "fp", "left")
    named = stored(named.select("fp", "first", F.coalesce("component", "fp").alias("component")))
    smallest = named.groupBy("component").agg(F.min("first").alias("first"))
    homes = named.select("fp", "component").join(smallest, "component").select("fp", "first")
    both = ["row", F.col("first.row").alias("keep_row")] if row else []
    return rows.join(homes, "fp").select(
        F.col("doc").alias(id), F.col("fp").alias("fingerprint"), F.col("first.doc").alias("component_id"), *both
    )


def kept_documents(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of ``docs``, that with its smallest id, with all columns."""
    rows, key = told_apart(docs, id)
    found = near_components(rows, id, text, row=key)
    return without_ids(rows, found.where("row <> keep_row").select(F.col("row").alias(key)), key).select(docs.columns)
