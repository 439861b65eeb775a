"""Token ids in files of range-coded blocks (rANS with static tables).

A shard holds some millions of ids of consecutive documents and one frequency table. Its
blocks are coded independently: 2,048 interleaved lanes, each a 64-bit coder state, share
one stream of 32-bit words. A block lists checkpoints (word position and all states), at
each of which decoding can begin, and a CRC-32 of its ids. Spark's Parquet writer stores one
row per shard, so files are committed as any table is and shards are decoded in parallel.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.common import delivered, new_path, stored, text_or_empty

LANES = 2_048
BLOCK_IDS = 1 << 19
CHECKPOINT_STEPS = 128
SHARD_IDS = 1 << 21
TABLE_BITS = 18
LOW = np.uint64(1 << 31)
# Words whose ids a Python worker remembers, but for a last batch: some 160 bytes each.
MEMO_WORDS = 1_000_000

# The white space of Unicode, and letters that are surely letters to any
# tokenizer of this kind.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"

SHARDS = (
    "shard bigint, n_ids bigint, docs array<bigint>, counts array<bigint>, symbols binary, freqs binary, "
    "blocks array<struct<n:int,crc:bigint,at:array<int>,word:array<int>,states:binary,words:binary>>"
)


class WordEncoder:
    """Ids of a byte-level BPE tokenizer, with the ids of frequent words remembered.

    Such a tokenizer splits before a space and between a letter and what isn't one, so
    texts may be cut there; the pieces are encoded by the tokenizers library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        # whether a piece begins with a space, as byte-level vocabularies write it
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for piece, i in vocabulary.items() if piece.startswith("\u0120")]] = True
        # a letter run not followed by anything outside ASCII; else up to white space;
        # white space but for its last character; that character
        self.white = re.compile(f"[{WHITE}]")
        self.unit = re.compile(
            rf" ?[{LETTERS}]++(?![^\x00-\x7f])| ?[^{WHITE}]+|[{WHITE}]+(?=[{WHITE}]|$)|[{WHITE}]"
        )

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        memo, missing, holes = self.memo, set(), []
        units = [self.unit.findall(t) for t in texts]
        known = [list(map(memo.get, u)) for u in units]
        for i, k in enumerate(known):
            at = -1
            for _ in range(k.count(None)):
                at = k.index(None, at + 1)
                word = units[i][at]
                missing.add(word)
                holes.append((i, at, word))
        if missing:
            fresh = self.look_up(list(missing))
            for i, at, word in holes:
                known[i][at] = fresh[word]
            if len(memo) < MEMO_WORDS:
                memo.update((w, ids) for w, ids in fresh.items() if len(w) <= 32)
        return [np.frombuffer(b"".join(k), dtype=np.uint32) for k in known]

    def look_up(self, words: list[str]) -> dict[str, bytes]:
        """Ids of single words. Those with a space in front are encoded in one string, where
        each begins at a piece that begins with a space."""
        spaced, rest = [], []
        for w in words:
            (spaced if w[0] == " " and len(w) > 1 and not self.white.match(w, 1) else rest).append(w)
        out = {}
        if spaced:
            whole = self.tokenizer.encode_batch_fast(["".join(spaced)], add_special_tokens=False)[0]
            ids = np.array(whole.ids, dtype=np.uint32)
            at = np.flatnonzero(self.spaced[ids])
            if len(at) != len(spaced):
                raise ValueError("this tokenizer doesn't split before spaces")
            data, cuts = ids.tobytes(), (4 * np.append(at, len(ids))).tolist()
            out = {w: data[a:b] for w, a, b in zip(spaced, cuts, cuts[1:])}
        if rest:
            found = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
            out |= {w: np.array(e.ids, dtype=np.uint32).tobytes() for w, e in zip(rest, found)}
        return out


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, which outlives a task."""
    held = sys.__dict__.setdefault("_arbora_encoders", {})
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]


def quantised(counts: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    """Frequencies of at least one that add up to ``2 ** bits``."""
    if len(counts) > 1 << bits:
        raise ValueError("more symbols than the table has places")
    freqs = np.maximum(1, counts * (1 << bits) // counts.sum())
    excess = int(freqs.sum()) - (1 << bits)
    if excess < 0:
        freqs[np.argmax(freqs)] -= excess
    while excess > 0:
        spare = freqs - 1
        take = np.minimum(spare, spare * excess // spare.sum())
        if not take.any():
            take[np.argsort(-spare, kind="stable")[: min(excess, int((spare > 0).sum()))]] = 1
        freqs -= take
        excess -= int(take.sum())
    return freqs


def encode_block(places: np.ndarray, freqs: np.ndarray, bits: int = TABLE_BITS) -> dict:
    """Code ``places`` (positions in the table); what decoding needs but for the count."""
    steps = -(-len(places) // LANES)
    grid = np.full(steps * LANES, np.argmax(freqs), dtype=np.int64)
    grid[: len(places)] = places
    starts = np.cumsum(freqs) - freqs
    size = freqs.astype(np.uint64)[grid].reshape(steps, LANES)
    begin = starts.astype(np.uint64)[grid].reshape(steps, LANES)
    limit = size << np.uint64(63 - bits)
    x = np.full(LANES, LOW, dtype=np.uint64)
    words, emitted, points = [], 0, []
    for step in range(steps - 1, -1, -1):
        f = size[step]
        full = x >= limit[step]
        if full.any():
            low = x[full]
            words.append(low.astype(np.uint32))
            emitted += len(low)
            x[full] = low >> np.uint64(32)
        quotient = x // f
        x = (quotient << np.uint64(bits)) + (x - quotient * f) + begin[step]
        if step % CHECKPOINT_STEPS == 0:
            points.append((step, emitted, x.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, dtype=np.uint32)
    points.reverse()
    return {
        "at": [step for step, _, _ in points],
        "word": [len(stream) - done for _, done, _ in points],
        "states": b"".join(states.tobytes() for _, _, states in points),
        "words": stream.tobytes(),
    }


def decode_block(block: dict, n: int, freqs: np.ndarray, slots: np.ndarray, first: int = 0, bits: int = TABLE_BITS):
    """Places from checkpoint ``first`` to the end of a block of ``n``."""
    steps, begin_step = -(-n // LANES), block["at"][first]
    x = np.frombuffer(block["states"], dtype=np.uint64)[first * LANES : (first + 1) * LANES].copy()
    stream = np.frombuffer(block["words"], dtype=np.uint32)
    at, mask = block["word"][first], np.uint64((1 << bits) - 1)
    size = freqs.astype(np.uint64)
    begin = (np.cumsum(freqs) - freqs).astype(np.uint64)
    out = np.empty((steps - begin_step, LANES), dtype=slots.dtype)
    for step in range(steps - begin_step):
        slot = x & mask
        place = slots[slot]
        out[step] = place
        x = size[place] * (x >> np.uint64(bits)) + slot - begin[place]
        empty = np.flatnonzero(x < LOW)
        if len(empty):
            x[empty] = (x[empty] << np.uint64(32)) | stream[at : at + len(empty)]
            at += len(empty)
    return out.ravel()[: n - begin_step * LANES]


def encode_shard(shard: int, docs: list, counts: list[int], ids: np.ndarray) -> dict:
    counts_by_id = np.bincount(ids)
    symbols = np.flatnonzero(counts_by_id)
    places = (np.cumsum(counts_by_id > 0) - 1)[ids]
    freqs = quantised(counts_by_id[symbols])
    blocks = []
    for at in range(0, len(ids), BLOCK_IDS):
        part = ids[at : at + BLOCK_IDS]
        block = encode_block(places[at : at + BLOCK_IDS], freqs)
        blocks.append({"n": len(part), "crc": zlib.crc32(part.astype("<u4").tobytes()), **block})
    return {
        "shard": shard, "n_ids": len(ids), "docs": docs, "counts": counts,
        "symbols": symbols.astype("<u4").tobytes(), "freqs": freqs.astype("<u4").tobytes(), "blocks": blocks,
    }


def decode_shard(row: dict) -> np.ndarray:
    """All ids of a shard; raises where a checksum doesn't hold."""
    symbols = np.frombuffer(row["symbols"], dtype="<u4")
    freqs = np.frombuffer(row["freqs"], dtype="<u4").astype(np.int64)
    slots = np.repeat(np.arange(len(freqs), dtype=np.int32), freqs)
    parts = []
    for block in row["blocks"]:
        try:
            ids = symbols[decode_block(block, block["n"], freqs, slots)]
        except (ValueError, IndexError):  # it ran out of words
            ids = symbols[:0]
        if zlib.crc32(ids.tobytes()) != block["crc"]:
            raise ValueError(f"a block of shard {row['shard']} is damaged")
        parts.append(ids)
    return np.concatenate(parts)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    shard_ids: int = SHARD_IDS,
) -> None:
    """Encode every text and write the ids to the new folder ``path``, in ascending order of ids.

    A null or empty text is ``end_id`` alone. Null ids come first; rows with one id are
    ordered by a hash of the text. Texts are shuffled once, by ranges of the id; a shard is
    closed at the document that fills it, so that memory doesn't grow with a partition.
    """
    kind = pa.schema(
        [
            ("shard", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.list_(pa.int64())),
            ("counts", pa.list_(pa.int64())), ("symbols", pa.binary()), ("freqs", pa.binary()),
            ("blocks", pa.list_(pa.struct([
                ("n", pa.int32()), ("crc", pa.int64()), ("at", pa.list_(pa.int32())),
                ("word", pa.list_(pa.int32())), ("states", pa.binary()), ("words", pa.binary()),
            ]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = worker_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        keys, counts, held, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            row = encode_shard((part << 32) + number, keys, counts, np.concatenate(held))
            return pa.RecordBatch.from_pylist([row], schema=kind)

        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for at in range(0, len(batch), 128):
                some = batch.slice(at, 128)
                for key, ids in zip(some["id"].to_pylist(), encoder.encode(some["text"].to_pylist())):
                    keys.append(key)
                    counts.append(len(ids) + 1)
                    held += [ids, end]
                    size += len(ids) + 1
                    if size >= shard_ids:
                        yield close()
                        number += 1
                        keys, counts, held, size = [], [], [], 0
        if keys:
            yield close()

    rows = docs.select(F.col(id).cast("bigint").alias("id"), text_or_empty(text).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    ordered = rows.repartitionByRange("id", "mark").sortWithinPartitions("id", "mark").select("id", "text")
    ordered.mapInArrow(run, SHARDS).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, ids)`` per document of the files in ``path``; ``ids`` is binary, little-endian 32-bit."""
    return per_document(spark, path, "ids binary", lambda ids: (ids.tobytes(),))


def per_document(spark: SparkSession, path: str, schema: str, derive) -> DataFrame:
    """Decode every shard and derive columns from each document's ids."""
    shards = spark.read.schema(SHARDS).parquet(path)
    # where each shard begins: sums by file partition first, then inside each partition
    sizes = shards.select("shard", "n_ids", F.shiftright("shard", 32).alias("part"))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(parts, "part").select(
        "shard", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("base")
    )
    joined = delivered(shards, stored(starts), "shard", F.lit(16))
    names = [p.split()[0] for p in schema.split(", ")]
    kinds = {"binary": pa.binary(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = decode_shard(row)
                ends = np.cumsum(row["counts"])
                starts = ends - row["counts"]
                out = [derive(ids[a:b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["docs"], pa.int64()),
                        pa.array(starts + row["base"]),
                        *[pa.array(c, kinds[p.split()[1]]) for c, p in zip(zip(*out), schema.split(", "))],
                    ],
                    names=["id", "start", *names],
                )

    return joined.mapInArrow(run, f"id long, start long, {schema}")


def round_trip(docs: DataFrame, tokenizer_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write files in the shared folder and read them back: ``(id, start, n_tokens, ids_crc32)``."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_token_files(docs, path, tokenizer_path, id, text)
    facts = per_document(spark, path, "n_tokens long, ids_crc32 long", lambda ids: (len(ids), zlib.crc32(ids.tobytes())))
    return facts.withColumnRenamed("id", id)
