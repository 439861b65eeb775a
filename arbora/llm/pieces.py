"""SentencePiece BPE with seeded merge-dropout, and lossless decoding.

A merge candidate is a place in a document: where its left and right parts begin and end.
It is skipped if a keyed hash of (seed, document, place) falls below the dropout rate.
Candidates that are not skipped are merged by the agenda's rule, the best score first, the
leftmost of equals. No piece goes past the start of a run of spaces or holds a character
outside the vocabulary, so texts are cut into words there. Words of one length are the rows
of a matrix whose best candidates are merged at once; long words have an agenda of their
own.
"""

from __future__ import annotations

import heapq
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import text_or_empty
from arbora.llm.repeats import mixed

DROPOUT = 0.1
SEED = 1
# Symbols of a word that the matrices take; longer words are done one by one.
MATRIX_WIDTH = 40
# Characters of a batch of documents that is encoded at once.
BATCH_CHARS = 1 << 19

# Fixed values of the model's format.
SPACE_MARK = 0x2581
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
KEY_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


@dataclass
class Vocabulary:
    """What encoding needs of a model: ids of characters and bytes, and the merges.

    Merges are an open hash table from (left, right) to (merged id, rank); a smaller rank
    is a better score and equal scores share one.
    """

    pieces: list[str]
    chars: np.ndarray
    byte_ids: np.ndarray
    slots: np.ndarray
    merged: np.ndarray
    rank: np.ndarray
    probes: int

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        normal = {
            p: i for i, p in enumerate(pieces)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))
        }
        byte_ids = np.zeros(256, dtype=np.int32)
        for i, p in enumerate(pieces):
            if model.is_byte(i):
                byte_ids[int(BYTE_PIECE.fullmatch(p)[1], 16)] = i
        if any(re.search("[^▁]▁", p) for p in normal):
            raise ValueError("a piece of this model goes past the start of a run of spaces")
        chars = np.full(0x110000, -1, dtype=np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                chars[ord(p)] = i
        scores = sorted({-model.get_score(i) for i in normal.values()})
        ranks = {s: r for r, s in enumerate(scores)}
        pairs = {}
        for p, i in normal.items():
            for at in range(1, len(p)):
                left, right = normal.get(p[:at]), normal.get(p[at:])
                if left is not None and right is not None:
                    pairs[left, right] = (i, ranks[-model.get_score(i)])
        return Vocabulary(pieces, chars, byte_ids, *Vocabulary.hashed(pairs))

    @staticmethod
    def hashed(pairs: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        bits = max(8, (4 * len(pairs)).bit_length())
        slots = np.full(1 << bits, -1, dtype=np.int64)
        merged, rank = np.full(1 << bits, -1, dtype=np.int32), np.full(1 << bits, NONE, dtype=np.int32)
        probes = 1
        for (left, right), (piece, order) in pairs.items():
            key = left << 32 | right
            at = int(slot_of(np.array([key]), 1 << bits)[0])
            tries = 1
            while slots[at] >= 0:
                at = (at + 1) & ((1 << bits) - 1)
                tries += 1
            slots[at], merged[at], rank[at] = key, piece, order
            probes = max(probes, tries)
        return slots, merged, rank, probes

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged ids and ranks (``NONE`` where there is no such piece)."""
        shape = left.shape
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        at = slot_of(key, len(self.slots))
        found = self.slots[at]
        open = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.probes):
            if not len(open):
                break
            at[open] = (at[open] + 1) & (len(self.slots) - 1)
            found[open] = self.slots[at[open]]
            open = open[(found[open] != key[open]) & (found[open] >= 0)]
        hit = found == key
        merged, rank = np.where(hit, self.merged[at], -1), np.where(hit, self.rank[at], NONE)
        return merged.reshape(shape), rank.reshape(shape)


NONE = np.int32(2**31 - 1)


def slot_of(key: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        spread = key.astype(np.uint64) * KEY_PRIMES[0]
    return (spread >> np.uint64(64 - (size - 1).bit_length())).astype(np.int64)


def skipped(keys: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, limit: np.uint64) -> np.ndarray:
    """Whether candidates are dropped; ``keys`` mix the seed and the document."""
    with np.errstate(over="ignore"):
        place = begin.astype(np.uint64) * KEY_PRIMES[0] + middle.astype(np.uint64) * KEY_PRIMES[1]
        place = place + end.astype(np.uint64) * KEY_PRIMES[2]
        return mixed(mixed(place ^ keys) ^ keys) < limit


def merge_rows(vocabulary: Vocabulary, ids: np.ndarray, places: np.ndarray, keys: np.ndarray, limit: np.uint64):
    """Merge the words that are rows of ``ids``; ``places`` has one more column, the ends.

    Yields (row, ids) of finished rows: matrices narrow by a column with every merge.
    """
    row, width = np.arange(len(ids)), ids.shape[1]
    if width == 1:
        yield row, ids
        return
    merged, rank = vocabulary.look_up(ids[:, :-1], ids[:, 1:])
    if limit:
        rank = np.where(skipped(keys[:, None], places[:, :-2], places[:, 1:-1], places[:, 2:], limit), NONE, rank)
    while True:
        best = np.argmin(rank, axis=1)
        every = np.arange(len(row))
        over = rank[every, best] == NONE
        if over.any():
            yield row[over], ids[over]
            going = ~over
            row, ids, places, keys, merged, rank, best = (
                x[going] for x in (row, ids, places, keys, merged, rank, best)
            )
            every = np.arange(len(row))
        if not len(row):
            return
        ids[every, best] = merged[every, best]
        width = ids.shape[1] - 1
        columns = np.arange(width)[None, :]
        ids = np.take_along_axis(ids, columns + (columns > best[:, None]), axis=1)
        columns = np.arange(width + 1)[None, :]
        places = np.take_along_axis(places, columns + (columns > best[:, None]), axis=1)
        if width == 1:
            yield row, ids
            return
        columns = np.arange(width - 1)[None, :]
        shift = columns + (columns >= best[:, None])
        merged, rank = np.take_along_axis(merged, shift, axis=1), np.take_along_axis(rank, shift, axis=1)
        for side in (best - 1, best):  # the candidates beside the new piece
            some = np.flatnonzero((side >= 0) & (side < width - 1))
            at = side[some]
            new, order = vocabulary.look_up(ids[some, at], ids[some, at + 1])
            if limit:
                drop = skipped(keys[some], places[some, at], places[some, at + 1], places[some, at + 2], limit)
                order = np.where(drop, NONE, order)
            merged[some, at], rank[some, at] = new, order


def merge_long(vocabulary: Vocabulary, ids: np.ndarray, first: int, key: np.uint64, limit: np.uint64) -> np.ndarray:
    """Agenda for one long word: candidates by rank and place, links to both neighbours."""
    n = len(ids)
    ids, begin = ids.copy(), np.arange(n)
    right, left = np.append(np.arange(1, n), -1), np.arange(-1, n - 1)
    ends = np.arange(1, n + 1)

    def candidates(at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        to = right[at]
        merged, rank = vocabulary.look_up(ids[at], ids[to])
        if limit:
            drop = skipped(np.full(len(at), key), begin[at] + first, begin[to] + first, ends[to] + first, limit)
            rank = np.where(drop, NONE, rank)
        some = rank != NONE
        return list(zip(*(x[some].tolist() for x in (rank, at, to, ends[to], merged))))

    agenda = candidates(np.arange(n - 1))
    heapq.heapify(agenda)
    alive = np.ones(n, dtype=bool)
    while agenda:
        _, at, to, end, piece = heapq.heappop(agenda)
        if not alive[at] or not alive[to] or right[at] != to or ends[to] != end:
            continue
        ids[at], ends[at], alive[to] = piece, end, False
        right[at] = right[to]
        if right[to] >= 0:
            left[right[to]] = at
        beside = [x for x in (left[at], at if right[at] >= 0 else -1) if x >= 0]
        if beside:
            for one in candidates(np.array(beside)):
                heapq.heappush(agenda, one)
    return ids[alive]


class Encoder:
    """Encodes batches of texts; all state is the vocabulary and the settings."""

    def __init__(self, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED):
        self.vocabulary = vocabulary
        self.limit = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))
        self.seed = np.uint64(seed)

    def encode(self, texts: list[str], docs: list[int]) -> list[np.ndarray]:
        """Ids of each text; ``docs`` are the numbers that key the dropout."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_CHARS):
                size += len(texts[end])
                end += 1
            out += self.encode_some(texts[at:end], np.array(docs[at:end], dtype=np.int64))
            at = end
        return out

    def encode_some(self, texts: list[str], docs: np.ndarray) -> list[np.ndarray]:
        v = self.vocabulary
        # every text that isn't empty gets a space in front, as the model asks
        joined = "".join(" " + t for t in texts if t)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        if not len(points):
            return [np.zeros(0, dtype=np.int32) for _ in texts]
        doc = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(points)) - (np.cumsum(sizes) - sizes)[doc]
        ids = v.chars[np.where(points == 0x20, SPACE_MARK, points)]
        ids[points == SPACE_MARK] = -1  # the mark itself, if it occurs in a text, goes as bytes
        blank, unknown = points == 0x20, ids < 0
        new = np.ones(len(points), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (blank[1:] & ~blank[:-1]) | unknown[1:] | unknown[:-1]
        starts = np.flatnonzero(new)
        widths = np.diff(np.append(starts, len(points)))
        keys = mixed(mixed(docs.astype(np.uint64)) ^ mixed(np.array([self.seed]))[0])
        length = np.ones(len(starts), dtype=np.int64)  # pieces of each word
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(widths, kind="stable")
        bounds = np.searchsorted(widths[order], np.arange(1, MATRIX_WIDTH + 2))
        for width in range(1, MATRIX_WIDTH + 1):
            words = order[bounds[width - 1] : bounds[width]]
            if not len(words):
                continue
            spots = starts[words][:, None] + np.arange(width)
            steps = place[starts[words]][:, None] + np.arange(width + 1)
            for row, got in merge_rows(v, ids[spots], steps, keys[doc[starts[words]]], self.limit):
                length[words[row]] = got.shape[1]
                finished.append((words[row], got))
        for word in order[bounds[MATRIX_WIDTH] :]:
            s = starts[word]
            got = merge_long(v, ids[s : s + widths[word]], int(place[s]), keys[doc[s]], self.limit)
            length[word] = len(got)
            finished.append((np.array([word]), got[None, :]))
        ends = np.cumsum(length)
        flat = np.empty(ends[-1], dtype=np.int32)
        for words, got in finished:
            flat[(ends[words] - got.shape[1])[:, None] + np.arange(got.shape[1])] = got
        counts = np.bincount(doc[starts], weights=length, minlength=len(texts)).astype(np.int64)
        return self.with_bytes(flat, points[starts], ends, np.cumsum(counts))

    def with_bytes(self, flat, firsts, ends, bounds) -> list[np.ndarray]:
        """Replace characters outside the vocabulary by pieces for their UTF-8 bytes."""
        gone = np.flatnonzero(flat < 0)
        if not len(gone):
            return np.split(flat, bounds[:-1])
        word = np.searchsorted(ends, gone, side="right")
        points, which = np.unique(firsts[word], return_inverse=True)
        coded = [self.vocabulary.byte_ids[list(chr(p).encode("utf-8", "surrogatepass"))] for p in points]
        width = np.array([len(c) for c in coded])[which]
        counts = np.ones(len(flat), dtype=np.int64)
        counts[gone] = width
        ends = np.cumsum(counts)
        out = np.repeat(flat, counts)
        table = np.zeros((len(points), 4), dtype=np.int32)
        for i, c in enumerate(coded):
            table[i, : len(c)] = c
        for k in range(4):
            some = width > k
            out[ends[gone[some]] - width[some] + k] = table[which[some], k]
        return np.split(out, np.concatenate([[0], ends])[bounds[:-1]])


def piece_bytes(pieces: list[str]) -> list[bytes]:
    """What each piece stands for; control pieces stand for nothing."""
    out = []
    for p in pieces:
        coded = BYTE_PIECE.fullmatch(p)
        if coded:
            out.append(bytes([int(coded[1], 16)]))
        else:
            out.append(b"" if p in ("<unk>", "<s>", "</s>") else p.replace("▁", " ").encode())
    return out


def decode(table: list[bytes], ids: np.ndarray) -> bytes:
    """The text of ``ids`` in UTF-8, without the space that encoding puts in front."""
    return b"".join([table[i] for i in ids.tolist()])[1:]


def encoded(path: str, text: str = "text", id: str = "doc_id", dropout: float = DROPOUT, seed: int = SEED) -> Column:
    """Column ``struct<ids array<int>, crc bigint, text binary>``: pieces of a text, the CRC-32
    of their ids as little-endian 32-bit numbers, and what they decode to.

    Null and empty texts have no pieces. Segmentations depend on the text, the id (null
    counts as zero), the seed and the rate alone; at rate zero they are the model's own,
    except that a U+2581 in a text is coded by its bytes so that it comes back.
    """
    vocabulary = Vocabulary.load(path)

    def run(texts: pa.Array, docs: pa.Array) -> pa.Array:
        encoder, table = Encoder(vocabulary, dropout, seed), piece_bytes(vocabulary.pieces)
        ids, crcs, back = [], [], []
        for at in range(0, len(texts), 256):
            for got in encoder.encode(texts[at : at + 256].to_pylist(), docs[at : at + 256].to_pylist()):
                ids.append(pa.array(got))
                crcs.append(zlib.crc32(got.astype("<u4").tobytes()))
                back.append(decode(table, got))
        lists = pa.ListArray.from_arrays(
            np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32),
            pa.concat_arrays(ids) if ids else pa.array([], pa.int32()),
        )
        columns = [lists, pa.array(crcs, pa.int64()), pa.array(back, pa.binary())]
        return pa.StructArray.from_arrays(columns, names=["ids", "crc", "text"])

    wanted = "struct<ids:array<int>,crc:bigint,text:binary>"
    key = F.coalesce(F.col(id).cast("bigint"), F.lit(0).cast("bigint"))
    return F.arrow_udf(run, wanted)(text_or_empty(text), key)


def segmented(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``(id, n_pieces, ids_crc32, lossless, ids)`` for every row of ``docs``."""
    both = encoded(path, text, id, **settings).alias("e")
    whole = docs.select(F.col(id).alias("id"), text_or_empty(text).cast("binary").alias("t"), both)
    return whole.select(
        F.col("id").alias(id), F.size("e.ids").cast("bigint").alias("n_pieces"), F.col("e.crc").alias("ids_crc32"),
        (F.col("e.text") == F.col("t")).alias("lossless"), F.col("e.ids").alias("ids"),
    )
