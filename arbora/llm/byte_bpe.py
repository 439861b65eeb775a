"""Byte-level BPE, encoded without regular expressions and decoded from offsets.

Texts become arrays of codepoint classes. The split pattern (contractions, letters,
numbers and other signs with a space in front, white space but for its last character) is
an automaton of ten states. What a stretch of text does to the state is a function, and
functions compose associatively: there are few different ones, so they are numbered once
and a prefix scan looks their products up in a table, in blocks that run side by side.
Boundaries follow from neighbouring states. The slices between them are merged pair by
pair, each different one once per worker and remembered.
"""

from __future__ import annotations

import base64
import heapq
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import text_or_empty

# Codepoints scanned at once, and the length of the blocks that are scanned side by side.
PIECE = 1 << 19
BLOCK = 128
# Slices a Python worker remembers, and the longest of them in characters.
MEMO_SLICES = 400_000
MEMO_CHARS = 32
# Bytes of a slice from which pairs wait in a heap.
LONG_SLICE = 200

# Classes of codepoints. RESET stands before each text, and letters of contractions apart.
RESET, LETTER, NUMBER, OTHER, SPACE, WHITE, APOSTROPHE, SINGLE, R_OR_V, E, L = range(11)
LETTERS = (LETTER, SINGLE, R_OR_V, E, L)
# States after a character: what the open token is. QUOTE is an apostrophe that begins a
# token, NEEDS_E and NEEDS_L a contraction that lacks a letter, CLOSED a whole one.
START, WORD, DIGITS, SIGNS, BLANK, GAP, QUOTE, NEEDS_E, NEEDS_L, CLOSED = range(10)
STATES = 10
# Whether a token begins before a character: no, yes, unless the next one completes a
# contraction, if the next one is no white space.
JOINED, BEGINS, UNLESS_CLOSED, IF_LAST = range(4)


def step(state: int, kind: int) -> tuple[int, int]:
    """Next state, and whether a token begins before the character."""
    if kind == RESET:
        return START, BEGINS
    if kind in LETTERS:
        if state == QUOTE and kind == SINGLE:
            return CLOSED, JOINED
        if state == QUOTE and kind == R_OR_V:
            return NEEDS_E, UNLESS_CLOSED
        if state == QUOTE and kind == L:
            return NEEDS_L, UNLESS_CLOSED
        if (state, kind) in ((NEEDS_E, E), (NEEDS_L, L)):
            return CLOSED, JOINED
        return WORD, JOINED if state in (WORD, BLANK, NEEDS_E, NEEDS_L) else BEGINS
    if kind == NUMBER:
        return DIGITS, JOINED if state in (DIGITS, BLANK) else BEGINS
    if kind in (OTHER, APOSTROPHE):
        if state in (SIGNS, BLANK, QUOTE):
            return SIGNS, JOINED
        return (QUOTE if kind == APOSTROPHE else SIGNS), BEGINS
    return (BLANK if kind == SPACE else GAP), IF_LAST if state in (BLANK, GAP) else BEGINS


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(of_class, product, apply, begins)``: the function of each class, the function of
    one after another, the state it leads to, and what ``step`` says of token starts."""
    kinds = range(11)
    generators = [tuple(step(s, k)[0] for s in range(STATES)) for k in kinds]
    names: dict[tuple, int] = {}
    for f in [tuple(range(STATES)), *generators]:
        names.setdefault(f, len(names))
    known = list(names)
    for f in known:  # grows until products lead to nothing new
        for g in generators:
            both = tuple(g[s] for s in f)
            if both not in names:
                names[both] = len(names)
                known.append(both)
    apply = np.array(known, dtype=np.uint8)
    product = np.array([[names[tuple(g[s] for s in f)] for g in known] for f in known], dtype=np.uint16)
    of_class = np.array([names[g] for g in generators], dtype=np.uint16)
    begins = np.array([[step(s, k)[1] for k in kinds] for s in range(STATES)], dtype=np.uint8)
    return of_class, product, apply, begins


def prefix_products(functions: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Number of the product of the functions up to each place."""
    n, m = len(functions), len(product)
    blocks = -(-n // BLOCK)
    padded = np.zeros(BLOCK * blocks, dtype=np.int64)  # function 0 changes nothing
    padded[:n] = functions
    grid = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    flat = product.reshape(-1)
    for j in range(1, BLOCK):
        grid[j] = flat[grid[j - 1] * m + grid[j]]
    if blocks > 1:
        before = np.zeros(blocks, dtype=np.int64)
        before[1:] = prefix_products(grid[-1, :-1], product)
        grid = flat[before * m + grid]
    return grid.T.reshape(-1)[:n]


def token_starts(classes: np.ndarray, state: int = START) -> tuple[np.ndarray, int]:
    """Places where tokens begin, in ``classes`` of which the last one only looks ahead;
    and the state before that one. ``state`` is that before the first."""
    of_class, product, apply, begins = automaton()
    after = apply[prefix_products(of_class[classes], product), state]
    before = np.empty_like(after)
    before[0] = state
    before[1:] = after[:-1]
    said = begins[before[:-1], classes[:-1]]
    starts = said == BEGINS
    at = np.flatnonzero(said == UNLESS_CLOSED)
    starts[at] = after[at + 1] != CLOSED
    at = np.flatnonzero(said == IF_LAST)
    following = classes[at + 1]
    starts[at] = (following != SPACE) & (following != WHITE) & (following != RESET)
    return np.flatnonzero(starts), int(before[-1])


@cache
def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """Where the class of codepoints changes, and to which; letters, numbers and white space
    as the Unicode tables of the tiktoken library have them."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    classes = np.full(0x110001, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        members = bytes(found.encode_ordinary(every)).decode()
        classes[np.frombuffer(members.encode("utf-32-le"), dtype=np.uint32)] = kind
    for letters, kind in (("'", APOSTROPHE), (" ", SPACE), ("stmd", SINGLE), ("rv", R_OR_V), ("e", E), ("l", L)):
        classes[[ord(c) for c in letters]] = kind
    classes[0x110000] = RESET
    at = np.flatnonzero(np.diff(classes, prepend=classes[0] + 1))
    return at, classes[at]


def class_table(runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    at, kinds = runs
    return np.repeat(kinds, np.diff(np.append(at, 0x110001)))


class ByteEncoder:
    """Ids of texts by merge ranks; slices seen before come from memory."""

    def __init__(self, path: str, runs: tuple[np.ndarray, np.ndarray]):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.classes = class_table(runs)
        self.memo: dict[str, bytes] = {}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def slices(self, texts: list[str]) -> list[list[str]]:
        """The tokens' texts before merging, per text, from scans over some texts at once."""
        out: list[list[str]] = []
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= PIECE:
                size += len(texts[end])
                end += 1
            out += self.cut(texts[at:end])
            at = end
        return out

    def cut(self, texts: list[str]) -> list[list[str]]:
        reset = b"\x00\x00\x11\x00"
        coded = reset + b"".join(t.encode("utf-32-le", "surrogatepass") + reset for t in texts)
        points = np.frombuffer(coded, dtype=np.uint32)
        starts, state = [], START
        for first in range(0, len(points) - 1, PIECE):
            upto = min(len(points), first + PIECE + 1)
            found, state = token_starts(self.classes[points[first:upto]], state)
            starts.append(found + first)
        starts = np.concatenate(starts)
        place = np.cumsum([1, *(len(t) + 1 for t in texts)])
        bounds = np.searchsorted(starts, place)
        out = []
        for text, origin, low, high in zip(texts, place.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            marks = (starts[low:high] - origin).tolist()
            if marks and marks[-1] == len(text):
                marks.pop()  # the reset after the text
            out.append([text[a:b] for a, b in zip(marks, [*marks[1:], len(text)])])
        return out

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one slice: the adjacent pair of the lowest rank, the leftmost of equals,
        is merged as long as there is one."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > LONG_SLICE:
            return self.merged_long(piece)
        none = len(self.sizes)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def merged_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs and linked parts: n log n."""
        ranks, n = self.ranks, len(piece)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
        heapq.heapify(waiting)
        gone = bytearray(n + 1)
        while waiting:
            _, i, upto = heapq.heappop(waiting)
            j = after[i] if not gone[i] else n
            if j >= n or end[j] != upto:
                continue  # one of the two has been merged since
            gone[j] = 1
            end[i], after[i] = upto, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (rank := ranks.get(piece[a : end[b]])) is not None:
                    heapq.heappush(waiting, (rank, a, end[b]))
        return [ranks[piece[i : end[i]]] for i in range(n) if not gone[i]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        memo, out = self.memo, []
        for pieces in self.slices(texts):
            found = list(map(memo.get, pieces))
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                piece = pieces[at]
                ids = memo.get(piece)
                if ids is None:
                    ids = np.array(self.merged(piece.encode("utf-8")), dtype="<u4").tobytes()
                    if len(piece) <= MEMO_CHARS:
                        if len(memo) >= MEMO_SLICES:
                            memo.clear()
                        memo[piece] = ids
                found[at] = ids
            out.append(b"".join(found))
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte of the text at which each token begins, and its size at the end."""
        return np.concatenate([[0], np.cumsum(self.sizes[ids])]).astype("<u4")

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of consecutive tokens, each copied to its offset; the last offset is their end."""
        offsets = offsets.astype(np.int64)
        sizes = np.diff(offsets)
        source = np.repeat(self.begins[ids] - offsets[:-1], sizes) + np.arange(offsets[0], offsets[-1])
        return self.bytes[source].tobytes()


def worker_encoder(path: str, runs: tuple[np.ndarray, np.ndarray]) -> ByteEncoder:
    """The encoder of this Python worker, which outlives a task."""
    held = sys.__dict__.setdefault("_arbora_byte_encoders", {})
    if path not in held:
        held[path] = ByteEncoder(path, runs)
    return held[path]


def encoded(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_tokens, ids, offsets)`` for every row of ``docs``.

    ``ids`` and ``offsets`` are binary (little-endian 32-bit integers); the latter are the
    byte of the text at which each token begins, and the size of the text in the end, so
    that any run of tokens can be decoded by itself. Ids are those of the rank file at ``path``, which every executor must have, each match of
    the split pattern by itself and without special tokens. A null text counts as empty and
    has no ids and the one offset 0. Rows that repeat an id, or have none, are rows of
    their own. Nothing is shuffled.
    """
    runs = class_runs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, runs)
        for batch in batches:
            for part in bounded(batch, "text"):
                ids = encoder.encode(part["text"].to_pylist())
                marks = [encoder.offsets(np.frombuffer(i, dtype="<u4")) for i in ids]
                columns = [
                    part["id"],
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([m.tobytes() for m in marks], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids", "offsets"])

    rows = docs.select(F.col(id).alias("id"), text_or_empty(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary, offsets binary")
    return found.withColumnRenamed("id", id)


def bounded(batch: pa.RecordBatch, column: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``size`` bytes in ``column``, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    share = np.cumsum(lengths, dtype=np.int64) // size
    edges = np.flatnonzero(np.diff(share, prepend=-1)).tolist()
    for low, high in zip(edges, [*edges[1:], len(lengths)]):
        yield batch.slice(low, high - low)


def decoded(tokens: DataFrame, path: str, id: str = "doc_id") -> DataFrame:
    """``tokens``, as ``encoded`` gives them, with the decoded bytes in ``bytes``."""
    runs = class_runs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, runs)
        for batch in batches:
            for part in bounded(batch, "ids"):
                ids = [np.frombuffer(i, dtype="<u4") for i in part["ids"].to_pylist()]
                marks = [np.frombuffer(m, dtype="<u4") for m in part["offsets"].to_pylist()]
                whole = pa.array([encoder.decode(i, m) for i, m in zip(ids, marks)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, whole], names=[*part.schema.names, "bytes"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(run, f"{kinds}, bytes binary")


def round_trip(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: texts encoded, and the ids decoded."""
    found = decoded(encoded(docs, path, id, text), path, id)
    return found.select(
        id, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )
