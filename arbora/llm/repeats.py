"""Numpy kernels for repeated stretches: rolling hashes, winnowed anchors, blocks.

A text is a sequence of 64-bit symbols (bytes or words). A *window* is ``length``
consecutive symbols. Its *anchor* is the place of the smallest hash of ``k`` symbols
inside it, the leftmost of equals; it depends on the window's content alone, so equal
windows have equal anchors at equal offsets. Neighbouring windows with one anchor form a
*block*: first window, last window, hash of the anchor, hash of all symbols they cover.
There is about one block per ``(length - k + 2) / 2`` symbols, and every window lies in
exactly one of them. Two windows can be equal only if their blocks' anchor hashes are.

Stretches are hashed by polynomials modulo 2**64, from prefix sums in one multiplication.
Such hashes alone agree on sequences that are built for it (Thue-Morse words), so a second
one takes symbols that mix three neighbours, where those no longer cancel. Words get their
symbols from a hash that mixes every eight bytes.
"""

from __future__ import annotations

import numpy as np
import xxhash

# Two odd multipliers, and the shifts and factor of the final mixing.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
FACTOR = 0xBF58476D1CE4E5B9
# Symbols hashed at once; longer texts are taken in pieces that overlap by a window.
PIECE = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of ``x`` over all bits; one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(FACTOR)
    return x ^ (x >> np.uint64(29))


class Powers(dict):
    """``base ** i`` and its inverse modulo 2**64 for i below n, by (base, n); travels empty."""

    def __missing__(self, key: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        base, n = key
        out = []
        for factor in (base, pow(base, -1, 1 << 64)):
            row = np.full(n, factor, dtype=np.uint64)
            row[0] = 1
            out.append(np.multiply.accumulate(row))
        self[key] = tuple(out)
        return self[key]

    def __reduce__(self):
        return (Powers, ())


POWERS = Powers()


class Rolling:
    """Hash of any stretch ``[start, end)`` of up to ``PIECE`` + a window of symbols."""

    def __init__(self, symbols: np.ndarray, base: int = BASES[0]):
        size = 1 << 12
        while size < len(symbols) + 1:
            size *= 2
        up, self.down = POWERS[base, size]
        self.sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def all(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mixed((self.sums[k:] - self.sums[:-k]) * self.down[:n])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def neighbours(symbols: np.ndarray) -> np.ndarray:
    """A symbol per three consecutive ones, from which sums don't cancel."""
    pairs = mixed(symbols[:-2] * np.uint64(BASES[1]) + symbols[1:-1])
    return mixed(mixed(pairs ^ symbols[2:]) * np.uint64(BASES[0]))


class Twice:
    """Two hashes of any stretch of at least three symbols, one of them of ``neighbours``."""

    def __init__(self, symbols: np.ndarray):
        self.plain = Rolling(symbols, BASES[0])
        self.mixed = Rolling(neighbours(symbols), BASES[1])

    def at(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.plain.at(start, end), self.mixed.at(start, end - 2)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def blocks(symbols: np.ndarray, ends: np.ndarray, length: int, k: int):
    """Blocks of texts that lie one after the other in ``symbols`` and end at ``ends``.

    Returns ``(text, first, last, anchor, whole)``: index of the text, first and last
    window start (places in ``symbols``), the two hashes. Texts shorter than a window
    have none.
    """
    empty = np.zeros(0, dtype=np.int64)
    nothing = (empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    if len(symbols) < length:
        return nothing
    begins = np.concatenate([[0], ends[:-1]])
    fits = ends - begins >= length
    if not fits.any():
        return nothing
    counts = np.where(fits, ends - begins - length + 1, 0)
    text = np.repeat(np.arange(len(ends)), counts)
    jump = np.cumsum(counts) - counts
    starts = np.arange(len(text)) - jump[text] + begins[text]
    rolling = Twice(symbols)
    grams = rolling.plain.all(k)
    width = length - k + 1
    least = sliding_min(grams, width)
    own = least[starts]
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = text[1:] != text[:-1]
    inner = np.flatnonzero(~fresh)
    before = starts[inner] - 1
    fresh[inner] = (own[inner] != own[inner - 1]) | (grams[before] == own[inner - 1])
    at = np.flatnonzero(fresh)
    first, last = starts[at], starts[np.append(at[1:], len(starts)) - 1]
    anchor = own[at]
    one, two = rolling.at(first, last + length)
    return text[at], first, last, anchor, one ^ mixed(two)


def runs(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge stretches ``[first, end)``, sorted by ``first``, that overlap or touch."""
    if not len(first):
        return first, end
    reach = np.maximum.accumulate(end)
    new = np.ones(len(first), dtype=bool)
    new[1:] = first[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return first[at], reach[np.append(at[1:], len(first)) - 1]


# Symbols of the 256 byte values: fixed random-looking numbers, made by the mixing itself.
BYTE_SYMBOLS = mixed(mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[1])))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


# Bytes of a word that are hashed with all others; of longer words, one at a time.
SHORT = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word ``data[start:end]``: every eight bytes are mixed in twice."""
    lanes = np.ndarray(len(data) + 1, dtype="<u8", buffer=data.tobytes() + bytes(8), strides=(1,))
    size = ends - starts
    state = mixed(size.astype(np.uint64) * np.uint64(BASES[0]) + np.uint64(1))
    kept = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
    at = np.flatnonzero(size <= SHORT)
    done = 0
    while len(at):
        chunk = lanes[starts[at] + done] & kept[np.minimum(size[at] - done, 8)]
        state[at] = mixed(mixed(state[at] ^ chunk) * np.uint64(BASES[1]))
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > SHORT):
        state[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return state


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A symbol per word of the texts that ``offsets`` mark in ``data``, and their ends."""
    inside = ~SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = offsets[:-1][(offsets[:-1] < len(data)) & (offsets[:-1] < offsets[1:])]
    begin[edge] |= inside[edge]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    tail = edge[edge > 0] - 1
    end[tail] |= inside[tail]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    symbols = word_hashes(data, starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
    return symbols, np.searchsorted(starts, offsets[1:])


def long_word_symbols(data: np.ndarray) -> np.ndarray:
    """Symbols of one long text, taken in pieces that end between words."""
    spaces = np.flatnonzero(SPACE[data])
    parts, at = [], 0
    while at < len(data):
        end = len(data)
        if end - at > PIECE:
            i = np.searchsorted(spaces, at + PIECE)
            end = int(spaces[i]) if i < len(spaces) else end
            end = max(end, at + 1)
        parts.append(word_symbols(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(parts)


def symbol_pieces(data: np.ndarray, offsets: np.ndarray, words: bool, length: int):
    """Symbols of texts, about ``PIECE`` bytes at once.

    Yields ``(texts, bases, symbols, ends)``: the numbers of the texts that follow each
    other in ``symbols``, and how many symbols of the text come before. Pieces of a longer
    text overlap by a window less one, so that each window lies in exactly one.
    """
    n, i = len(offsets) - 1, 0
    while i < n:
        if offsets[i + 1] - offsets[i] > PIECE:
            text = data[offsets[i] : offsets[i + 1]]
            symbols = long_word_symbols(text) if words else None
            count = len(symbols) if words else len(text)
            for base in range(0, max(1, count - length + 1), PIECE):
                upto = min(count, base + PIECE + length - 1)
                part = symbols[base:upto] if words else BYTE_SYMBOLS[text[base:upto]]
                yield np.array([i]), np.array([base]), part, np.array([len(part)])
            i += 1
            continue
        j = int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1
        j = min(max(j, i + 1), n)
        part, marks = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if words:
            symbols, ends = word_symbols(part, marks)
        else:
            symbols, ends = BYTE_SYMBOLS[part], marks[1:]
        yield np.arange(i, j), np.zeros(j - i, dtype=np.int64), symbols, ends
        i = j


def text_buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow array of strings without nulls."""
    import pyarrow as pa

    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
