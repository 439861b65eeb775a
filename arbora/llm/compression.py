"""Quality by compression: zstandard dictionaries of good and of bad text, calibrated.

A text that resembles good text shrinks more with the good dictionary. Texts are
compressed in pieces, so that what a dictionary knows counts alike at any length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import stored, text_or_empty

# Labelled rows of a class that are fitted on at most, and bytes of their whole texts.
SAMPLE_ROWS = 2_000
SAMPLE_BYTES = 8 << 20
# Characters that are fitted on of a text at most; longer ones give a piece from anywhere.
SAMPLE_CHARS = 1 << 20
DICTIONARY_BYTES = 112 * 1024
PIECE_BYTES = 1_024
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """Two dictionaries (none: empty bytes) and weights of (1, difference, two ratios)."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(samples)[:size]


class Sizer:
    """Features of a text from its compressed sizes."""

    def __init__(self, good: bytes, bad: bytes):
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False}
        self.plain = zstandard.ZstdCompressor(**plain)
        self.both = []
        for content in (good, bad):
            data = zstandard.ZstdCompressionDict(content) if content else None
            if data:
                data.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(**plain, dict_data=data, write_dict_id=False))

    def features(self, text: bytes) -> tuple[float, float, float, float]:
        good = bad = 0
        for at in range(0, len(text), PIECE_BYTES):
            piece = text[at : at + PIECE_BYTES]
            good += len(self.both[0].compress(piece))
            bad += len(self.both[1].compress(piece))
        whole = len(self.plain.compress(text))
        n = len(text) + 16
        return (
            1.0,
            10.0 * (bad - good) / max(1, bad + good),
            math.log((good + 16) / n),
            math.log((whole + 16) / n),
        )


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 0.01) -> np.ndarray:
    """Weights by Newton's method, with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(slope, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id: str) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(
    docs: DataFrame,
    labels: DataFrame,
    id: str,
    text: str,
    label: str,
    rows: int,
    chars: int = SAMPLE_CHARS,
    size: int = SAMPLE_BYTES,
) -> DataFrame:
    """``(text, label)`` of up to ``rows`` labelled rows a class outside the held-out fold.

    The ids with the smallest hashes are taken, so the choice is bounded and repeatable;
    of rows that share an id, the one with the smallest text hash;
    of those, whole texts of up to ``size`` bytes a class, in the order of the hashes. A
    text of more than ``chars`` characters gives a piece from a place that its hash tells.
    """
    usable = labels.where(~held_out(id)).groupBy(id).agg(F.min(label).alias("__label")).where(F.col(id).isNotNull())
    chosen = None
    for kind in (0, 1):
        part = usable.where(F.col("__label") == kind).orderBy(F.xxhash64(id), id).limit(rows)
        chosen = part if chosen is None else chosen.unionAll(part)
    whole = docs.select(id, text_or_empty(text).alias("__text")).join(F.broadcast(chosen), id)
    room = F.greatest(F.lit(0), F.length("__text") - chars)
    start = (1 + F.pmod(F.xxhash64("__text"), room + 1)).cast("int")
    texts = whole.withColumn("__text", F.when(room > 0, F.substring("__text", start, F.lit(chars))).otherwise(F.col("__text")))
    one = F.min_by("__text", F.xxhash64("__text")).alias("text")
    found = stored(texts.groupBy(id, F.col("__label").alias("label")).agg(one).select(id, "text", "label"))
    before = Window.partitionBy("label").orderBy(F.xxhash64(id), id)
    sizes = found.select(id, "label", F.octet_length("text").cast("bigint").alias("bytes"))
    fits = sizes.select(id, F.sum("bytes").over(before).alias("sum")).where(F.col("sum") <= size).select(id)
    return found.join(F.broadcast(fits), id).select(id, "text", "label")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rows: int = SAMPLE_ROWS,
    chars: int = SAMPLE_CHARS,
    size: int = SAMPLE_BYTES,
) -> Model:
    """Train both dictionaries on one half of the sample, the calibration on the other.

    At most ``2 * rows`` texts and ``2 * size`` bytes come to the driver. Without rows of
    both classes there is nothing to compare: every score is then the share of good rows,
    or one half without any labels.
    """
    got = sorted((r[0], r[1].encode(), r[2]) for r in sample(docs, labels, id, text, label, rows, chars, size).collect())
    good, bad = ([t for _, t, y in got if y == kind] for kind in (1, 0))
    if not good or not bad:
        share = (len(good) + 1) / (len(good) + len(bad) + 2)
        return Model(b"", b"", (math.log(share / (1 - share)), 0.0, 0.0, 0.0))
    model = Model(dictionary(good[::2]), dictionary(bad[::2]), ())
    sizer = Sizer(model.good, model.bad)
    rest = [(t, 1.0) for t in good[1::2] or good] + [(t, 0.0) for t in bad[1::2] or bad]
    x = np.array([sizer.features(t) for t, _ in rest])
    weights = logistic(x, np.array([y for _, y in rest]))
    return Model(model.good, model.bad, tuple(float(w) for w in weights))


def score(model: Model, text: str = "text") -> Column:
    """Column of scores between 0 and 1. A null text counts as empty; whole texts are read."""

    def run(texts: pa.Array) -> pa.Array:
        sizer = Sizer(model.good, model.bad)
        out = np.empty(len(texts))
        for i, value in enumerate(texts.cast(pa.large_binary())):
            x = sizer.features(value.as_py() or b"")
            z = sum(a * b for a, b in zip(x, model.weights))
            out[i] = 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))
        return pa.array(out)

    return F.arrow_udf(run, "double")(text_or_empty(text))


def scored(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row of ``docs``, in any number."""
    model = fit(docs, labels, id, text)
    rows = docs.select(id, held_out(id).alias("held_out"), score(model, text).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def kept_documents(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` predicted to be good, with all their columns."""
    return docs.where(score(fit(docs, labels, id, text), text) >= 0.5)
