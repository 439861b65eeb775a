"""All windows that repeat in a table of texts, found without forming pairs.

Seeds are the anchors of ``repeats.blocks``. Blocks whose anchors repeat are extended:
first to their whole extent, by its hash, which settles copies of any number at once;
then, for one representative of each extent in anchor groups with several, window by
window. Equal windows share the anchor, so nothing outside its group matters.

Every shuffle is by a hash and reduced before it, or joined so that Spark splits hot keys;
what travels is one narrow row per block, and content only of representatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm import repeats
from arbora.llm.common import stored

# Representatives of an anchor that one task compares; larger groups go by window rows.
GROUP = 2_048
# Symbols that a task compares at once.
COMPARED = 1 << 18


@dataclass(frozen=True)
class Windows:
    """Windows of ``length`` words or bytes; anchors are hashes of ``k`` of them."""

    words: bool
    length: int
    k: int
    # Whether all windows of equal content count, or all but the first.
    keep_first: bool


def join_rows(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """Join of two tables that grow with the corpus: a sort-merge join at any size, whose
    skewed partitions Spark splits."""
    return left.join(right.hint("merge"), keys, how)


def block_table(rows: DataFrame, windows: Windows) -> DataFrame:
    """``(doc, first, last, anchor, whole)`` for every block of ``rows(doc, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch["doc"].to_numpy()
            data, offsets = repeats.text_buffers(batch["text"])
            for texts, bases, symbols, ends in repeats.symbol_pieces(data, offsets, windows.words, windows.length):
                text, first, last, anchor, whole = repeats.blocks(symbols, ends, windows.length, windows.k)
                shift = bases[text] - np.concatenate([[0], ends[:-1]])[text]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs[texts[text]]),
                        pa.array((first + shift).astype(np.int32)),
                        pa.array((last + shift).astype(np.int32)),
                        pa.array(anchor.view(np.int64)),
                        pa.array(whole.view(np.int64)),
                    ],
                    names=["doc", "first", "last", "anchor", "whole"],
                )

    return rows.select("doc", "text").mapInArrow(run, "doc long, first int, last int, anchor long, whole long")


def anchor_entries(rows: DataFrame, windows: Windows) -> DataFrame:
    """``(anchor, n, low, high)``: blocks of each anchor, least and greatest extent hash."""
    found = block_table(rows, windows).select("anchor", "whole")
    return found.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high")
    )


def window_hashes(symbols: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the windows that begin at ``starts``."""
    return repeats.Twice(symbols).at(starts, starts + length)


def representatives(texts: DataFrame, notes: DataFrame, windows: Windows, large: bool) -> DataFrame:
    """Content of representatives in small anchor groups, or window rows of the large ones.

    ``notes(doc, reps)`` lists a document's representatives as (anchor, first, last, large).
    """
    some = notes.select("doc", F.filter("reps", lambda r: r["large"] == F.lit(large)).alias("reps"))
    joined = join_rows(texts.select("doc", "text"), some.where(F.size("reps") > 0), "doc")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, lists = batch["doc"].to_pylist(), batch["reps"].to_pylist()
            data, offsets = repeats.text_buffers(batch["text"])
            for i, (doc, reps) in enumerate(zip(docs, lists)):
                own = data[offsets[i] : offsets[i + 1]]
                symbols = repeats.long_word_symbols(own) if windows.words else own
                if large:
                    yield from window_rows(doc, symbols, reps)
                    continue
                parts = [symbols[r["first"] : r["last"] + windows.length].tobytes() for r in reps]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["anchor"] for r in reps], pa.int64()),
                        pa.array([doc] * len(reps), pa.int64()),
                        pa.array([r["first"] for r in reps], pa.int32()),
                        pa.array(parts, pa.binary()),
                    ],
                    names=["anchor", "doc", "first", "content"],
                )

    def window_rows(doc: int, symbols: np.ndarray, reps: list[dict]) -> Iterator[pa.RecordBatch]:
        for r in reps:
            own = symbols[r["first"] : r["last"] + windows.length]
            own = own if windows.words else repeats.BYTE_SYMBOLS[own]
            starts = np.arange(r["last"] - r["first"] + 1)
            one, two = window_hashes(own, starts, windows.length)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    pa.array(np.full(len(starts), doc)),
                    pa.array((starts + r["first"]).astype(np.int32)),
                ],
                names=["one", "two", "doc", "start"],
            )

    schema = "one long, two long, doc long, start int" if large else "anchor long, doc long, first int, content binary"
    return joined.mapInArrow(contents, schema)


def repeated_in_groups(data: pa.Table, windows: Windows) -> pa.RecordBatch:
    """Stretches of repeated windows in whole anchor groups, sorted by anchor, doc, place."""
    anchor, doc, first = (data[c].to_numpy() for c in ("anchor", "doc", "first"))
    content, offsets = repeats.text_buffers(data["content"].combine_chunks())
    if windows.words:
        symbols, offsets = np.frombuffer(content.tobytes(), dtype=np.uint64), offsets // 8
    else:
        symbols = repeats.BYTE_SYMBOLS[content]
    counts = np.diff(offsets) - windows.length + 1
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
    one, two = window_hashes(symbols, offsets[row] + place, windows.length)
    key = one ^ repeats.mixed(two) ^ repeats.mixed(repeats.mixed(anchor.view(np.uint64)))[row]
    order = np.argsort(key, kind="stable")
    a, b = order[:-1], order[1:]
    same = (key[a] == key[b]) & (one[a] == one[b]) & (two[a] == two[b]) & (anchor[row[a]] == anchor[row[b]])
    hit = np.zeros(len(row), dtype=bool)
    hit[b[same]] = True
    if not windows.keep_first:
        hit[a[same]] = True
    at = np.flatnonzero(hit)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])
    begin = np.flatnonzero(new)
    upto = np.append(begin[1:], len(at))[: len(begin)] - 1
    low, high = at[begin], at[upto]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc[row[low]]),
            pa.array((first[row[low]] + place[low]).astype(np.int32)),
            pa.array((first[row[high]] + place[high] + windows.length).astype(np.int32)),
        ],
        names=["doc", "first", "end"],
    )


def compare_groups(contents: DataFrame, windows: Windows) -> DataFrame:
    """``(doc, first, end)`` of repeated windows among ``representatives``."""
    width = 8 if windows.words else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch["content"].nbytes
            if size < COMPARED * width:
                continue
            data = pa.Table.from_batches(held)
            anchor = data["anchor"].to_numpy()
            ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))
            begin = 0
            for i, end in enumerate(ends[:-1]):  # the last group may go on
                if i == len(ends) - 2 or data.slice(begin, ends[i + 1] - begin)["content"].nbytes > COMPARED * width:
                    yield repeated_in_groups(data.slice(begin, end - begin), windows)
                    begin = int(end)
            rest = data.slice(begin)
            held, size = rest.to_batches(), rest["content"].nbytes
        if size or held:
            data = pa.Table.from_batches(held)
            if len(data):
                yield repeated_in_groups(data, windows)

    dealt = contents.repartition("anchor").sortWithinPartitions("anchor", "doc", "first")
    return dealt.mapInArrow(run, "doc long, first int, end int")


def merged(stretches: DataFrame) -> DataFrame:
    """``(doc, firsts, ends)``: each document's stretches, merged, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, ends = [], []
            for packed in batch["packed"]:
                values = np.sort(packed.values.to_numpy())
                first, end = repeats.runs(values >> 32, values & 0xFFFFFFFF)
                firsts.append(first.astype(np.int32))
                ends.append(end.astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], pa.array(firsts, kind), pa.array(ends, kind)], names=["doc", "firsts", "ends"]
            )

    packed = F.shiftleft(F.col("first").cast("bigint"), 32).bitwiseOR(F.col("end").cast("bigint"))
    lists = stretches.groupBy("doc").agg(F.collect_list(packed).alias("packed"))
    return lists.mapInArrow(run, "doc long, firsts array<int>, ends array<int>")


def repeated_stretches(
    rows: DataFrame, texts: DataFrame, seeds: DataFrame, windows: Windows, group: int = GROUP
) -> DataFrame:
    """Written table ``(doc, firsts, ends)`` of what repeated windows cover in ``rows(doc, text)``.

    ``texts`` are the same rows, bucketed by ``doc``. ``seeds`` are the anchor entries with
    n > 1. Places count words or bytes. With ``keep_first`` the occurrence with the smallest
    (doc, place) isn't counted.
    """
    plain = (F.col("low") == F.col("high")).alias("plain")
    found = stored(join_rows(block_table(rows, windows), seeds.select("anchor", plain), "anchor"))
    place = F.struct("doc", "first", "last")
    classes = found if windows.keep_first else found.where("not plain")
    classes = stored(
        classes.groupBy("anchor", "whole", "plain").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("rep"))
    )
    many = classes.where("n > 1").select("anchor", "whole", F.col("rep.doc").alias("d"), F.col("rep.first").alias("f"))
    stretch = ["doc", "first", (F.col("last") + windows.length).alias("end")]
    if windows.keep_first:
        copies = join_rows(found, many, ["anchor", "whole"]).where("doc <> d or first <> f").select(*stretch)
    else:
        copies = join_rows(found.where("not plain"), many, ["anchor", "whole"]).select(*stretch)
        copies = copies.unionAll(found.where("plain").select(*stretch))
    open_classes = classes.where("not plain")
    counted = open_classes.groupBy("anchor").agg((F.count(F.lit(1)) > group).alias("large"))
    reps = join_rows(open_classes, counted, "anchor").select("anchor", "rep.*", "large")
    listed = reps.groupBy("doc").agg(F.collect_list(F.struct("anchor", "first", "last", "large")).alias("reps"))
    listed = stored(listed)
    partial = compare_groups(representatives(texts, listed, windows, False), windows)
    stretches = copies.unionAll(partial)
    if not listed.where(F.exists("reps", lambda r: r["large"])).isEmpty():
        each = stored(representatives(texts, listed, windows, True))
        twice = each.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "start")).alias("m"))
        twice = twice.where("n > 1").select("one", "two", F.col("m.doc").alias("d"), F.col("m.start").alias("s"))
        hits = join_rows(each, twice, ["one", "two"])
        hits = hits.where("doc <> d or start <> s") if windows.keep_first else hits
        stretches = stretches.unionAll(
            hits.select("doc", F.col("start").alias("first"), (F.col("start") + windows.length).alias("end"))
        )
    return stored(merged(stretches))


def cut_texts(texts: DataFrame, stretches: DataFrame, cut, schema: str) -> DataFrame:
    """Apply ``cut(text, firsts, ends) -> tuple`` to every row of ``texts(doc, id, text)``;
    documents without stretches get empty lists. Returns ``id`` and the columns of ``schema``."""
    joined = join_rows(texts, stretches, "doc", "left")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        for batch in batches:
            whole = batch["text"].cast(pa.large_binary())
            out = [
                cut(t.as_py(), f or [], e or [])
                for t, f, e in zip(whole, batch["firsts"].to_pylist(), batch["ends"].to_pylist())
            ]
            columns = list(zip(*out)) if out else [[] for _ in names]
            arrays = [pa.array(c, kinds[part.split()[1]]) for c, part in zip(columns, schema.split(", "))]
            yield pa.RecordBatch.from_arrays([batch["id"], *arrays], names=["id", *names])

    return joined.mapInArrow(run, f"id long, {schema}")
