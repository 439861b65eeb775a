"""Conversation structure repair as lightest derivations.

Roles of a repaired conversation read ``(s?(ua)+)?`` by their initials. What can be done
about the rows is a weighted hypergraph: axioms are single edits of a row (keep, rerole,
delete) and insertions between rows, an item "the first i rows lead to state q" follows
from such an item and an edit that begins in its state, and the goal from the item of all
rows in an accepting state. Weights are (cost, audit), audits being the initials of the
edits; they add up by addition and concatenation. Knuth's agenda pops the lightest item
first, which is final, until the goal is.

A conversation may be of any length. Rows are put in order by one range sort and cut into
blocks; each block is solved from every state, which gives edits of whole blocks, and
consecutive blocks are solved again by the same agenda, until one is left of each
conversation. Only letters travel between blocks, not texts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from arbora.llm.common import numbered, stored
from arbora.runtime import lookup

# Rows of a block, and blocks that are solved together.
BLOCK_BITS = 8
FAN_BITS = 6
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
# What a sequence of roles has come to: nothing yet, a system turn, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ACCEPTING = (START, ASSISTANT)
INSERTIONS = [(p, q, INSERT_COST, INSERT) for (role, p), q in NEXT.items() if role in "ua"]
# Faults of a row, in the order in which they count.
BLANK, DUPLICATE, TRUNCATED, SOUND = "b", "d", "t", "-"
# The characters that don't count as text, as in the other operators.
SPACES = " \t\n\x0b\x0c\r"

Edit = tuple[int, int, int, str]  # from state, to state, cost, audit


def lightest(columns: list[list[Edit]], start: int, goals: tuple[int, ...] = ()) -> dict[int, tuple[int, str]]:
    """Lightest ``(cost, audit)`` of taking one edit of each column in turn, and insertions
    anywhere, from state ``start`` to each state.

    With ``goals`` the search ends when the lightest of these states is final, and only
    that one is returned. Weights are ordered by cost, number of columns, audit. The middle
    one is the same for all derivations of an item, so it decides nothing between them, and
    it makes every deduction's weight at least that of each premise (appending to a row's
    own letter alone doesn't: "KR" comes before "R"), as the agenda needs.
    """
    n = len(columns)
    agenda: list[tuple] = [(0, 0, "", "prefix", 0, start)]
    agenda += [(edit[2], 1, edit[3], "edit", i, k) for i, c in enumerate(columns) for k, edit in enumerate(c)]
    agenda += [(edit[2], 0, edit[3], "insertion", -1, k) for k, edit in enumerate(INSERTIONS)]
    heapq.heapify(agenda)
    final: dict[tuple, tuple[int, str]] = {}
    edits: dict[tuple[int, int], list[Edit]] = defaultdict(list)  # final ones, by column and state
    insertions: dict[int, list[Edit]] = defaultdict(list)
    reached: dict[int, list[int]] = defaultdict(list)  # columns of final prefixes, by state

    def deduce(i: int, p: int, edit: Edit, width: int) -> None:
        cost, audit = final["prefix", i, p]
        heapq.heappush(agenda, (cost + edit[2], i + width, audit + edit[3], "prefix", i + width, edit[1]))

    while agenda:
        cost, _, audit, kind, i, x = heapq.heappop(agenda)
        if (kind, i, x) in final:
            continue
        final[kind, i, x] = cost, audit
        if kind == "goal":
            return {x: (cost, audit)}
        if kind == "prefix":
            reached[x].append(i)
            if i == n and x in goals:
                heapq.heappush(agenda, (cost, n, audit, "goal", n, x))
            for edit in edits[i, x]:
                deduce(i, x, edit, 1)
            for edit in insertions[x]:
                deduce(i, x, edit, 0)
        elif kind == "edit":
            edit = columns[i][x]
            edits[i, edit[0]].append(edit)
            if ("prefix", i, edit[0]) in final:
                deduce(i, edit[0], edit, 1)
        else:
            edit = INSERTIONS[x]
            insertions[edit[0]].append(edit)
            for at in reached[edit[0]]:
                deduce(at, edit[0], edit, 0)
    return {x: weight for (kind, i, x), weight in final.items() if kind == "prefix" and i == n}


@lru_cache(maxsize=1024)
def row_edits(role: str, fault: str) -> list[Edit]:
    """Edits of one row, by the initial of its role and its fault."""
    out = [(p, p, DELETE_COST, DELETE) for p in range(4)]
    if fault in (BLANK, DUPLICATE):
        return out
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    for (initial, p), q in NEXT.items():
        if initial == role:
            out.append((p, q, extra, KEEP))
        if initial in "ua":
            out.append((p, q, REROLE_COST + extra, REROLE))
    return out


def spans(columns: list[list[Edit]]) -> list[Edit]:
    """The columns as one edit for each pair of states."""
    return [(p, q, *weight) for p in range(4) for q, weight in sorted(lightest(columns, p).items())]


@lru_cache(maxsize=50_000)
def block_spans(letters: str) -> list[Edit]:
    """``spans`` of rows given as a role's initial and a fault each."""
    return spans([row_edits(a, b) for a, b in zip(letters[::2], letters[1::2])])


SPANS = "array<struct<p:int,q:int,cost:bigint,audit:string>>"
COUNTS = ["n", "blank", "duplicate", "truncated", "illegal", "turns"]
SEGMENT = (
    "conv_id {id}, block bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "turns bigint, low bigint, high bigint, first string, last string, spans " + SPANS
)


def illegal_pairs(initials: str) -> int:
    return sum((a, b) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(initials, initials[1:]))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Written table of ``rows(conv_id, turn, role, text)`` with ``pos``, their place in the
    order of conversation, turn (nulls first), hash, role and text.

    A range sort on narrow keys, so that a conversation or turn that holds a large part of
    all rows is spread; ``pos`` counts from 0 without gaps.
    """
    marked = rows.withColumn("mark", F.xxhash64("role", "text")).withColumn("row", F.monotonically_increasing_id())
    dealt = marked.repartitionByRange("conv_id", "turn", "mark", "row")
    dealt = dealt.sortWithinPartitions("conv_id", "turn", "mark", "role", "text")
    return numbered(dealt.select("conv_id", "turn", "role", "text"), "pos")


def faults(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, pos, role, fault)`` of ordered rows; ``role`` is an initial or ``-``."""
    ended = F.rtrim(F.col("text"), F.lit(SPACES))
    one = F.substring("role", 1, 1)
    plain = rows.select(
        "conv_id", "turn", "pos",
        F.when(one.isin("s", "u", "a"), one).otherwise("-").alias("role"),
        (ended == "").alias("blank"),
        (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("open"),
        F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.length("role"), "role", "text"), 256).alias("same"),
    )
    again = plain.where("not blank").groupBy("same").agg(F.min("pos").alias("earliest"), F.count(F.lit(1)).alias("n"))
    again = stored(again.where("n > 1").select("same", "earliest"))
    found = lookup(plain, "same", again, "same", again.count())
    fault = F.when(F.col("blank"), BLANK).when(F.col("pos") > F.col("earliest"), DUPLICATE)
    fault = fault.when(F.col("open"), TRUNCATED).otherwise(SOUND)
    return found.select("conv_id", "turn", "pos", "role", fault.alias("fault"))


def segments_of(checked: DataFrame) -> DataFrame:
    """One row of facts and edits for each conversation's rows in each block of places."""
    block = F.shiftright("pos", BLOCK_BITS).alias("block")
    grouped = checked.groupBy("conv_id", block).agg(
        F.sort_array(F.collect_list(F.struct("pos", F.concat("role", "fault").alias("code")))).alias("rows"),
        F.size(F.collect_set("turn")).cast("bigint").alias("turns"),
        F.min("turn").alias("low"), F.max("turn").alias("high"),
    )
    coded = grouped.select("conv_id", "block", "turns", "low", "high", F.array_join("rows.code", "").alias("letters"))
    schema = SEGMENT.format(id=checked.schema["conv_id"].dataType.simpleString())

    kinds = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                letters = row.pop("letters")
                found = letters[1::2]
                out.append(row | {
                    "n": len(found), "blank": found.count(BLANK), "duplicate": found.count(DUPLICATE),
                    "truncated": found.count(TRUNCATED), "illegal": illegal_pairs(letters[::2]),
                    "first": letters[0], "last": letters[-2], "spans": as_rows(block_spans(letters)),
                })
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return coded.mapInArrow(run, schema)


def as_rows(edits: list[Edit]) -> list[dict]:
    return [dict(zip(("p", "q", "cost", "audit"), e)) for e in edits]


def as_edits(rows: list[dict]) -> list[Edit]:
    return [(r["p"], r["q"], r["cost"], r["audit"]) for r in rows]


def arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def joined(parts: list[dict]) -> dict:
    """Facts and edits of consecutive segments as those of one."""
    out = {name: sum(p[name] for p in parts) for name in COUNTS}
    out["illegal"] += sum(illegal_pairs(a["last"] + b["first"]) for a, b in zip(parts, parts[1:]))
    known = [p for p in parts if p["low"] is not None]
    out["turns"] -= sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
    out |= {"low": known[0]["low"] if known else None, "high": known[-1]["high"] if known else None}
    out |= {"first": parts[0]["first"], "last": parts[-1]["last"]}
    if len(parts) == 1:
        return out | {"spans": parts[0]["spans"]}
    return out | {"spans": as_rows(spans([as_edits(p["spans"]) for p in parts]))}


def merged(segments: DataFrame, bits: int) -> DataFrame:
    """Segments with the runs of ``2 ** bits`` blocks of each conversation solved as one."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in segments.schema)
    names = [c for c in segments.columns if c != "conv_id"]
    lists = segments.groupBy("conv_id", F.shiftright("block", bits).alias("run")).agg(
        F.collect_list(F.struct(*names)).alias("parts")
    )

    kinds = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                parts = sorted(row["parts"], key=lambda p: p["block"])
                out.append({"conv_id": row["conv_id"], "block": row["run"]} | joined(parts))
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return lists.mapInArrow(run, schema)


def solved(segments: DataFrame) -> DataFrame:
    """``(conv_id, n, gaps, blank, duplicate, truncated, illegal, cost, audit)`` per
    conversation, from its one segment: the agenda runs until the goal is final."""
    names = [c for c in segments.columns if c not in ("conv_id", "block")]
    kind = segments.schema["conv_id"].dataType.simpleString()
    counts = ["n", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in counts) + ", audit string"

    kinds = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ((cost, audit),) = lightest([as_edits(row["spans"])], START, ACCEPTING).values()
                gaps = 0 if row["low"] is None else row["high"] - row["low"] + 1 - row["turns"]
                out.append({k: row.get(k) for k in ("conv_id", *counts)} | {"gaps": gaps, "cost": cost, "audit": audit})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return segments.select("conv_id", *names).mapInArrow(run, schema)


def block_audits(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(conv_id, block, alone, left, audit)``: the part of each audit that falls to each
    block, and how many roles it and what follows give. Insertions go to the block of the
    next row. ``alone`` says that the conversation lies in one block."""
    lists = sizes.groupBy("conv_id").agg(F.collect_list(F.struct("block", "n")).alias("parts"))
    lists = lists.withColumnRenamed("conv_id", "c")
    both = found.select("conv_id", "audit").join(lists, F.col("conv_id").eqNullSafe(F.col("c")))
    kind = found.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, block bigint, alone boolean, left bigint, audit string"

    kinds = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                audit = row["audit"]
                letters = np.frombuffer(audit.encode(), dtype=np.uint8)
                takes = np.flatnonzero(letters != ord(INSERT))
                gives = np.concatenate([[0], np.cumsum(letters != ord(DELETE))])
                parts = sorted((p["block"], p["n"]) for p in row["parts"])
                upto = np.cumsum([n for _, n in parts])
                cuts = [0, *(int(takes[k - 1]) + 1 for k in upto[:-1]), len(audit)]
                for (block, _), low, high in zip(parts, cuts, cuts[1:]):
                    left = int(gives[-1] - gives[low])
                    out.append({"conv_id": row["conv_id"], "block": block, "alone": len(parts) == 1, "left": left,
                                "audit": audit[low:high]})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return both.select("conv_id", "audit", "parts").mapInArrow(run, schema)


def applied(rows: list[dict], audit: str, left: int) -> list[dict]:
    """Repaired turns: what the letters of ``audit`` make of the rows. ``left`` roles are to
    come, the last of them an assistant's, the one before a user's, and so on."""
    out, at = [], 0
    for letter in audit:
        row = {"pos": None, "role": None, "text": ""}
        if letter != INSERT:
            row, at = rows[at], at + 1
        if letter == DELETE:
            continue
        role = row["role"] if letter == KEEP else ("user", "assistant")[left % 2]
        out.append({"pos": row["pos"], "edit": letter, "role": role, "text": row["text"]})
        left -= 1
    return out


def repaired_blocks(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``(conv_id, block, alone, turns)``: repaired turns of each block, in order, as structs
    ``(pos, edit, role, text)``."""
    block = F.shiftright("pos", BLOCK_BITS).alias("block")
    row = F.struct("pos", "role", "text")
    grouped = rows.groupBy("conv_id", block).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    named = audits.withColumnsRenamed({"conv_id": "c", "block": "b"})
    both = grouped.join(named, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    kind = rows.schema["conv_id"].dataType.simpleString()
    turns = "array<struct<pos:bigint,edit:string,role:string,text:string>>"
    schema = f"conv_id {kind}, block bigint, alone boolean, turns {turns}"

    kinds = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                out = []
                for row in batch.slice(at, 64).to_pylist():
                    made = applied(row["rows"], row["audit"], row["left"])
                    out.append({k: row[k] for k in ("conv_id", "block", "alone")} | {"turns": made})
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return both.select("conv_id", "block", "alone", "left", "audit", "rows").mapInArrow(run, schema)


class Repaired:
    """What ``repair`` finds.

    ``facts`` has a row per conversation with rows: ``(conv_id, n, gaps, blank, duplicate,
    truncated, illegal, cost, audit)``. ``blocks`` has its repaired turns, up to 256 rows
    and what is inserted between them at a time: ``(conv_id, block, alone, turns)``.
    """

    def __init__(self, facts: DataFrame, blocks: DataFrame):
        self.facts, self.blocks = facts, blocks

    def turns(self) -> DataFrame:
        """``(conv_id, block, place, pos, edit, role, text)``, a row per repaired turn; in a
        conversation they are ordered by block and place. ``pos`` is null for inserted ones."""
        return self.blocks.select("conv_id", "block", F.posexplode("turns").alias("place", "t")).select(
            "conv_id", "block", "place", "t.*"
        )

    def digests(self) -> DataFrame:
        """``(conv_id, sha256)`` of the turns as lines ``role:text``, joined by newlines.

        A conversation in several blocks is hashed block by block in one task, which holds
        one batch at a time: the hash of a long text can't be had otherwise.
        """
        lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
        texts = self.blocks.where(F.size("turns") > 0).select(
            "conv_id", "block", "alone", F.array_join(lines, "\n").alias("text")
        )
        schema = f"conv_id {self.blocks.schema['conv_id'].dataType.simpleString()}, sha256 string"
        kinds = arrow(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, key = None, None
            for batch in batches:
                out = []
                for conv, text in zip(batch["conv_id"].to_pylist(), batch["text"].to_pylist()):
                    if held is not None and conv == key:
                        held.update(b"\n")
                    else:
                        if held is not None:
                            out.append({"conv_id": key, "sha256": held.hexdigest()})
                        held, key = hashlib.sha256(), conv
                    held.update(text.encode())
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
            if held is not None:
                last = [{"conv_id": key, "sha256": held.hexdigest()}]
                yield pa.RecordBatch.from_pylist(last, schema=kinds)

        several = texts.where("not alone").repartition("conv_id").sortWithinPartitions("conv_id", "block")
        several = several.select("conv_id", "text").mapInArrow(run, schema)
        return texts.where("alone").select("conv_id", F.sha2("text", 256).alias("sha256")).unionAll(several)


def repair(
    rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> Repaired:
    """Cheapest repair of every conversation of ``rows``.

    Rows are taken by turn, nulls first; those of one turn in the order of a hash of role
    and text, equal ones side by side. A null role or text is one space. A row is blank
    (nothing but white space), else a duplicate (role and text occur earlier in the
    conversation), else truncated (doesn't end in one of ``.!?``), else sound. Blank rows
    and duplicates must be deleted (cost 3); others may be kept (0) or get the role user or
    assistant (2), truncated ones at 1 more. Empty turns of these two roles may be inserted
    anywhere (2). Roles count by their initials; a row whose role has none, or another than
    s, u and a, can't be kept. Of the cheapest repairs that with the least audit is taken.
    Rows without a conversation id are one conversation. An empty table gives empty ones.
    """
    space = F.lit(" ")
    plain = rows.select(
        F.col(id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"),
    )
    placed = ordered_rows(plain)
    first = segments = stored(segments_of(faults(placed)))
    while not segments.groupBy("conv_id").count().where("count > 1").isEmpty():
        segments = stored(merged(segments, FAN_BITS))
    facts = stored(solved(segments))
    return Repaired(facts, repaired_blocks(placed, block_audits(facts, first.select("conv_id", "block", "n"))))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` damaged by ``crc32("conv_id:turn") % 20`` (nulls: one
    space): 0 drops a row, 1 empties its text, 2 takes ``[.!?]`` out of it, 3 repeats the
    row, 4 makes its role user."""
    space = F.lit(" ")

    def spelt(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), space)

    kind = F.crc32(F.concat(spelt("conv_id"), F.lit(":"), spelt("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spelt("text"), "[.!?]", "")).otherwise(spelt("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    made = rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(spelt("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy"),
    )
    return made.drop("copy")


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """Facts and digest of the repair of ``damaged(rows)``, for every conversation of ``rows``;
    one without rows after damage has zeros, an empty audit and the hash of nothing."""
    found = repair(damaged(rows))
    every = rows.select("conv_id").distinct()
    facts = found.facts.withColumnRenamed("conv_id", "c")
    digests = found.digests().withColumnsRenamed({"conv_id": "d"})
    both = every.join(facts, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    both = both.join(digests, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return both.select(
        "conv_id",
        *(F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )
