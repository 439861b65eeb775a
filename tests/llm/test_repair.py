import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from arbora.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, pos long, block int, row string, n string"


def exhaustive(columns):
    """Least (cost, audit) by trying all edits of rows given as (initial, fault), with up to
    two insertions in each gap."""
    gaps = [[()] + [(a,) for a in "ua"] + [(a, b) for a in "ua" for b in "ua"]] * (len(columns) + 1)
    choices = []
    for role, fault in columns:
        found = [("D", "", 3)]
        if fault not in "bd":
            extra = int(fault == "t")
            found += [("K", role, extra), ("R", "u", 2 + extra), ("R", "a", 2 + extra)]
        choices.append(found)
    best = None
    for inserted in itertools.product(*gaps):
        for edits in itertools.product(*choices):
            roles, audit, cost = "", "", 0
            for gap, edit in itertools.zip_longest(inserted, edits):
                roles += "".join(gap)
                audit += "I" * len(gap)
                cost += 2 * len(gap)
                if edit:
                    audit, roles, cost = audit + edit[0], roles + edit[1], cost + edit[2]
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def solve(columns):
    edits = [repair.row_edits(*c) for c in columns]
    ((weight),) = repair.lightest(edits, repair.START, repair.ACCEPTING).values()
    return weight


def test_agenda_against_all_repairs():
    kinds = [(r, f) for r in "sua-" for f in "-tb"]
    cases = [[], *([k] for k in kinds), *(list(p) for p in itertools.product(kinds, repeat=2))]
    rng = random.Random(2)
    cases += [[rng.choice(kinds) for _ in range(3)] for _ in range(60)]
    for case in cases:
        assert solve(case) == exhaustive(case), case


def by_columns(columns):
    """The same by plain dynamic programming, without an agenda."""

    def closed(have):
        for _ in range(3):
            for p, q, cost, audit in repair.INSERTIONS:
                if p in have:
                    new = (have[p][0] + cost, have[p][1] + audit)
                    have[q] = min(have.get(q, new), new)
        return have

    have = closed({repair.START: (0, "")})
    for c in columns:
        after = {}
        for p, q, cost, audit in repair.row_edits(*c):
            if p in have:
                new = (have[p][0] + cost, have[p][1] + audit)
                after[q] = min(after.get(q, new), new)
        have = closed(after)
    return min(have[q] for q in repair.ACCEPTING if q in have)


def test_blocks_change_nothing():
    rng = random.Random(7)
    for n in (1, 2, 5, 9, 30, 120):
        for _ in range(6):
            columns = [(rng.choice("ssuuuaaa-"), rng.choice("----tbd")) for _ in range(n)]
            whole = solve(columns)
            assert whole == by_columns(columns)
            cuts = sorted(rng.sample(range(n + 1), min(n, 4)))
            parts = [columns[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
            blocks = [repair.spans([repair.row_edits(*c) for c in part]) for part in parts]
            blocks = [repair.spans(blocks[:2]), *blocks[2:]]
            assert whole in repair.lightest(blocks, repair.START, repair.ACCEPTING).values()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role = "user" if kind == 4 else role
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, role, text)] * (kind != 0) * (1 + (kind == 3))
    return out


def brute(rows, order):
    """Facts and digest of each conversation by plain Python; ``order`` settles equal turns."""
    out = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for conv, *_ in rows}
    after = damage(rows)
    for conv in {r[0] for r in after}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, order(r)))
        columns, seen = [], set()
        for _, _, role, text in own:
            ended = text.rstrip(repair.SPACES)
            fault = "b" if not ended else "d" if (role, text) in seen else "t" if ended[-1] not in ".!?" else "-"
            seen.add((role, text))
            columns.append((role[:1] if role[:1] in ("s", "u", "a") else "-", fault))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(columns, columns[1:]))
        cost, audit = by_columns(columns)
        left, lines, at = len(audit.replace("D", "")), [], iter(own)
        for letter in audit:
            row = next(at) if letter != "I" else (0, 0, "", "")
            if letter == "D":
                continue
            role = row[2] if letter == "K" else "assistant" if left % 2 else "user"
            lines.append(f"{role}:{row[3]}")
            left -= 1
        counts = Counter(f for _, f in columns)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, digest)
    return sorted(((k, *v) for k, v in out.items()), key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def messy_rows():
    rng = random.Random(4)
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "Ünï"])
            text = rng.choice(["Hi.", "Well?", "no end", " \t\n", "", None, f"say {turn}!", f"é {turn}. \n", "x" * 5000 + "."])
            rows.append((conv, turn if rng.random() < 0.9 else None, role, text))
    rows += [(40, 0, "user", "only.")] * 3 + [(41, None, "assistant", "a!"), (42, 10**12, "user", "q?"), (42, 5, None, "")]
    rows += [(77, t, ("user", "assistant")[t % 2], f"t{t % 50}{'.' * (t % 3)}") for t in range(700)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, i, i, "x", None) for i, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("bits,fan", [(8, 6), (2, 1)])
def test_conversations(spark, monkeypatch, bits, fan):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    monkeypatch.setattr(repair, "FAN_BITS", fan)
    rows = messy_rows()
    from pyspark.sql import functions as F

    marks = spark.createDataFrame([(r[2], r[3]) for r in damage(rows)], "r string, t string").distinct()
    marks = {(r[0], r[1]): r[2] for r in marks.select("r", "t", F.xxhash64("r", "t")).collect()}
    got = repair.damaged_and_repaired(frame(spark, rows).repartition(3))
    assert got.columns == COLUMNS
    want = brute(rows, lambda r: marks[r[2], r[3]])
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "q."), (1, 1, "user", "more."), (1, 2, "assistant", "a."), (1, 3, "assistant", " ")]
    found = repair.repair(frame(spark, rows))
    turns = [(r["edit"], r["role"], r["text"]) for r in found.turns().orderBy("block", "place").collect()]
    assert found.facts.first()["audit"] == "KIKKD"
    assert turns == [("K", "user", "q."), ("I", "assistant", ""), ("K", "user", "more."), ("K", "assistant", "a.")]


def test_empty(spark):
    assert repair.damaged_and_repaired(frame(spark, [])).count() == 0


def test_all_rows_dropped(spark):
    dropped = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.damaged_and_repaired(frame(spark, [(*dropped, "user", "gone.")])).collect()
    assert [tuple(r) for r in got] == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
