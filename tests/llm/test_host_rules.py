import re
from collections import Counter

from arbora.llm import host_rules
from tests.llm.conftest import SCHEMA, messy_rows


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {p for i, w in enumerate(windows) if counts[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_measures_against_brute_force(messy):
    got = host_rules.host_rules(messy).select(*COLUMNS)
    want = [(r[0], *brute(r[1])) for r in messy_rows()]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_hosts_are_shrunk_to_the_prior(spark):
    good, bad = " ".join(f"u{i}" for i in range(60)), "too short"
    rows = [(i, good, "en", f"h{i % 20}") for i in range(400)]
    rows += [(1000 + i, bad, "en", "spam") for i in range(50)] + [(2000, bad, "en", "one")]
    rows += [(3000, good, "en", "spam"), (4000, good, "en", None), (4001, bad, "en", None)]
    docs = spark.createDataFrame([(*r, 0, 0, "", True, 0, 0, 0) for r in rows], SCHEMA)
    got = {r["doc_id"]: r for r in host_rules.host_rules(docs).collect()}
    assert got[3000]["host_bad"] and not got[3000]["kept"] and not got[3000]["base_failed"]
    assert not got[2000]["host_bad"] and not got[2000]["kept"]
    assert got[0]["kept"] and got[4000]["kept"] and got[4000]["host_docs"] == 2


def test_empty_and_plan(empty, messy):
    assert host_rules.host_rules(empty).count() == 0
    plan = host_rules.measures(messy)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
