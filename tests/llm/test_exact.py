import hashlib
import re

import pytest

from arbora.llm import exact
from tests.llm.conftest import messy_rows


def brute(rows):
    groups = {}
    for doc, text in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(norm, []).append((-len(text or ""), doc is not None, doc or 0))
    out = []
    for norm, members in groups.items():
        _, known, keep = min(members)
        keep = keep if known else None
        for _, known, doc in members:
            doc = doc if known else None
            out.append((doc, keep, len(members), doc == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [0, 1000])
@pytest.mark.parametrize("prefix", [1, 64])
def test_against_brute_force(messy, limit, prefix):
    got = exact.exact_dedup(messy, digests=True, broadcast_rows=limit, prefix=prefix)
    got = got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute([r[:2] for r in messy_rows()])


def test_settled_rows_have_no_digest_unless_asked(messy):
    alone = exact.exact_dedup(messy).where("group_size = 1").select("text_sha256").distinct().collect()
    assert (None,) in [tuple(r) for r in alone]


def test_empty(empty):
    assert exact.exact_dedup(empty).count() == 0
    assert exact.kept_documents(empty).columns == empty.columns


def test_kept_documents(messy):
    kept = exact.kept_documents(messy)
    assert kept.columns == messy.columns
    assert sorted(r[0] for r in kept.collect() if r[0] is not None) == [2, 5, 7, 8, 9, 9, 10, 10, 11, 12, 13]


def test_no_python_in_the_plan(messy):
    plan = exact.exact_dedup(messy)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("same_id", [True, False])
def test_rows_go_by_row(messy, same_id):
    kept = exact.kept_documents(messy, same_id=same_id)
    assert kept.columns == messy.columns
    got = [(r[0], r[1]) for r in kept.select("doc_id", "text").collect()]
    assert [t for doc, t in got if doc is None] == ["no id"]
    assert sorted(doc for doc, _ in got if doc is not None) == [2, 5, 7, 8, 9, *[9] * same_id, 10, 10, 11, 12, 13]
