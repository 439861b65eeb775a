import pytest

from arbora.llm import bitsliced, exact
from arbora.llm.common import free_name

NAMES = ["__row", "__ROW_", "__id", "__text", "digest", "range", "mark", "norm", "first", "row", "keep_row"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Repeated and null ids beside columns whose names the operators might use."""
    texts = [(1, "a b c"), (1, "a b  c"), (None, "only one"), (None, "a b c"), (2, "other words here"), (3, None)]
    rows = [(i, t, *(f"{n}{k}" for n in NAMES)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


@pytest.mark.parametrize(
    "keep", [lambda d: exact.kept_documents(d, same_id=False), bitsliced.kept_documents], ids=["exact", "near"]
)
def test_users_columns_come_back(clashing, keep):
    got = keep(clashing)
    assert got.columns == clashing.columns
    given = {tuple(r) for r in clashing.collect()}
    found = [tuple(r) for r in got.collect()]
    assert set(found) <= given and len(found) == len(set(found)) == 4
    assert sorted(r[1] or "" for r in found)[1:] in (
        ["a b  c", "only one", "other words here"], ["a b c", "only one", "other words here"],
    )


def test_free_name(clashing):
    assert free_name(clashing, "__row") == "__row__" and free_name(clashing, "new") == "new"
