import os

import pytest

from arbora.llm.oracles import ORACLES
from arbora.llm.queries import QUERIES
from checks.compare import canonical, oracle_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    frame = QUERIES[name](spark, SF)
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    assert got == canonical(*oracle_rows(SF, ORACLES[name]))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 1 + len(QUERIES)))
