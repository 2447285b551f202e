"""Every registered query against its check SQL on the smallest tables."""

import pytest

from confab.plans import load
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    rows, note = check(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert note in ("ok", "rows only"), note
    assert rows >= 0


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
