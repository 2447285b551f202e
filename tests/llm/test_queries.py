"""Every registered query of the numbered operators on the smallest tables, against its check SQL where it has one."""

import pytest

import __spark_entry__ as entry
from confab.llm.plans import ORACLES, QUERIES
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    rows, note = check(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert note in ("ok", "rows only"), note
    assert rows > 0


def test_one_query_for_each_operator_and_the_pipeline():
    names = list(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(QUERIES) <= set(names)
    assert names.count("pipeline") == 1 and set(ORACLES) <= set(entry.oracle_sql())
