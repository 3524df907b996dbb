"""Every query against its SQL on the smallest data set."""

import pytest
from check import difference
from conftest import SF

import __spark_entry__ as entry
from recordmill.plans.oracles import ORACLES
from recordmill.plans.queries import QUERIES

NAMES = sorted(QUERIES)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    assert difference(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name]) is None


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert [r.seq_no for r in sorted(rows, key=lambda r: r.seq_no)] == list(range(1, len(rows) + 1))
