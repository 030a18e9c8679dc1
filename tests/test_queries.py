"""Every registered query against its checking SQL."""

import pytest

import __spark_entry__ as contract
from codeledger.plans.catalog import QUERIES

ORACLES = contract.oracle_sql()


def test_every_query_is_checked():
    assert set(QUERIES) <= set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("key", QUERIES)
def test_query(spark, sf_dir, duck, key):
    frame = QUERIES[key](spark, sf_dir)
    checked = duck.execute(ORACLES[key])
    names = [column[0] for column in checked.description]
    assert sorted(frame.columns) == sorted(names)
    got = sorted(map(tuple, frame.select(*names).collect()), key=repr)
    assert got == sorted(checked.fetchall(), key=repr)
    assert got


def test_entry(spark):
    assert contract.entry(spark).count() == 3
