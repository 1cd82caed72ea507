"""Every registered query against its oracle SQL, or at least run, at the smallest scale."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    if name in SQL:
        difference = oracle.compare(df, con, SQL[name])
        assert difference is None, difference
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 6
