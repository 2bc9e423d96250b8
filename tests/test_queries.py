"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import compare, connect

from brinewave.plans.catalog import ENTRIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, ENTRIES[name]) == ""


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
