"""Every registered query against its SQL."""

from __future__ import annotations

import os
import re
from pathlib import Path

import pytest

import __spark_entry__ as contract
from feedlift import catalog
from tests import compare

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
catalog.load()
QUERIES, SQL = catalog.QUERIES, catalog.SQL


@pytest.fixture(scope="module")
def con():
    return compare.duck(FOLDER)


def test_every_query_has_its_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries())


def test_the_list_of_queries_is_complete():
    text = (Path(__file__).parent.parent / "README.md").read_text()
    table = text.split("## Registered queries")[1].split("## Scale")[0]
    assert set(re.findall("`([a-z_]+)`", table)) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    names, rows = compare.rows_of_spark(QUERIES[name](spark, FOLDER))
    if name in SQL:
        sql_names, sql_rows = compare.rows_of_sql(con, SQL[name])
        assert names == sql_names
        assert not compare.difference(rows, sql_rows)


def test_entry(spark):
    assert contract.entry(spark).count() == 200
