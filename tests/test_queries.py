"""Every registered query against its SQL at the smallest scale."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalogue.queries import QUERIES
from tools.check_oracles import canonical, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) <= set(oracle_sql())
    assert set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, database, name):
    got = queries()[name](spark, SF_DIR).toPandas()
    want = database.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
    assert len(got) > 0


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r["issue_type"] for r in rows} >= {"malformed_json_ld", "missing_required_property", "missing_image"}
