"""Every registered query against its SQL twin, or for a non-empty result, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict, _ = check.compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert verdict.startswith(("ok", "ROWS")) and verdict != "ROWS 0", verdict


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)
