"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

from compare import connect, difference

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, duck, name):
    frame = queries()[name](spark, SF_DIR)
    sql = oracle_sql().get(name)
    if sql is None:
        assert frame.columns
        frame.count()
    else:
        assert difference(frame, sql, duck) is None


def test_entry(spark):
    assert entry(spark).count() > 0
