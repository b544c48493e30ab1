"""Every registered query against its SQL counterpart on the smallest data."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, database  # noqa: E402
from conftest import SF  # noqa: E402

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return database(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    _, n, verdict = compare(spark, db, SF, QUERIES[name], ORACLES.get(name))
    assert verdict.startswith(("ok", "rows only")), verdict
    assert name not in ORACLES or n > 0 or "EMPTY" in verdict
