"""Every registered query against its SQL twin."""

from __future__ import annotations

import pytest

import __spark_entry__ as gate
from tests.agreement import SF_DIR, database, difference


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_every_twin_has_a_query():
    assert set(gate.ORACLES) == set(gate.QUERIES)
    assert set(gate.oracle_sql()) <= set(gate.queries())


@pytest.mark.parametrize("name", list(gate.ORACLES))
def test_agreement(spark, con, name):
    assert difference(gate.QUERIES[name](spark, SF_DIR), con, gate.ORACLES[name]) is None


def test_entry(spark):
    assert gate.entry(spark).count() > 0
