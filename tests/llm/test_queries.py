"""Every query against its SQL on the smallest tables; those without SQL have their own tests."""
from __future__ import annotations

import pytest

from auditframe.llm.queries import ORACLES, QUERIES
from tests.oracle import DATA, compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(DATA.format("0.001"))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], DATA.format("0.001")) is None


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
