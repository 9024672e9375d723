"""Every query that has SQL gives the rows of its SQL; none is empty."""

from __future__ import annotations

import pytest

from folioscan.plans.oracles import ORACLES
from folioscan.plans.queries import QUERIES

from .compare import assert_same, duck

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert assert_same(QUERIES[name](spark, SF), con, ORACLES[name])
