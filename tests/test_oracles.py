"""Every registered query against its oracle SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import connect, difference

from marketlens.plans import load

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    ours = QUERIES[name](spark, SF_DIR).toPandas()
    if name in ORACLES:
        assert difference(ours, duck.execute(ORACLES[name]).df()) is None
