"""Every registered query of the engine against its SQL on the small tables."""

from __future__ import annotations

import pytest
from oracle import SMALL, assert_same

from quillstream.plans.catalogue import ORACLES, QUERIES


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert_same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)
