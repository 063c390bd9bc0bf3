"""Every registered query against its DuckDB text on the smallest data."""

from __future__ import annotations

import pytest

from harness import compare, oracles, registry
from tests.conftest import SMALL

TEXTS = oracles.oracle_sql()
# These write to disk or run a stream; the tests of sources cover them on small input.
WRITERS = set(registry.stores())


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SMALL)


def test_every_query_has_a_text():
    assert set(registry.queries()) == set(TEXTS)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - WRITERS))
def test_query_equals_its_text(spark, duck, from_store, name):
    assert compare.difference(registry.queries()[name](spark, SMALL), duck, TEXTS[name]) == ""
