"""Every registered query on the smallest data, against DuckDB where it has SQL."""

import pytest
from compare import compare, duck
from conftest import SMALL

from sentiloom.plans import catalog  # noqa: F401
from sentiloom.plans.registry import CATALOG


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.oracle is not None])
def test_matches_sql(spark, con, name):
    state, note = compare(spark, con, CATALOG[name], SMALL)
    assert state == "ok", f"{name}: {state} {note}"


def test_names_and_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CATALOG) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
