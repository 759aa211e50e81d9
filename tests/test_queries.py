"""Every registered query against its SQL; those without one must run."""

from __future__ import annotations

import compare
import pytest

from gridmill.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    return compare.duck(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLE_SQL:
        assert compare.differences(df, catalog.ORACLE_SQL[name], con) == ""
    else:
        assert df.count() > 0


def test_entry(spark, sf):
    assert catalog.entry(spark, sf).count() > 0


def test_entry_module_imports():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
