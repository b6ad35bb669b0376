"""Every registered query equals its DuckDB oracle (values, columns, rows)."""

import pytest

from conftest import SF_SMALL

import __spark_entry__ as E
from tools.oracle_check import compare
from trapline.plans import catalog

NAMES = sorted(catalog.queries())


def test_every_query_has_an_oracle():
    assert set(catalog.oracle_sql()) == set(catalog.queries())
    assert set(NAMES) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    rep = compare(spark, SF_SMALL, [name])[name]
    assert rep.get("ok") is True, rep


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == [
        "username", "password", "total_uses", "distinct_source_ips", "first_seen", "last_seen", "source_ips",
    ]
    assert df.count() > 0
