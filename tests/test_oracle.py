"""Every registered query against its SQL on the same tables."""

import pytest
from oracle import compare, connect

from framewright.queries import registry

FOLDER = "/root/testdata/sf0.01"
registry.load_all()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    state, _, _ = compare(spark, con, FOLDER, name)
    assert state in ("ok", "rows-only"), state


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
