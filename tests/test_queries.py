"""Every library query against its SQL, over the smallest tables."""

import pytest

from duck import compare, connect
from evigrid import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, con, name):
    compare(spark, con, queries.queries()[name], queries.oracle_sql()[name], SF)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_library_does_not_import_the_corpus_package():
    import pathlib

    root = pathlib.Path(queries.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "evigrid.llm" not in f.read_text()
