"""Every registered query gives the rows of its DuckDB oracle."""

import pytest

import __spark_entry__ as entry_points
from check_oracle import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


# the corpus operators have tests of their own
NAMES = [name for name in entry_points.queries() if name not in entry_points._corpus()]


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name) is None


def test_entry_has_rows_and_stable_schema(spark):
    first, second = entry_points.entry(spark), entry_points.entry(spark)
    assert first.schema == second.schema
    assert first.count() > 0
