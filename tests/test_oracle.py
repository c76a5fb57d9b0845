"""Every registered query against DuckDB over the same parquet files."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from innsight import catalog
from tests.compare import connect, duck_rows, spark_rows
from tests.conftest import SF_SMALL

QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()
#: The training-text queries are compared in their own folder.
HERE = sorted(n for n in ORACLES if n in catalog.queries())


@pytest.fixture(scope="module")
def duck():
    return connect(SF_SMALL)


def test_oracles_name_known_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", HERE)
def test_matches_oracle(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, SF_SMALL)) == duck_rows(duck, ORACLES[name])


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["mes", "categoria", "noches_ocupadas", "noches_disponibles", "porcentaje"]
    assert df.count() > 0
