"""Registered queries of the package against DuckDB over the same parquet files."""

from __future__ import annotations

import pytest

from innsight.llm import queries
from tests.compare import connect, duck_rows, spark_rows
from tests.llm.conftest import SMALL

ORACLES = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    assert spark_rows(queries.queries()[name](spark, SMALL)) == duck_rows(duck, ORACLES[name])
