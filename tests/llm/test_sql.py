"""Queries that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

from gradus.llm import oracles, queries

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, same_as_sql):
    same_as_sql(queries.queries()[name], SQL[name])


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, len(numbers) + 1))
