"""Every query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from gradus.plans import oracles, queries

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(name, spark, same_as_sql):
    query = queries.queries()[name]
    if name in SQL:
        same_as_sql(query, SQL[name])
    else:
        from tests.conftest import SMALL

        assert query(spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() == 70
    assert set(SQL) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_run_lines_of_all_systems(spark):
    """Every row of every run comes back from its line."""
    from collections import Counter

    from gradus.plans.fixtures import SYSTEMS, Fixtures
    from tests.conftest import SMALL

    rows = queries.queries()["parse_run_lines"](spark, SMALL).collect()
    got = Counter(tuple(r)[:4] for r in rows if r.run != "bad" and r.problem is None)
    assert got == Counter((r.run, r.query_id, r.passage_id, float(f"{r.score:.6f}")) for r in Fixtures(spark, SMALL).runs().collect())
    assert len({r[0] for r in got}) == SYSTEMS
