"""Every volume query against its SQL, on the smallest tables and on those of the driver's check."""

import pytest

from tests.compare import duck_rows, spark_rows
from voxframe.plans import more_queries, queries  # noqa: F401  more_queries registers its own beside the others

@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, name, sf):
    sf = f"/root/testdata/{sf}"
    got = spark_rows(queries.QUERIES[name](spark, sf))
    assert got[1] or name == "pending_anti"
    if name in queries.ORACLES:
        assert got == duck_rows(queries.ORACLES[name], sf)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
