"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from checks import CHECKS
from checks.base import TABLES
from checks.verify import compare

from .conftest import SMALL

SLOW = {"track_tasks"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in CHECKS if n not in SLOW])
def test_query(spark, duck, name):
    outcome, rows = compare(spark, duck, SMALL, name)
    assert outcome in ("ok", "rows only"), outcome
    assert rows > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
