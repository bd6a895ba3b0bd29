import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__  # noqa: E402, F401 - ships the packages to Python workers
from vitrine.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4, {"spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    from checks.base import Tables

    return Tables(spark, SMALL)


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of named values."""

    def evaluate(column, **values):
        schema = ", ".join(
            f"{k} {'STRING' if v is None or isinstance(v, str) else type_of(v)}"
            for k, v in values.items()
        )
        frame = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
        return frame.select(column.alias("v")).first()[0]

    def type_of(value):
        if isinstance(value, bool):
            return "BOOLEAN"
        if isinstance(value, int):
            return "BIGINT"
        if isinstance(value, list):
            return "ARRAY<STRING>"
        return "DOUBLE"

    return evaluate
