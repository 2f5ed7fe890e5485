import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusflow.session import build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "corpusflow-tests", "local[4]", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Evaluate column expressions over small in-code rows."""

    def run(values, schema, *columns):
        return [tuple(r) for r in spark.createDataFrame(values, schema).select(*columns).collect()]

    return run
