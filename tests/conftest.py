from __future__ import annotations

import pytest

from tastegrid import apply_session_settings
from workload.check import connect, local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = apply_session_settings(local_session(cpus=4, memory="4g"))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    return connect(SMALL)


@pytest.fixture(scope="session")
def small_dir():
    return SMALL


@pytest.fixture
def rows(spark):
    """Make a DataFrame from a DDL schema and tuples."""

    def make(schema: str, *values):
        return spark.createDataFrame(list(values), schema)

    return make


@pytest.fixture
def ratings(rows):
    def make(*values):
        return rows("user_id int, item_id int, rating double, ts long", *values)

    return make


@pytest.fixture
def items(rows):
    def make(*values):
        return rows("item_id int, title string, genres string", *values)

    return make


@pytest.fixture
def candidates(rows):
    def make(*values):
        return rows("user_id int, item_id int, als_score double", *values)

    return make
