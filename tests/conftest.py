import datetime as dt

import pytest

from gateflow.session import build_session
from gateflow.sources.swipes import SWIPE_SCHEMA

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", shuffle_partitions=4)


@pytest.fixture(scope="session")
def make_swipes(spark):
    """Swipes from (time text, station, device, status, user, pay type) tuples."""
    def make(rows):
        data = [(dt.datetime.strptime(t, "%Y-%m-%d %H:%M:%S"), "ABC"[s % 3], s, d, st, u, p) for t, s, d, st, u, p in rows]
        return spark.createDataFrame(data, SWIPE_SCHEMA)
    return make


@pytest.fixture(scope="session")
def make_flow(spark):
    """Flow rows from (station, day, slot, in, out) tuples."""
    def make(rows):
        return spark.createDataFrame(rows, "stationID INT, day DATE, slot INT, inNums BIGINT, outNums BIGINT")
    return make


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
