"""Every core query with SQL gives what that SQL gives on the small test tables."""

import glob
import math
import os

import pytest

from tripleforge.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def database():
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return float(value) if hasattr(value, "as_tuple") else value


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_oracle(spark, database, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = database.execute(registry.oracles()[name])
    places = [[c[0] for c in found.description].index(c) for c in columns]
    assert len(places) == len(found.description)
    want = sorted((tuple(plain(r[i]) for i in places) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_all_oracles_have_queries():
    assert set(registry.oracles()) <= set(registry.queries())
