"""Every query with SQL gives in Spark what the SQL gives."""

import math
import os

import duckdb
import pytest

from civlake.plans.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 5) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(names).collect()), key=str)
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == names
    want = sorted((tuple(plain(v) for v in r) for r in rel.select(", ".join(f'"{c}"' for c in names)).fetchall()), key=str)
    assert got == want
