import math

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in "nation customer lineitem documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(x):
    return repr(round(float(x), 6)) if isinstance(x, float) and math.isfinite(x) else str(x)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, DIR)
    got = sorted(tuple(map(plain, r)) for r in df.collect())
    c = db.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in c.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(x) for x in df.columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in c.fetchall()) and got


def test_entry(spark):
    assert entry.entry(spark).count() == 4
