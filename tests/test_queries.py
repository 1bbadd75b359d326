"""Every registered journal query against its SQL, over the smallest given tables."""

import math

import duckdb
import pytest

from tradeloom import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(columns, found):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(clean(r[i]) for i in order) for r in found), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    got = rows(df.columns, df.collect())
    if name in plans.SQL:
        done = duck.execute(plans.SQL[name])
        columns = [d[0] for d in done.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, done.fetchall())
