"""Every query that has SQL gives what DuckDB gives for it."""

import glob
import math
import os

import duckdb
import pytest

from cadenza.plans.oracles import SQL
from cadenza.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["case_idx", "song_id", "score", "rank", "hit", "playlist_id"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
