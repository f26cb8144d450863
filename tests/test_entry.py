"""Every core query runs at the smallest scale and agrees with its SQL in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from loomspark import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def compared(df, cursor):
    columns = sorted(df.columns)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    ours = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    theirs = sorted(str([plain(r[i]) for i in at]) for r in cursor.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, duck, name):
    compared(queries.QUERIES[name](spark, SF), duck.execute(queries.ORACLE_SQL[name]))


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
