"""Each query with SQL gives what DuckDB gives on the same tables; each other query has a test of its own."""

import math
import os

import duckdb
import pytest

from docweft.plans import library

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_same_as_duckdb(spark, duck, name):
    df = library.QUERIES[name](spark, SF)
    found = duck.execute(library.SQL[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == want


def test_queries_without_sql_have_a_plain_version():
    from tests import test_kernel_queries

    assert not [n for n in set(library.QUERIES) - set(library.SQL) if not hasattr(test_kernel_queries, f"test_{n}")]
