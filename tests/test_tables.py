"""Every table query with SQL against DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

from plumbline.plans import tables, tables_product  # noqa: F401

DATA = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(tables.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = tables.QUERIES[name](spark, DATA)
    found = duck.execute(tables.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v)
    want = sorted(tuple(plain(v) for _, v in sorted(zip(columns, row, strict=True))) for row in found.fetchall())
    got = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == want
