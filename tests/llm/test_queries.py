"""All pN queries run, and those with SQL equal DuckDB on the same tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from quillspark.llm.queries import QUERIES
from quillspark.llm.sql import SQL

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = Counter(tuple(map(plain, r)) for r in df.select(*cols).collect())
    if name in SQL:
        r = db.sql(SQL[name])
        assert sorted(r.columns) == cols
        assert rows == Counter(tuple(map(plain, x)) for x in r.select(*(f'"{c}"' for c in cols)).fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
