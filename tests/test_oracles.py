"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os
import re

import duckdb
import pytest

from quadrill.plans import registered

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and (math.isclose(a, b, abs_tol=2e-5) or (math.isnan(a) and math.isnan(b))))


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_oracle(name, spark, data, duck):
    df = registered.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(*cols).collect())
    cursor = duck.execute(registered.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    want = sorted(tuple(row[names.index(c)] for c in cols) for row in cursor.fetchall())
    assert len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want) for x, y in zip(g, w))


def test_names_are_words():
    assert all(re.fullmatch(r"\w+", n) for n in registered.queries())
