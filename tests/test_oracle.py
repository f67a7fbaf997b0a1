"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from folioscope.plans import catalogue  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
TABLES = "documents pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, DATA)
    con.execute(f"CREATE TABLE result AS {catalogue.ORACLE_SQL[name]}")
    columns = sorted(r[0] for r in con.execute("DESCRIBE result").fetchall())
    assert columns == sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"SELECT {quoted} FROM result").fetchall()
    got = df.select(*[f"`{c}`" for c in columns]).collect()
    key = lambda row: str([plain(v) for v in row])
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
