"""Queries with SQL give DuckDB's rows."""

import pytest

from folioscope.llm import queries

from .helpers import DATA, HAVE

duckdb = pytest.importorskip("duckdb")


@pytest.mark.skipif(not HAVE, reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    con.execute(f"CREATE TABLE result AS {queries.ORACLE_SQL[name]}")
    columns = sorted(r[0] for r in con.execute("DESCRIBE result").fetchall())
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == columns
    want = con.execute(f"SELECT {', '.join(columns)} FROM result").fetchall()
    key = lambda row: str([round(v, 9) if isinstance(v, float) else v for v in row])
    assert sorted(map(key, want)) == sorted(key(tuple(r)) for r in df.select(*columns).collect())


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
