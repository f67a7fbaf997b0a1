"""Imports of texts that CSV readers like to lose, against the queries' SQL."""

from __future__ import annotations

import pytest

from folioscope.plans import interchange, matching  # noqa: F401
from folioscope.plans.catalogue import ORACLE_SQL, QUERIES
from folioscope.sources import csv_files

duckdb = pytest.importorskip("duckdb")

TEXTS = ["", None, " ", "a", 'b,\x00"c"\n', "\x00", "\x01", "x,\x010\x011\x00\n", "\n", '""', "\r", "a\r\nb", "﻿a", "#a"]


def equals_sql(spark, path, name, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    con.execute(f"CREATE TABLE result AS {ORACLE_SQL[name]}")
    df = QUERIES[name](spark, str(path))
    quoted = ", ".join(f'"{c}"' for c in df.columns)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.execute(f"SELECT {quoted} FROM result").fetchall()))


def test_import_csv_keeps_odd_texts(spark, tmp_path):
    rows = [(k, t, ("en", "", None)[k % 3], ("src1", None)[k % 2]) for k, t in enumerate(TEXTS)]
    equals_sql(spark, tmp_path / "some", "import_csv", [*rows, (None, "no id", "en", "src1")])
    equals_sql(spark, tmp_path / "none", "import_csv", [])


def test_import_csv_mixed_keeps_odd_texts_and_ids(spark, tmp_path):
    """Each text in each of the three exports; ids that are missing or below 0 too."""
    rows = [(3 * k + s, t, ("en", "", None)[k % 3], ("src1", None)[k % 2]) for s in range(3) for k, t in enumerate(TEXTS)]
    equals_sql(spark, tmp_path / "some", "import_csv_mixed", [*rows, (None, "no id", "en", "src1"), (-1, "a", "en", "src1"), (-2, "b", "en", "src1"), (-3, "", "en", "src1")])
    equals_sql(spark, tmp_path / "none", "import_csv_mixed", [])


def test_quoted_empty_values_are_texts_if_they_shall(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'A,B,C\n"",,"x\x00,\x01"\n1,""\n')
    got = lambda **more: {tuple(r) for r in csv_files.read_csv(spark, str(tmp_path), **more).collect()}
    assert got() == {(None, None, "x\x00,\x01"), ("1", None, None)}
    assert got(keep_empty=True, ragged="error") == {("", None, "x\x00,\x01"), ("1", "", None)}
    (tmp_path / "a.csv").write_bytes(b'A\n1,""\n')
    assert got(keep_empty=True, ragged="error") == {("1",)}
