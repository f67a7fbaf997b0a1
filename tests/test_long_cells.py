"""Workbooks of texts that are longer than a cell."""

from __future__ import annotations

import zipfile

import pytest

from folioscope.plans.catalogue import ORACLE_SQL, QUERIES
from folioscope.plans import interchange  # noqa: F401
from folioscope.sources import sheets

LONG = "0123456789 é<&\n\r_x0041_\x00￾" * 4_000
TEXTS = ["", None, "short", "x" * 32_767, "x" * 32_768, "😀" * 20_000, LONG, "x" * 32_765 + "_x0041_", "\n" * 70_000]


def test_texts_of_any_length_come_back(spark, tmp_path):
    """Texts go on in further columns; workbooks without long texts have none, whichever is read first."""
    rows = [(f"{k}", t, t if k % 2 else None, f"end {k}") for k, t in enumerate(TEXTS)]
    path = str(tmp_path / "books")
    df = spark.createDataFrame(rows, "id string, text string, `other.text` string, last string")
    sheets.write_sheets(df.repartition(3), path)
    files = sorted((tmp_path / "books").glob("*.xlsx"))
    assert len(files) == 3 and all(zipfile.ZipFile(f).testzip() is None for f in files)
    for f in files:
        head, *cells = sheets.sheet_rows(f.read_bytes())
        assert head[:4] == ["id", "text", "other.text", "last"] and set(head[4:]) <= {"text", "other.text"}
        assert all(len((c or "").encode("utf-16-le")) <= 2 * sheets.MOST_CELL for row in cells for c in row)
    got = sheets.read_sheet(spark, path + "/*.xlsx", joined=True)
    assert got.columns == ["id", "text", "other.text", "last"] and sorted(map(tuple, got.collect())) == rows


def test_columns_are_bounded_by_an_error(spark, monkeypatch):
    monkeypatch.setattr(sheets, "MOST_COLUMNS", 3)
    assert sheets._spread(["a", "b"], [("x" * 40_000, None)])[0] == ["a", "b", "a"]
    with pytest.raises(sheets.SheetTooLarge):
        sheets._spread(["a", "b"], [("x" * 70_000, None)])


def test_names_that_repeat_are_one_column_only_if_they_shall(spark, tmp_path):
    (tmp_path / "t.xlsx").write_bytes(sheets.workbook(["a", "b", "a", "", ""], iter([("1", "2", "3", "4", None), (None, None, None, "", "5"), (None, "6", "7", None, None)])))
    read = lambda **more: sheets.read_sheet(spark, str(tmp_path / "t.xlsx"), **more)
    assert read().columns == ["a", "b", "a", "D", "E"]
    got = read(joined=True)
    assert [tuple(r) for r in got.collect()] == [("13", "2", "4", None), (None, None, "", "5"), ("7", "6", None, None)]


def test_sheet_round_trip_keeps_whole_texts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, t, ("en", None)[k % 2], ("src1", "a")[k % 2]) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["sheet_round_trip"]).fetchall()
    got = [tuple(r) for r in QUERIES["sheet_round_trip"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {r[1] for r in got} == set(TEXTS)
