"""What a task reads, what the driver gets and what Python holds don't grow with the tables."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import enrich as en
from folioscope.sources import corpus, sheets

RULES = (en.FieldRule.of("title", "TI"), en.FieldRule.of("page", "BP", "EP"))


def _tables(spark):
    text = F.concat(F.lit("t"), F.repeat(F.lit("x"), 50))
    records = spark.range(400).select(F.col("id").alias("rec_id"), F.concat(F.lit("10.1/"), "id").alias("DI"), F.when(F.col("id") % 2 == 0, text).alias("TI"), F.lit("").alias("BP"), F.lit("9").alias("EP"))
    offers = spark.range(800).select((F.col("id") % 2 + 1).cast("int").alias("prio"), F.concat(F.lit("10.1/"), (F.col("id") / 2).cast("int")).alias("lookup"), text.alias("title"), F.lit("1-2").alias("page"))
    return records, offers


def test_tasks_of_enrichment_grow_with_the_tables(spark, monkeypatch):
    """More tasks for larger tables, whatever the session's number of shuffle partitions, with the same results."""
    made = en.enrich(*_tables(spark), RULES)
    want = [sorted(map(str, x.collect())) for x in (made.table, made.changes)]
    monkeypatch.setattr(en, "PARTITION_BYTES", 100)
    more = en.enrich(*_tables(spark), RULES)
    assert [sorted(map(str, x.collect())) for x in (more.table, more.changes)] == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert more.table.rdd.getNumPartitions() > 50 and more.changes.rdd.getNumPartitions() > 50
        again = en.enrich_again(more.table, en.first_version(more.changes), _tables(spark)[1], RULES)
        assert again[0].rdd.getNumPartitions() > 50
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(map(str, again[0].collect())) == want[0]


@pytest.mark.parametrize("partition_bytes", [100, 1 << 40])
def test_counts_of_changes_move_no_texts(spark, monkeypatch, tmp_path, partition_bytes):
    records, offers = _tables(spark)
    records.write.parquet(str(tmp_path / "r"))
    offers.write.parquet(str(tmp_path / "o"))
    monkeypatch.setattr(en, "PARTITION_BYTES", partition_bytes)
    read = spark.read.parquet(str(tmp_path / "r"))
    made = en.enrich(read, spark.read.parquet(str(tmp_path / "o")), RULES)
    for counted in (en.changed_rows(made.changes), en.column_counts(made.changes), en.unchanged_records(read, made.changes).select("rec_id")):
        plan = counted._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" in plan and "value_TI" not in plan and " AS row#" not in plan
    assert en.changed_rows(made.changes).first()[0] == 400 and en.unchanged_records(read, made.changes).count() == 0


def test_text_files_are_cut_without_python(spark, tmp_path):
    """A file of pages with a separator is read by several tasks and never whole."""
    for name, n in (("a", 900), ("b", 1), ("c", 0)):
        (tmp_path / f"s={name}").mkdir()
        (tmp_path / f"s={name}" / "x.txt").write_text("".join(f"{name} é {k}\r\n" for k in range(n)), newline="")
    (tmp_path / "s=a" / "y.md").write_text("other\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = corpus.file_pages(spark, str(tmp_path / "*"), corpus.Separated("\n"), ".txt", folder=True)
        assert found.rdd.getNumPartitions() > 3 and "MapIn" not in found._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in found.collect()} == {(f"s={n}", k + 1, f"{n} é {k}\r") for n, k in [("b", 0), *(("a", k) for k in range(900))]}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_extractors_may_give_pages_one_by_one(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 3)
    big = 1_500_000
    one_by_one = lambda content: (f"{k}" + "y" * big for k in range(2 * len(content)))
    for skip in (False, True):
        got = corpus.file_pages(spark, str(tmp_path), one_by_one, skip_unreadable=skip)
        assert [tuple(r) for r in got.selectExpr("doc_id", "page", "left(text, 1)", "length(text)").orderBy("page").collect()] == [("a.pdf", k + 1, str(k), big + 1) for k in range(6)]


def test_sheets_are_made_in_tasks(spark, tmp_path, monkeypatch):
    """A table of more rows than a sheet may have goes to several workbooks, and no row to the driver."""
    monkeypatch.setattr(sheets, "MOST_ROWS", 5)
    rows = [(str(k) if k % 3 else None, "é<&\n\r\x01" * (k % 4)) for k in range(40)]
    df = spark.createDataFrame(rows, "A string, `b.c` string").repartition(3)
    with pytest.raises(sheets.SheetTooLarge):
        sheets.write_sheet(df, str(tmp_path / "one.xlsx"))
    monkeypatch.undo()
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    path = "file://" + str(tmp_path / "many")
    sheets.write_sheets(df, path)
    files = sorted((tmp_path / "many").glob("*.xlsx"))
    assert len(files) == 3 and all(zipfile.ZipFile(f).testzip() is None and zipfile.ZipFile(f).comment == b"\n" for f in files)
    got = sheets.read_sheet(spark, path + "/*.xlsx")
    assert got.columns == ["A", "b.c"] and sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    sheets.write_sheets(df.limit(0), path + "0")
    none = sheets.read_sheet(spark, path + "0/*.xlsx")
    assert none.columns == ["A", "b.c"] and none.count() == 0


def test_a_task_makes_several_workbooks(spark, tmp_path):
    """More rows than a workbook takes, in one task."""
    path = str(tmp_path / "books")
    sheets.write_sheets(spark.range(sheets.BOOK_ROWS + 5).coalesce(1).selectExpr("cast(id as string) a"), path)
    assert len(list((tmp_path / "books").glob("*.xlsx"))) == 2
    got = sheets.read_sheet(spark, path + "/*.xlsx").selectExpr("count(*)", "count(distinct a)", "max(cast(a as long))").first()
    assert tuple(got) == (sheets.BOOK_ROWS + 5, sheets.BOOK_ROWS + 5, sheets.BOOK_ROWS + 4)


def test_a_partition_of_five_million_tokens_is_one_block(spark):
    """Blocks that are smaller than what a task reads repeat most of their strings, which are sent to each."""
    ctw = pytest.importorskip("folioscope.llm.ctw")
    rows = spark.range(50).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), 100_000).alias("text"), F.lit(False).alias("held_out"), F.lit(0).alias("kind"))
    found = rows.mapInArrow(ctw._blocks(1, 6), ctw._BLOCK).agg(F.countDistinct("block")).first()
    assert found[0] == 1
