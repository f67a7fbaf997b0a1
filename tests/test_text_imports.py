"""Keyword files of other systems, lists in tagged exports, merged texts, documents without text."""

from __future__ import annotations

import hashlib
import random

import pytest

from folioscope.operators import keywords
from folioscope.sources import corpus, records, sinks


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_keyword_files_of_any_system(spark, tmp_path, end):
    (tmp_path / "k.txt").write_bytes(end.join(["The", "of", "", "THE", "on the"]).encode())
    assert corpus.normal_keywords(corpus.keyword_lines(str(tmp_path / "k.txt"))) == ["the", "of", "on the"]
    lines = spark.createDataFrame([(0, "The" + end), (1, "of"), (2, "THE" + end)], "ord int, keyword string")
    assert {tuple(r) for r in corpus.keyword_table(lines).collect()} == {("the", 0), ("of", 1)}


def test_lines_of_list_tags_are_values(spark, tmp_path):
    (tmp_path / "x.txt").write_text("PT J\nAU A, B\n   C, D\nTI One\n   two\nC1 [A, B] U, X.\n   [C, D] V, Y.\nCR X, 2001, J\n   Y, 2002, K\nAB a\n   b\nER\n")
    row = records.tagged_records(records.numbered_lines(spark, str(tmp_path))).first()
    assert (row["AU"], row["TI"], row["C1"], row["CR"], row["AB"]) == ("A, B; C, D", "One two", "[A, B] U, X.; [C, D] V, Y.", "X, 2001, J; Y, 2002, K", "a b")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "y.txt").write_text("PMID- 1\nAD  - U,\n      X\nAD  - V\n")
    row = records.tagged_records(records.numbered_lines(spark, str(tmp_path / "m")), "medline", "pubmed").first()
    assert row["C1"] == "U, X; V"


def merged(path):
    return b"".join(p.read_bytes() for p in sorted(path.glob("part-*")))


def test_merged_text_is_exact(spark, tmp_path):
    r = random.Random(2)
    texts = ["one\ntwo\n", "", "three", "a\r\nb\r\n", "\n", "\n\nx", "é " * 50] + ["".join(r.choice(["ab", "\n", "é", " ", "\r\n"]) for _ in range(r.randrange(400))) for _ in range(8)]
    texts = [t.rstrip("\r") for t in texts]
    (tmp_path / "in").mkdir()
    for k, t in enumerate(texts):
        (tmp_path / "in" / f"f{k:02}.txt").write_bytes(t.encode())
    want = "".join(t.replace("\r\n", "\n").replace("\r", "\n") + "\n" for t in texts).encode()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = sinks.write_merged(records.concatenated_text(spark, str(tmp_path / "in")), str(tmp_path / "out")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert hashlib.sha256(merged(tmp_path / "out")).digest() == hashlib.sha256(want).digest()
    assert len(manifest) > 1 and [m["part"] for m in manifest] == sorted(p.name for p in (tmp_path / "out").glob("part-*"))
    for m in manifest:
        assert (tmp_path / "out" / m["part"]).read_bytes() == want[m["offset"] : m["offset"] + m["bytes"]]


def test_documents_without_text_have_zeros(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " the the of ")], "doc_id long, text string")
    pages = corpus.text_pages(docs)
    assert {tuple(r) for r in corpus.page_counts(pages).collect()} == {(1, 1), (2, 1), (3, 1)}
    listed = keywords.KeywordSet.of(["the", "doc_id", "of"])
    found = keywords.overview(keywords.page_hits(keywords.clean_pages(pages), listed), listed)
    assert found.columns == ["doc_id", "the", "doc_id.1", "of"]
    assert {tuple(r) for r in found.collect()} == {(1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 0, 1)}
    assert {tuple(r) for r in corpus.separated_pages(docs).collect()} >= {(1, 1, ""), (2, 1, "")}


def test_tables_that_nothing_reads_are_removed(spark):
    import os

    from folioscope import storage

    rows = spark.range(5)
    with storage.recorded() as outer, storage.recorded() as inner:
        first, second = storage.written(rows, "first"), storage.written(rows, "second")
    third = storage.written(rows, "third")
    assert len(inner) == 2 and outer == inner
    assert storage.remove_unread(spark, inner, second.where("id > 1")) == [inner[1]]
    assert [os.path.exists(p.removeprefix("file://")) for p in inner] == [False, True]
    assert second.count() == third.count() == 5 and first is not None


def test_lines_of_records_are_shuffled_a_few_times_only(spark, tmp_path):
    """CSV lines are written once before they are used twice, and tagged lines are dealt by record once."""
    from folioscope.sources import csv_files
    from folioscope.sources.records import numbered_lines, tagged_records
    from folioscope.storage import recorded

    (tmp_path / "a.csv").write_text('h,i\n1,"x\ny"\n2,z\n')
    with recorded() as paths:
        found = csv_files.whole_records(csv_files.lines_of(spark, str(tmp_path / "a.csv")))
        assert {r["text"] for r in found.collect()} == {"h,i", '1,"x\ny"', "2,z"}
    assert not any(f"/{p.rsplit('/', 1)[-1]}/" in f for p in paths if "/lines-" in p for f in found.inputFiles()), "lines are not shuffled again"
    (tmp_path / "b.txt").write_text("PT J\nAU a\n   b\nTI t\nER\n\nPT J\nTI u\n   v\nER\n")
    tagged = tagged_records(numbered_lines(spark, str(tmp_path / "b.txt")), tags=["PT", "AU", "TI"])
    assert {(r["AU"], r["TI"]) for r in tagged.collect()} == {("a; b", "t"), (None, "u v")}
    plan = tagged._jdf.queryExecution().sparkPlan().toString()
    assert "RepartitionByExpression" in tagged._jdf.queryExecution().optimizedPlan().toString() and plan
