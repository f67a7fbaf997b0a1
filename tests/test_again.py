"""Enrichment with more offers, counts of documents that are sent again, paged text files."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.functions.text import FilterSpec
from folioscope.operators import enrich as en
from folioscope.operators import keywords
from folioscope.sources import corpus
from folioscope.storage import written
from folioscope.streaming import corrections
from folioscope.streaming.keywords import stream_documents

RULES = (en.FieldRule.of("title", "TI"), en.FieldRule.of("page", "BP", "EP"))
RECORDS = "rec_id long, DI string, TI string, BP string, EP string, known string"
OFFERS = "prio int, lookup string, title string, page string"


def rows_of(seed):
    r = random.Random(seed)
    records = [(k, r.choice([None, "", f" 10.1/{k % 12} "]), r.choice([None, "none", "own"]), r.choice(["", "1"]), r.choice([None, "9"]), "clash") for k in range(40)]
    offers = [(r.randrange(0, 8), r.choice([None, f"10.1/{r.randrange(14)}"]), r.choice([None, "None", "t1", "t2", "t3"]), r.choice(["1-2", "5", "", None])) for _ in range(90)]
    return records, offers


@pytest.mark.parametrize("seed", range(4))
def test_runs_one_after_the_other_equal_one_run(spark, seed):
    records, offers = rows_of(seed)
    frame = spark.createDataFrame(records, RECORDS)
    whole = en.enrich(frame, spark.createDataFrame(offers, OFFERS), RULES)
    want, log = sorted(map(str, whole.table.collect())), sorted(map(str, whole.changes.collect()))
    r = random.Random(seed)
    parts = [[], [], []]
    for o in offers:
        parts[r.randrange(3)].append(o)
    part = lambda k: spark.createDataFrame(parts[k], OFFERS)
    first = en.enrich(frame, part(0), RULES)
    table, versions = written(first.table, "t"), written(en.first_version(first.changes), "v")
    for k in (1, 2):
        table, versions = en.enrich_again(table, versions, part(k), RULES)
        table, versions = written(table, "t"), written(versions, "v")
    assert table.columns == frame.columns and sorted(map(str, table.collect())) == want
    assert sorted(str(x) for x in en.latest(versions).select(whole.changes.columns).collect()) == log
    numbers = versions.groupBy("rec_id", "field").agg(F.sort_array(F.collect_list("version")).alias("v")).collect()
    assert all(x["v"] == list(range(1, len(x["v"]) + 1)) for x in numbers)
    again = en.enrich_again(table, versions, part(2), RULES)
    assert again[1].count() == versions.count() and sorted(map(str, again[0].collect())) == want, "the same offers change nothing"
    none = en.enrich_again(table, versions, part(2).limit(0), RULES)
    assert none[1].count() == versions.count() and sorted(map(str, none[0].collect())) == want


def test_values_by_hand_stay(spark):
    frame = spark.createDataFrame([(1, "10.1/a", None, "", "", "")], RECORDS)
    first = en.enrich(frame, spark.createDataFrame([(4, "10.1/a", "from four", None)], OFFERS), RULES)
    edited = first.table.withColumn("TI", F.lit("by hand"))
    table, versions = en.enrich_again(edited, en.first_version(first.changes), spark.createDataFrame([(1, "10.1/a", "from one", "3-4")], OFFERS), RULES)
    assert table.first()["TI"] == "by hand" and (table.first()["BP"], table.first()["EP"]) == ("3", "4")
    assert {(r["field"], r["version"]) for r in versions.collect()} == {("TI", 1), ("BP", 1), ("EP", 1)}


def test_a_provider_that_comes_before_takes_the_place(spark):
    frame = spark.createDataFrame([(1, "10.1/a", "none", "", "", "")], RECORDS)
    first = en.enrich(frame, spark.createDataFrame([(4, "10.1/a", "from four", None)], OFFERS), RULES)
    table, versions = en.enrich_again(first.table, en.first_version(first.changes), spark.createDataFrame([(2, "10.1/a", "from two", None), (5, "10.1/a", "from five", None)], OFFERS), RULES)
    assert table.first()["TI"] == "from two"
    assert sorted(tuple(r) for r in versions.where("field = 'TI'").select("version", "old_value", "new_value", "provider").collect()) == [(1, "none", "from four", "OpenAlex"), (2, "none", "from two", "PubMed")]


# --- stream -----------------------------------------------------------------------------------------------------------


def test_stream_takes_back_what_is_sent_again(spark, tmp_path):
    words, r = keywords.KeywordSet.of(["the", "of", "no"]), random.Random(3)
    text = lambda: r.choice([None, "".join(r.choice([" the ", " of ", "x ", "\n"]) for _ in range(r.randrange(30)))])
    batches = [[(r.choice([None, *range(8)]), r.choice([None, *range(5)]), text()) for _ in range(12)] for _ in range(5)]

    def count(t):
        lines = (t or "").split("\n")
        pages = ["\n".join(lines[i : i + 3]) for i in range(0, len(lines), 3)]
        return [sum(len(re.findall(rf"\s{w}\s", p)) for p in pages) for w in words.words]

    last = {}
    for batch in batches:
        new = {}
        for d, v, t in batch:
            if v is not None and (d not in last or v > last[d][0]):
                new.setdefault((d, v), []).append(t)
        for (d, v), ts in sorted(new.items(), key=lambda x: x[0][1]):
            last[d] = (v, min(map(count, ts)))
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, "doc_id long, version long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k in (2, 4):  # stopped and started again with what has come since
            docs = stream_documents(spark, str(tmp_path / "in"), "doc_id long, version long, text string", files_a_batch=1)
            corrections.start(corrections.changes(docs, words, FilterSpec()), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(300)
    deltas = spark.read.schema(corrections.CHANGES).parquet(str(tmp_path / "out"))
    got = {(x["doc_id"], x["keyword"]): x["hits"] for x in corrections.document_counts(deltas, words).collect()}
    assert got == {(d, w): n for d, (_, c) in last.items() for w, n in zip(words.words, c) if n}
    assert {x["keyword"]: x["hits"] for x in corrections.totals(deltas, words).collect()} == {w: sum(c[k] for _, c in last.values()) for k, w in enumerate(words.words)}


# --- paged files ------------------------------------------------------------------------------------------------------


def test_paged_files_are_read_in_blocks(spark, tmp_path):
    texts = {"a.txt": [f"page {k}\nof a é\r\n" for k in range(300)], "b.txt": ["one", "", "last"], "c.txt": []}
    for name, pages in texts.items():
        (tmp_path / name).write_bytes(("\f".join(pages) + ("\f" if name == "a.txt" else "")).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.option("lineSep", "\f").text(str(tmp_path)).rdd.getNumPartitions() > 5
        whole = {tuple(x) for x in corpus.paged_files(spark, str(tmp_path)).collect()}
        part = corpus.paged_files(spark, str(tmp_path), (2, 40))
        some = {tuple(x) for x in part.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {(name, k + 1, p) for name, pages in texts.items() for k, p in enumerate(pages)}
    assert whole == want and some == {x for x in want if 2 <= x[1] <= 40}
    plan = part._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") >= 2
    assert list(itertools.islice(sorted(x[0] for x in some), 1)) == ["a.txt"]


def test_paged_texts_are_not_shuffled(spark, tmp_path, monkeypatch):
    for name, n in (("a", 400), ("b", 1), ("c", 90)):
        (tmp_path / f"{name}.txt").write_bytes("".join(f"{name}{k} line\n" * 3 + "\f" for k in range(n)).encode())
    size = "spark.sql.files.maxPartitionBytes"
    try:
        spark.conf.set(size, "1000b")
        found, part = corpus.paged_files(spark, str(tmp_path)), corpus.paged_files(spark, str(tmp_path), (90, 120))
        spark.conf.set(size, "7000b")  # other blocks from here on
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        want = {(f"{name}.txt", k + 1, f"{name}{k} line\n" * 3) for name, n in (("a", 400), ("b", 1), ("c", 90)) for k in range(n)}
        assert {tuple(x) for x in found.collect()} == want and found.count() == len(want)
        assert {tuple(x) for x in part.collect()} == {x for x in want if 90 <= x[1] <= 120}
        monkeypatch.setattr(corpus, "BROADCAST_BLOCKS", 0)
        assert {tuple(x) for x in corpus.paged_files(spark, str(tmp_path), (1, 3)).collect()} == {x for x in want if x[1] <= 3}
    finally:
        spark.conf.unset(size)


def test_rows_without_a_doi_are_spread(spark):
    """Rows without a DOI don't meet in one task of the join."""
    rows = spark.createDataFrame([(k, None if k % 2 else "none", "t" * 200, "", "", "") for k in range(2000)], RECORDS).repartition(4)
    best = spark.createDataFrame([("10.1/a", 1)], "lookup string, best int")
    joined = en._with_best(rows, best.hint("merge"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = joined.rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 2000 and max(sizes) < 1000 and joined.where("lookup is not null").count() == 0


@pytest.mark.parametrize("text", ["", " \n", "none", " NoNe\t", "none of", " \u0085", "none\u0085", "nonenone", "x", "\u2028", "\x0bnone\r\n"])
def test_missing_is_told_as_by_stripping(spark, text):
    from folioscope.functions.fields import is_missing, strip_ws

    c = F.col("c")
    got, want = spark.createDataFrame([(text,)], "c string").select(is_missing(c), F.lower(strip_ws(c)).isin("", "none")).first()
    assert got == want


def test_pages_are_cut_once_and_documents_share_a_call(spark):
    docs = spark.createDataFrame([(k, 0, " the \n of ") for k in range(300)], "doc_id long, version long, text string")
    words = keywords.KeywordSet.of(["the", "of", "no"])
    counted = corrections.document_rows(docs, words)
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("sequence(") == 1
    assert {tuple(r["counts"]) for r in counted.collect()} == {(1, 1, 0)}


def test_a_state_holds_many_documents():
    import pandas as pd

    class State:
        exists = False

        def update(self, value):
            self.exists, self.get = True, value

    state = State()
    rows = lambda *r: iter([pd.DataFrame(r, columns=["id", "known", "version", "counts"])])
    deltas = lambda out: {tuple(None if pd.isna(x) else int(x) for x in r) for d in out for r in d.itertuples(index=False)}
    assert deltas(corrections._changed((0,), rows((1, True, 1, [2, 0]), (0, False, 5, [0, 1]), (1, True, 2, [3, 1])), state)) == {(1, 0, 3), (1, 1, 1), (None, 1, 1)}
    assert deltas(corrections._changed((0,), rows((1, True, 2, [9, 9]), (0, True, 1, [1, 0]), (0, False, 6, [0, 0])), state)) == {(0, 0, 1), (None, 1, -1)}
    assert list(corrections._changed((0,), rows((1, True, 0, [7, 7])), state)) == []
