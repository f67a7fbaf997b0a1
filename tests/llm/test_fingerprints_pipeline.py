import hashlib
import pathlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from folioscope.llm import cws, decontaminate
from folioscope.llm.common import packed, range_buckets, remove_written, shared_dir, unpacked, written

from .helpers import DATA, HAVE, empty_documents, odd_documents, prose


def bag(text):
    import re

    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    return Counter(zip(w, w[1:] + [None]))


def similarity(a, b):
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_edited_texts_and_likeness(spark):
    texts = [prose(k, 120) + " " + prose(0, 60) for k in range(25)] + ["", "x", "ab", "é\U0001f600z", "same words here", "same words here"]
    rows = [(k * 7 - 30, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int").repartition(3)
    got = {r["doc_id"]: r for r in cws.fingerprint_documents(df, slots=256).collect()}
    assert set(got) == {k for k, _ in rows}
    prints = {}
    for k, (doc, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - similarity(t, edited)) < 0.14 and abs(r["near_next"] - similarity(t, following)) < 0.14
        prints.setdefault(t, set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in prints.values()) and len(set.union(*prints.values())) == len(prints)


def test_weights_count(spark):
    """Collisions follow the generalised similarity of counts, not that of sets."""
    a, b = "x " * 90 + "y", "x " * 30 + "y"
    r = cws.fingerprint_documents(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), slots=256).where("doc_id = 1").first()
    assert abs(r["near_next"] - similarity(a, b)) < 0.1 and similarity(a, b) < 0.4


def test_accuracy_of_the_samples_in_use(spark):
    """The query's own number of samples against exact similarity: no bias, and the error of 128 samples, not of 32."""
    rows = []
    for k in range(120):
        words = (prose(k, 80) + " of the" * (k % 7)).split()
        cut = len(words) * (k % 24 + 1) // 40
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[cut:] + prose(1000 + k, cut).split()))]
    got = {r["doc_id"]: r["near_next"] for r in cws.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    exact = np.array([similarity(rows[k][1], rows[k + 1][1]) for k in range(0, len(rows), 2)])
    error = np.array([got[k] for k in range(0, len(rows), 2)]) - exact
    assert exact.min() < 0.3 and exact.max() > 0.9
    assert abs(error.mean()) < 0.012 and np.sqrt((error**2).mean()) < 0.047 and abs(error).max() < 0.15


def test_terms_of_both_texts_are_drawn_once(spark):
    """Texts that are printed together have the fingerprints they have alone, and a term that both have as often is drawn once for both."""
    pairs = [(1, "a b c d a b", "a b x y"), (2, "", "a b"), (3, "x y", ""), (4, "", ""), (5, "k l " * 9, "k l " * 4 + "m"), (6, "same words", "same words")]
    df = spark.createDataFrame([(k, a, b) for k, a, b in pairs], "k long, one string, other string")
    both = {r["k"]: r for r in cws.fingerprints_of(df, ["k"], ["one", "other"]).collect()}
    alone = [{r["k"]: r["print"] for r in cws.fingerprints(df, ["k"], text).collect()} for text in ("one", "other")]
    assert {k: (r["print0"], r["print1"]) for k, r in both.items()} == {k: (alone[0][k], alone[1][k]) for k, _, _ in pairs}
    assert set(both[2]["print0"]) == {0} and set(both[4]["print1"]) == {0} and set(both[3]["print0"]) != {0}
    plan = cws.fingerprints_of(df, ["k"], ["one", "other"])._jdf.queryExecution().optimizedPlan().toString()
    drawn = next(x for x in plan.splitlines() if "Aggregate" in x and "FLOOR" in x)
    assert drawn.count("FLOOR") == cws.PART  # a draw a slot, where each of the two texts had its own


def test_darts_are_few_and_told_by_the_text(spark, monkeypatch):
    """A long text throws a dart for each word, a short one as many as its slots need: not one for each word and slot. A slot that no dart hits takes another's sample."""
    rows = [(1, prose(1, 4000)), (2, prose(2, 300)), (3, "x " * 5000), (4, "one"), (5, "")]
    df = spark.createDataFrame(rows, "k long, text string")
    darts = {r["k"]: r["count"] for r in cws.darts_of(df, ["k"], ["text"], cws.SLOTS).where("dart is not null").groupBy("k").count().collect()}
    for k, text in rows[:4]:
        n = len(text.split())
        assert max(n, cws.HITS * cws.SLOTS) <= darts[k] < n + cws.HITS * cws.SLOTS
    assert 5 not in darts
    full = {r["k"]: r["print"] for r in cws.fingerprints(df, ["k"], "text").collect()}
    monkeypatch.setattr(cws, "HITS", 1)  # a third of the slots of short texts are missed
    few = {r["k"]: r["print"] for r in cws.fingerprints(df.unionAll(df.selectExpr("k + 10", "text")), ["k"], "text").collect()}
    assert all(len(x) == cws.SLOTS // 4 for x in [*full.values(), *few.values()]) and all(few[k] == few[k + 10] for k, _ in rows)
    assert few[1] == full[1] and few[4] != full[4] and set(few[5]) == {0}


def test_odd_fingerprints(spark):
    df = odd_documents(spark)
    rows = cws.fingerprint_documents(df).collect()
    assert len(rows) == df.count()
    ordered = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in df.collect()))
    texts = [t for _, _, t in ordered]
    want = []
    for k, t in enumerate(texts):
        half = len(t) // 2
        want.append(hashlib.sha256((t[: len(t) - half] + texts[(k + 1) % len(texts)][:half]).encode()).hexdigest())
    assert sorted(r["edited_sha256"] for r in rows) == sorted(want)
    assert all(r["fingerprint"] == "0" * 4 * cws.SLOTS for r in rows if r["n_chars"] == 0)
    assert cws.fingerprint_documents(empty_documents(spark)).count() == 0
    one = cws.fingerprint_documents(spark.createDataFrame([(5, "a b c")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_the_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for made in (cws.fingerprint_documents(df), decontaminate.contaminated(df, items)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("buckets", [1, 5, 200])
def test_ranges_keep_the_order(spark, buckets):
    df = spark.createDataFrame([(k * k * (-1) ** k,) for k in range(500)] + [(None,), (7,), (7,)], "id long")
    rows = range_buckets(df, "id", buckets).collect()
    known = sorted((r["id"], r["bucket"]) for r in rows if r["id"] is not None)
    assert all(a[1] <= b[1] for a, b in zip(known, known[1:])) and {r["bucket"] for r in rows if r["id"] is None} == {-1}


def test_packed_arrays():
    for a in (np.array([], np.uint32), np.arange(300, dtype=np.int64) - 5, np.array([1.5, -2.25, 0], np.float32)):
        assert (unpacked(packed(a), a.dtype.type) == a).all()


def test_written_tables_can_be_removed(spark):
    made = written(spark.range(3).toDF("x"), "t")
    folder = pathlib.Path(shared_dir(spark).removeprefix("file:").replace("//", "/")) / "folioscope"
    assert made.count() == 3 and folder.exists()
    remove_written(spark)
    assert not folder.exists()


def test_a_shared_folder_is_made_where_none_is_set():
    class Context:
        known, master = None, "local[4]"

        def getCheckpointDir(self):
            return self.known

        def setCheckpointDir(self, path):
            self.known = path + "/id"

    class Session:
        sparkContext = Context()
        conf = {}

    assert shared_dir(Session()) == shared_dir(Session()) == Session.sparkContext.known
    Session.sparkContext.known, Session.sparkContext.master = None, "spark://somewhere:7077"
    with pytest.raises(ValueError):  # executors couldn't read a folder of the driver's machine
        shared_dir(Session())


# --- pipeline


def fixture(spark, tmp_path):
    good = [(k, prose(k, 90), "en") for k in range(60)]
    junk = [(100 + k, " ".join(w.upper() + "!!" for w in prose(k, 20).split()[:12]) + " " + " | ".join(["***"] * 60), "en") for k in range(20)]
    copies = [(200, good[3][1], "en"), (201, good[4][1].replace(good[4][1].split()[50], "changed", 1), "en"), (3, good[3][1], "en")]
    item = prose(5000, 30)
    leaks = [(300, prose(301, 40) + " " + item + " " + prose(302, 40), "en")]
    odd = [(400, None, None), (401, "", "en"), (402, "12 34 !!", "en")]
    docs = spark.createDataFrame([(k, t, x, "s", len(t or "")) for k, t, x in good + junk + copies + leaks + odd], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 2)] + [(100 + k, 0, 0) for k in range(0, 20, 2)], "doc_id long, quality int, toxic int")
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    labels.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_do_what_they_say(spark, tmp_path):
    d = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    # 402 has marks but no letters: the draw may take it or leave it, the language stage rejects it
    for (name, stage), gone in zip(cp.STAGES[:-1], ({*range(100, 120), 400, 401}, {402}, {200, 201}, {300})):
        made = stage(spark, docs, d)
        assert made.columns == columns, name
        before, after = [r["doc_id"] for r in docs.collect()], [r["doc_id"] for r in made.collect()]
        assert (set(before) - set(after)) - {402} == (gone & set(before)) - {402}, name
        assert 402 not in after or 402 not in gone
        assert all(r["text"] for r in made.collect())
        path = f"{d}/{name.replace(' ', '-')}"
        made.write.parquet(path)
        docs = spark.read.parquet(path)
    assert Counter(r["doc_id"] for r in docs.collect()) == Counter(range(60))  # the repeated row of doc 3 went too
    pieces = cp.run(spark, d).collect()
    assert {r["doc_id"] for r in pieces} == set(range(60))


def test_near_duplicates_are_rows_not_ids(spark):
    """Null and repeated doc_ids: unrelated texts stay, and of each group one row does."""
    a, b, c, d, e, f = (prose(700 + k, 80) for k in range(6))
    rows = [(None, a), (None, b), (5, c), (5, d), (7, e), (5, e), (None, e), (1, e), (None, f), (None, f), (None, ""), (None, "")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_chars int").repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in cp.drop_near_duplicates(spark, docs, "").collect())
    assert got == Counter([(None, a), (None, b), (5, c), (5, d), (1, e), (None, f), (None, ""), (None, "")])


def test_rows_of_one_id_are_judged_each(spark, tmp_path):
    """Null and repeated doc_ids, and columns named as the pipeline's own: a leak goes, the other rows of its id stay."""
    d = fixture(spark, tmp_path)
    item = spark.read.parquet(f"{d}/benchmark.parquet").first()["text"]
    rows = [(None, "x " + item, 1), (None, prose(1, 50), 2), (4, item + " y", 3), (4, prose(2, 50), 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number int").withColumn("row", F.lit("r")).withColumn("_matched_id", F.lit(1))
    got = cp.drop_leaks(spark, docs, d)
    assert got.columns == docs.columns and sorted(r["number"] for r in got.collect()) == [2, 4]
    for stage in (cp.select_quality, cp.select_language, cp.drop_near_duplicates):
        assert stage(spark, docs, d).columns == docs.columns


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    d = fixture(spark, tmp_path)
    extra = odd_documents(spark)
    for name, stage in cp.STAGES:
        for docs in (extra, empty_documents(spark)):
            made = stage(spark, docs, d)
            made.count()
            if stage is not cp.pack:
                assert made.columns == docs.columns, name


@pytest.mark.skipif(not HAVE, reason="no tables")
def test_pipeline_query(spark):
    pieces = cp.run(spark, DATA)
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert 0.5 * n < pieces.select("doc_id").distinct().count() < n
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
