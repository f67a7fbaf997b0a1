import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import ctw, langid, quality
from folioscope.llm.common import crc_mod

from .helpers import DATA, HAVE, empty_documents, odd_documents, prose


def tokens_of(text):
    return (text or "").encode().lower().split() + [b"\n"]


class SlowTree:
    """Context-tree weighting, node by node: a context is a tuple of earlier bytes, the nearest first."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, {}
        for t in texts:
            for context, node, bit in self.steps(t):
                for d in range(depth + 1):
                    self.counts.setdefault((context[:d], node), [0, 0])[bit] += 1

    def steps(self, text):
        data = b" ".join(tokens_of(text))
        for k, byte in enumerate(data):
            context = tuple(([32] * self.depth + list(data[:k]))[::-1][: self.depth])
            node = 1
            for b in range(7, -1, -1):
                yield context, node, byte >> b & 1
                node = node * 2 + (byte >> b & 1)

    def log_weighted(self, context, node):
        a, b = self.counts.get((context, node), (0, 0))
        kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(context) == self.depth:
            return kt
        below = sum(self.log_weighted(c, node) for c in {c for c, n in self.counts if n == node and len(c) == len(context) + 1 and c[:-1] == context})
        return math.log(0.5) + np.logaddexp(kt, below)

    def log_p(self, text):
        total = 0.0
        for context, node, bit in self.steps(text):
            p = None
            for d in range(self.depth, -1, -1):
                c = self.counts.get((context[:d], node), (0, 0))
                kt = (c[bit] + 0.5) / (sum(c) + 1)
                if d == self.depth:
                    p = kt
                else:
                    own = math.exp(math.log(0.5) + math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(sum(c) + 1) - math.log(math.pi) - self.log_weighted(context[:d], node))
                    p = own * kt + (1 - own) * p
            total += math.log(p)
        return total


def brute_scores(rows, depth):
    """rows: doc_id, text, lang."""
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    train = [(t, x) for d, t, x in rows if not held(d)]
    every = [w for t, _ in train for w in tokens_of(t)]
    n, v = len(every), len(set(every))
    count = {w: every.count(w) for w in set(every)}
    kinds = sorted({x for _, x in train}, key=str)
    share = {x: sum(k == x for _, k in train) + 1 for x in kinds}
    trees = {x: SlowTree([t for t, k in train if k == x], depth) for x in kinds}
    out = []
    for d, t, _ in rows:
        words = tokens_of(t)
        base = sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in words)
        each = [math.log(share[x] / sum(share.values())) + trees[x].log_p(t) for x in kinds]
        score = float(np.logaddexp.reduce(each)) / math.log(10) if each else None
        out.append((str(d), held(d), len(words), sum(w in count for w in words), n, round(base, 6), round(score, 3)))
    return sorted(out)


def got_scores(df):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 3)) for r in df.collect())


def test_scores_equal_a_slow_tree(spark):
    rows = [(k if k != 4 else None, t, ["en", "fr", None][k % 3]) for k, t in enumerate(["aB ab\tba", None, "", "ab é", "ba ba ab", "zz", "b", "abba", "é é", "ab", "ab ba", "q"])]
    rows.append(rows[0])
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, block int").repartition(3)
    got, want = got_scores(ctw.score(df, crc_mod("doc_id", 7) == 2, "lang", depth=2)), brute_scores(rows, 2)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert max(abs(g[6] - w[6]) for g, w in zip(got, want)) <= 0.002


def test_small_parts_change_nothing(spark, monkeypatch):
    rows = [(k, prose(k, 30), "en" if k % 2 else "fr") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    whole = got_scores(ctw.score(df, crc_mod("doc_id", 7) == 2, "lang"))
    for name, value in (("PART_WORDS", 50), ("PART_STRINGS", 200), ("BLOCK_TOKENS", 100), ("ROW_DOCS", 2), ("ROW_STRINGS", 90), ("GROUP", 2), ("CHUNK", 300)):
        monkeypatch.setattr(ctw, name, value)
    parts = got_scores(ctw.score(df, crc_mod("doc_id", 7) == 2, "lang"))
    assert [w[:6] for w in whole] == [p[:6] for p in parts] and max(abs(w[6] - p[6]) for w, p in zip(whole, parts)) < 0.01


def test_word_order_counts(spark):
    """The same words in an order that training texts have, and in another, get different scores."""
    rows = [(k, "alpha beta gamma delta " * 5, "en") for k in range(40)] + [(100, "alpha beta gamma delta", "en"), (101, "delta gamma beta alpha", "en")]
    got = {r["doc_id"]: r for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") >= 100, "lang").collect()}
    assert got[100]["score"] > got[101]["score"] + 1 and got[100]["base_score"] == got[101]["base_score"]
    assert abs(got[100]["bits_per_byte"] * 24 + got[100]["score"] / math.log10(2)) < 1e-6


def test_many_labels(spark):
    """Labels beyond the last class share it, and its prior is theirs together."""
    rows = [(k, f"w{k % 12} x", f"l{k % 12:02}") for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = ctw.score(df, F.lit(False), "lang", depth=2).collect()
    assert len(got) == 240 and all(-20 < r["score"] < 0 for r in got)


def test_tables_are_merged_in_bounded_memory():
    """Tables are merged a slice of the numbers at a time: what is held beside them doesn't grow with all of them."""
    import tracemalloc

    rng = np.random.default_rng(3)
    tables = [(np.sort(rng.choice(900_000, 750_000, replace=False)), rng.integers(1, 9, (750_000, 1), np.uint32)) for _ in range(8)]
    want = sum(np.bincount(c, weights=n[:, 0], minlength=900_000) for c, n in tables)
    tracemalloc.start()
    try:
        codes, sums = ctw.merged(tables)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (codes == np.flatnonzero(want)).all() and (sums[:, 0] == want[codes]).all()
    assert peak < 100_000_000
    none = (np.zeros(0, np.int64), np.zeros((0, 2), np.uint32))
    assert ctw.merged([none, none])[1].shape == (0, 2)


def test_probabilities_add_up():
    """Over all bytes that may follow a context."""
    texts = [b"ab \n", b"abc b \n", b"abab \n"] * 3
    codes, sums = ctw.string_counts(texts + [bytes([x]) for x in range(256)], np.array([0] * 9 + [-1] * 256), 1, 2)
    logs = ctw.log_probabilities(ctw.levels(codes, sums[:, 0], 0, 2))
    first = (codes >> 8) == 0x2020
    assert first.sum() == 256 and abs(np.exp(logs[first]).sum() - 1) < 1e-9


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 7.9, 8, 33.3, 1e3, 1e7])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_odd_rows_are_scored(spark):
    rows = ctw.score(odd_documents(spark), crc_mod("doc_id", 7) == 2, "lang").collect()
    assert len(rows) == odd_documents(spark).count() and all(r["score"] < 0 for r in rows)
    assert ctw.score(empty_documents(spark), crc_mod("doc_id", 7) == 2, "lang").count() == 0
    nothing = ctw.score(odd_documents(spark), F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in nothing)


@pytest.mark.skipif(not HAVE, reason="no tables")
def test_held_out_texts_are_likelier_than_by_counts(spark):
    held = [r for r in ctw.op1_ctw_score(spark, DATA.replace("0.001", "0.01")).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


# --- language identification


def test_languages_of_held_out_rows(spark):
    if not HAVE:
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang", "n_chars")
    got = langid.op2_language_id(spark, DATA.replace("0.001", "0.01")).join(docs, "doc_id").where("held_out and n_chars >= 40").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)


def test_every_language_of_an_ngram_is_returned():
    r = np.random.default_rng(1)
    grams = [np.unique(r.integers(0, 2**40, 3000).astype(np.uint64)) for _ in range(3)]
    planes = np.zeros(1 << 16, np.uint8)
    for k, g in enumerate(grams):
        for s in langid.slots_of(g, len(planes)):
            planes[s] |= 1 << k
    fill = np.array([((planes >> k) & 1).mean() for k in range(3)])
    f = langid.Filters(("a", "b", "c"), planes, fill**langid.HASHES)
    for k, g in enumerate(grams):
        assert ((f.masks(g) >> k) & 1 == 1).all()
    others = np.unique(r.integers(2**41, 2**42, 50_000).astype(np.uint64))
    for k in range(3):
        assert abs(((f.masks(others) >> k) & 1).mean() - f.false_rate[k]) < 0.01


def test_long_texts_are_cut_without_loss(monkeypatch):
    r = np.random.default_rng(6)
    planes = r.integers(0, 4, 1 << 12).astype(np.uint8)
    f = langid.Filters(("a", "b"), planes, np.array([0.1, 0.2]))
    texts = [b"", b"abc", *(bytes(r.integers(97, 123, int(n)).astype(np.uint8)) for n in (5, 40, 41, 700, 64, 68))]
    whole = langid.shares(f, texts)
    for piece in (7, 64, 100):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert np.allclose(langid.shares(f, texts), whole)


def test_odd_languages(spark):
    train = spark.createDataFrame([(k, prose(k, 80) if k % 2 else prose(k, 80).replace("a", "ü").replace("o", "ß"), "one" if k % 2 else "two") for k in range(40)], "doc_id long, text string, lang string")
    filters = langid.fit(train)
    got = {str(r["doc_id"]): r for r in langid.identify(odd_documents(spark), filters).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in ("0", "1", "2", "5"))
    assert got["8"]["lang_pred"] == "one" and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(empty_documents(spark), filters).count() == 0
    none = langid.fit(train.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd_documents(spark), none).collect()} == {"und"}


# --- quality


def test_importance_equals_plain_counts(spark):
    rows = [(k, t) for k, t in enumerate(["Aa bb bb!!", "cc Dd 12", None, "", "XX YY!!", "aa bb"])]
    labels = [(0, 1), (1, 1), (4, 0), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.importance(docs, spark.createDataFrame(labels, "doc_id long, quality int"), buckets=64).collect()}
    features = quality.Features(64)
    raw, target = np.ones(64), np.ones(64)
    for k, t in rows:
        f = features.of(t)
        np.add.at(raw, f, 1)
        if (k, 1) in labels:
            np.add.at(target, f, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for k, t in rows:
        f = features.of(t)
        assert (got[k]["importance"] is None) == (len(f) == 0)
        assert len(f) == 0 or abs(got[k]["importance"] - ratio[f].sum()) < 1e-9
    assert (got[0]["label"], got[4]["label"], got[2]["label"]) == (True, False, None)


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000, 2000])
def test_top_k_is_exact(spark, k, monkeypatch):
    monkeypatch.setattr(quality, "EDGE_ROWS", 3)
    r = np.random.default_rng(k)
    values = [None if x % 50 == 0 else float(v) for x, v in enumerate(np.round(r.standard_cauchy(1000), 1) + 0.0)]
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, score double")
    got = {r["doc_id"] for r in quality.top_k(df, k, cells=16, tie="doc_id").where("kept").collect()}
    want = sorted((i for i, v in enumerate(values) if v is not None), key=lambda i: (-values[i], i))[:k]
    assert got == set(want)


def test_gumbel_top_k_draws_by_weight(spark):
    """Of two documents, one with ln 3 more importance is drawn first in 3 of 4 pairs."""
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.col("id").alias("row")).withColumn("g", quality.gumbel(1))
    rows = df.select(F.floor(F.col("doc_id") / 2).alias("pair"), (F.col("doc_id") % 2).alias("side"), (F.col("g") + F.when(F.col("doc_id") % 2 == 0, math.log(3)).otherwise(0)).alias("s"))
    first = rows.groupBy("pair").agg(F.max_by("side", "s").alias("side")).where("side = 0").count()
    assert abs(first / 20_000 - 0.75) < 0.015


def test_odd_quality(spark):
    labels = spark.createDataFrame([(7, 1), (8, 1), (5, 0), (10, 0), (None, 1)], "doc_id long, quality int")
    rows = quality.resample(odd_documents(spark), labels).collect()
    assert len(rows) == odd_documents(spark).count()
    assert all(not r["kept"] and r["importance"] is None for r in rows if r["doc_id"] in (0, 1, 2))
    unlabelled = quality.resample(odd_documents(spark), labels.limit(0)).collect()
    assert all(r["kept"] == (r["importance"] is not None) for r in unlabelled)
    assert quality.resample(empty_documents(spark), labels).count() == 0


def test_draw_equals_a_plain_one(spark):
    """The whole draw against counts, sums and noise made by hand; it isn't the threshold that the importance alone would give."""
    import re

    r = np.random.default_rng(2)
    mixed = lambda share, n: " ".join(str(w) + ("!!" if r.random() < share else "") for w in r.choice(prose(5, 40).split(), n))
    rows = [(k, mixed([0.1, 0.5, 0.15, 0.2][k % 4], 4)) for k in range(400)]
    labels = [(k, int(k % 4 == 0)) for k in range(0, 400, 2)]
    got = {x["doc_id"]: x for x in quality.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), buckets=1 << 22).collect()}
    grams = lambda t: (lambda w: [*w, *zip(w, w[1:])])(re.findall(r"\w+|[^\w\s]+", t))
    raw = {g: 0 for _, t in rows for g in grams(t)}
    target = dict(raw)
    for k, t in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += (k, 1) in labels
    p = lambda c, g: math.log((c[g] + 1) / (sum(c.values()) + (1 << 22)))
    want = {k: sum(p(target, g) - p(raw, g) for g in grams(t)) for k, t in rows}
    assert np.mean([abs(got[k]["importance"] - want[k]) < 1e-6 for k in want]) > 0.99  # but for n-grams that share a bucket
    noise = [got[k]["score"] - got[k]["importance"] for k in want]
    assert abs(np.mean(noise) - 0.5772) < 0.2 and abs(np.std(noise) - math.pi / math.sqrt(6)) < 0.2
    order = sorted(got, key=lambda k: -got[k]["score"])
    kept = {k for k in got if got[k]["kept"]}
    assert kept == set(order[:200])  # the share of good ones among the labelled is a half
    assert kept != set(sorted(got, key=lambda k: -got[k]["importance"])[:200]) and kept != {k for k in got if got[k]["importance"] > 0}


@pytest.mark.skipif(not HAVE, reason="no tables")
def test_quality_agrees_with_labels(spark):
    d = DATA.replace("0.001", "0.01")
    got = quality.op9_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good) and sum(not r["kept"] for r in bad) >= 0.9 * len(bad)


def own_words(language, row, n=12):
    """A text in an invented language: words that no other one has."""
    import random

    vocabulary = random.Random(language)
    words = ["".join(vocabulary.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(20)]
    pick = random.Random(row)
    return " ".join(pick.choice(words) for _ in range(n))


def test_languages_beyond_one_mask_and_rare_ones_are_learned(spark):
    rows = [(1000 * k + j, f"l{k:02}", own_words(k, j, 40)) for k in range(70) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    filters = langid.fit(df, slots=1 << 16)
    assert len(filters.names) == 70
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, filters).collect()}
    assert all(got[k] == x for k, x, _ in rows)
    many = [(k, "big", own_words(900, k)) for k in range(4000)] + [(5000 + k, "rare", own_words(901, k, 40)) for k in range(6)]
    df = spark.createDataFrame(many, "doc_id long, lang string, text string")
    filters = langid.fit(df, slots=1 << 16, fit_rows=40)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, filters).collect()}
    assert all(got[k] == x for k, x, _ in many)


def test_too_many_languages_are_an_error(spark):
    df = spark.createDataFrame([(k, f"l{k}", "text") for k in range(langid.MOST_LANGUAGES + 1)], "doc_id long, lang string, text string")
    with pytest.raises(ValueError):
        langid.fit(df)
