"""Lexical search, quality rules and phrases against plain Python over odd and random texts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioscope.llm import lexical, phrases, quality_rules

from .helpers import ODD_TEXTS, empty_documents, odd_documents, prose

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HARD = ["Éa, É b c d e A-b_c'd #1", "x.y;z\tx.y;z\nx y\r\nx y\x0bx\x0cy", "İI ıK ß 漢字 漢字 \U0001f600", "a  b\t\tc", "\x00\x1f\x7f a\x00b"]


def rows_of(texts):
    return [(k, t, ("en", "fr", None)[k % 3]) for k, t in enumerate(texts)]


# --- lexical search ---------------------------------------------------------------------------------------------------


def plain_terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(ASCII_LOWER))


def plain_search(docs, items, k=10):
    """docs: (doc_id, text) rows; items: item_id to a set of terms."""
    found = [(d, Counter(plain_terms(t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n_docs, all_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, terms in items.items():
        scores = []
        for d, c in found:
            n = sum(c.values())
            m = 10 + 90 * n * n_docs // all_terms
            scores.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c), d))
        best = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, r, d, s) for r, (s, d) in enumerate(best, 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, tmp=None, **options):
    from folioscope.storage import written

    index = written(lexical.postings(docs, lexical.item_terms(items).select("term").distinct()), "postings")
    found = lexical.search(index, items, **options)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, found.collect()), key=str)


ITEMS = [(0, "The la ouvre, THE mon kel"), (1, None), (2, "nothing9of the kind"), (3, "far far FAR"), (3, "ith"), (4, "!!"), (5, "é É 漢字 x y word")]


def test_search_equals_brute_force(spark):
    r = random.Random(3)
    texts = [*ODD_TEXTS, *HARD, *[" ".join(r.choice("la de The ouvre mon kel far ith bel x y z".split()) for _ in range(r.randrange(1, 40))) for _ in range(120)]]
    docs = [(k if k != 4 else None, t) for k, t in enumerate(texts)] + [(9, texts[9]), (9, texts[9])]
    items = defaultdict(set)
    for i, t in ITEMS:
        items[i] |= set(plain_terms(t))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    given = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = plain_search(docs, items)
    assert {x[0] for x in want} == {0, 2, 3, 5}
    assert searched(spark, frame, given) == want
    assert searched(spark, frame, given, block_terms=2) == want, "several blocks of items"
    assert searched(spark, frame, given, k=3) == plain_search(docs, items, 3)


def test_search_ties_go_by_doc_id(spark):
    frame = spark.createDataFrame([(k, "same words here") for k in (7, 3, 5, 1)] + [(2, "other")] * 9, "doc_id long, text string")
    got = searched(spark, frame, spark.createDataFrame([(1, "same")], "item_id long, text string"), k=3)
    assert [(r, d) for _, r, d, _ in got] == [(1, 1), (2, 3), (3, 5)]


def test_search_of_odd_and_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert len(searched(spark, odd_documents(spark), items)) == 5  # columns named bucket and node are ignored
    assert searched(spark, empty_documents(spark), items) == []
    assert searched(spark, odd_documents(spark), items.limit(0)) == []


def test_a_term_of_every_document_is_in_several_pieces(spark):
    frame = spark.range(4000).selectExpr("id as doc_id", "concat('the w', id % 50) as text")
    index = lexical.postings(frame)
    pieces = index.where("term = 'the'").selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    assert len(pieces) >= 3 and sum(p["count"] for p in pieces) == 4000
    assert index.where("term = ''").count() == 4000


# --- quality rules ----------------------------------------------------------------------------------------------------


def plain_rules(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", [*ODD_TEXTS, *HARD, "a\na\n a\n\n \na", "x | y | x | y | # $", "a b c d e a b c d e", "a b c d e f a b c d e", "q " * 11])
def test_plain_counts(text):
    assert quality_rules.plain_counts(text) == plain_rules(text)


def test_repeated_windows_with_many_different_words():
    r = random.Random(1)
    words = [f"w{r.randrange(20_000)}" for _ in range(60_000)]
    words[40_000:40_100] = words[100:200]
    text = " ".join(words)
    assert len(set(words)) ** 5 > 1 << 62
    assert quality_rules.plain_counts(text) == plain_rules(text)


def plain_judgement(docs, labels, threshold, prior):
    import hashlib

    token = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[!-/:-@\\[-`{-~]+")

    def grams(text):
        h = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in token.findall(text or "")]
        return [x % 65536 for x in h] + [(a * quality_rules.PAIR + b) % 65536 for a, b in zip(h, h[1:])]

    good = {d for d, _ in labels if d is not None} - {d for d, q in labels if q != 1}
    raw, trusted = Counter(), Counter()
    for d, t in docs:
        raw.update(grams(t))
        trusted.update(grams(t) if d in good else [])
    n_raw, n_trusted = sum(raw.values()), sum(trusted.values())
    weight = lambda b: math.floor(math.log((trusted[b] + 8) / (raw[b] * (n_trusted / n_raw) + 8)) * 1e6 + 0.5) if n_trusted else 0
    out = []
    for d, t in docs:
        base, g = plain_rules(t), grams(t)
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        llr = sum(map(weight, g))
        out.append((d, *base, failed, not failed and llr >= threshold * (len(g) + prior)))
    return sorted(out, key=str)


def test_judgement_equals_brute_force(spark):
    texts = [*ODD_TEXTS, *HARD, *[prose(k, 40) for k in range(60)], *[" ".join(f"{w}###" for w in prose(k, 40).split()) for k in range(60, 80)]]
    docs = [(k if k != 5 else None, t) for k, t in enumerate(texts)] + [(20, texts[20])]
    labels = [(k, int(k < 78)) for k in range(18, 98, 2)] + [(18, 0), (None, 1), (22, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    judged = quality_rules.judge(frame, given)
    columns = ["doc_id", *quality_rules.COUNTS, "base_failed", "kept"]
    got = sorted(map(tuple, judged.select(*columns).collect()), key=str)
    want = plain_judgement(docs, [x for x in labels if x[1] is not None], quality_rules.THRESHOLD, quality_rules.PRIOR)
    assert got == want
    kept = {d for d, *_, k in want if k}
    assert {k for k in range(18, 78)} <= kept and not kept & set(range(78, 98))
    assert sorted(map(tuple, quality_rules.judge(frame.repartition(7), given).select(*columns).collect()), key=str) == got


def test_without_trusted_text_the_plain_rules_decide(spark):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    rows = quality_rules.judge(odd_documents(spark), labels).collect()
    assert len(rows) == odd_documents(spark).count()
    assert all(r["kept"] == (not r["base_failed"]) and r["llr"] == 0 for r in rows)
    assert quality_rules.judge(empty_documents(spark), labels).count() == 0


def test_fit_is_bounded(spark):
    frame = spark.createDataFrame([(k, prose(k, 20)) for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality int")
    few, all_ = quality_rules.ngram_weights(frame, labels, fit_rows=3), quality_rules.ngram_weights(frame, labels)
    assert not np.array_equal(few, all_)


# --- phrases ----------------------------------------------------------------------------------------------------------


def plain_phrases(docs, min_count=10, top=2000, max_words=3, inside=50):
    f = defaultdict(Counter)
    total = Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(ASCII_LOWER)):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            total[lang or "und"] += len(words)
            for k in range(1, max_words + 1):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        longest = Counter()
        for p, a in frequent.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longest[p[i : i + n]] = max(longest[p[i : i + n]], a)
        found = []
        for p, a in frequent.items():
            if longest[p] and 100 * longest[p] >= inside * a:
                continue
            score, _, l, r = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((" ".join(p), a, l, r, total[lang], score))
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, k, *x) for k, x in enumerate(found[:top], 1)]
    return sorted(out)


def random_docs(seed, n):
    r = random.Random(seed)
    words = "la De mon kel é 漢 the New york city of".split()
    return [(r.choice(["en", "fr", None]), "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(r.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"top": 7}, {"min_count": 3, "max_words": 4}, {"min_count": 2, "max_words": 5, "inside": 80}])
def test_phrases_equal_brute_force(spark, options):
    docs = random_docs(1, 150) + [("en", t) for t in [*ODD_TEXTS, *HARD]]
    frame = spark.createDataFrame([(*x, "clash", 1) for x in docs], "lang string, text string, phrase string, f int").repartition(5)
    got = phrases.mine(frame, **options)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *[(c, "bigint") for c in "a l r n score".split()]]
    want = plain_phrases(docs, **options)
    assert len(want) > 5
    assert sorted(map(tuple, got.collect())) == want


def test_phrases_do_not_depend_on_what_a_task_holds_or_on_shared_bits(spark, monkeypatch):
    docs = random_docs(2, 120)
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    want = plain_phrases(docs)
    monkeypatch.setattr(phrases, "HELD", 3)
    assert sorted(map(tuple, phrases.mine(frame).collect())) == want
    real = phrases._bitmap
    monkeypatch.setattr(phrases, "_bitmap", lambda level: np.full_like(real(level), 255))
    assert sorted(map(tuple, phrases.mine(frame).collect())) == want, "all bits set"


def test_only_phrases_of_frequent_parts_are_emitted(spark):
    frame = spark.createDataFrame([("en", "aa bb cc")] * 10 + [("en", f"aa rare{k} bb") for k in range(50)], "lang string, text string")
    first = phrases.levels(frame, 1)[0]
    shared = spark.sparkContext.broadcast(phrases._bitmap(first))
    emitted = {r["phrase"] for r in frame.mapInArrow(phrases._count(2, shared), "lang string, phrase string, f long").collect()}
    assert emitted == {"aa bb", "bb cc"}


def test_phrases_of_large_counts_are_exact(spark):
    rows = [("en", "x", 3_000_000_000_000_000), ("en", "y", 2_900_000_000_000_001), ("en", "", 10**16), ("en", "x y", 2_800_000_000_000_003)]
    table = spark.createDataFrame(rows, "lang string, phrase string, f long")
    got = phrases.scored([table.where("phrase not like '% %'"), table.where("phrase like '% %'")]).collect()
    assert [(r["phrase"], r["score"]) for r in got] == [("x y", 1000000 * rows[3][2] ** 2 // (rows[0][2] * rows[1][2]))]


def test_empty_tables_give_no_phrases(spark):
    assert phrases.mine(empty_documents(spark)).count() == 0
    assert phrases.mine(odd_documents(spark).where("text is null")).count() == 0
