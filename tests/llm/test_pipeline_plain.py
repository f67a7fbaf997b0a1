"""The pipeline's stages over whole tables against plain versions: each is held to its own input."""

import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as cp
from folioscope.llm import quality

from .helpers import DATA, HAVE

SPACE = re.compile("[\\x09-\\x0D\\x20]+")


def words(text, lower):
    return [w for w in SPACE.split(lower(text or "")) if w]


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_quality(spark, docs, labels):
    """doc_ids of the rows that are drawn: counts in dictionaries, every line tried, one sort."""
    mask = (1 << 64) - 1

    def grams(text):
        h = [xxhash.xxh64_intdigest(t) for t in re.findall(r"\w+|[^\w\s]+", text or "")]
        two = [((b * 0x9E3779B97F4A7C15 + a * 0xC2B2AE3D27D4EB4F) & mask) >> 20 for a, b in zip(h, h[1:])]
        return [x % quality.BUCKETS for x in h + two]

    label = {}
    for doc_id, q in labels:
        if doc_id is not None and q is not None:
            label[doc_id] = min(label.get(doc_id, q), q)
    each = [(doc_id, grams(text)) for doc_id, text in docs]
    raw, target = Counter(), Counter()
    for doc_id, g in each:
        raw.update(g)
        if label.get(doc_id) == 1:
            target.update(g)
    of = lambda counts, x: math.log((counts[x] + 1) / (counts.total() + quality.BUCKETS))
    weight = {x: of(target, x) - of(raw, x) for x in raw}
    scored = [(doc_id, sum(weight[x] for x in g)) for doc_id, g in each if g]
    good, bad = ([s for d, s in scored if d in label and (label[d] == 1) == kind] for kind in (True, False))
    assert good and bad
    errors = lambda line: sum(s <= line for s in good) / len(good) + sum(s > line for s in bad) / len(bad)
    lines = sorted({-math.inf, *good, *bad})
    least = min(map(errors, lines))
    line = next(x for x in lines if errors(x) <= least + 1e-12)
    k = sum(s > line for _, s in scored)
    noise = {r["doc_id"]: r["g"] for r in spark.createDataFrame([(d, 0) for d, _ in scored], "doc_id long, row long").select("doc_id", quality.gumbel(quality.SEED).alias("g")).collect()}
    return Counter(d for d, _ in sorted(scored, key=lambda x: -(x[1] + noise[x[0]]))[:k])


def plain_near(docs):
    """All pairs, then classes; the smallest doc_id of each stays, and every text without words."""
    sets = []
    for doc_id, text in docs:
        w = words(text, ascii_lower)
        sets.append((doc_id, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    kept, classes = Counter(), {}
    for i, (doc_id, a) in enumerate(sets):
        if a:
            classes.setdefault(find(i), []).append(doc_id)
        else:
            kept[doc_id] += 1
    return kept + Counter(min(own) for own in classes.values())


def plain_leaks(docs, items):
    """Every window of every item's size that shares a shingle with the item."""

    def bag(w, n):
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    sized = [(w, min(5, len(w)), bag(w, min(5, len(w)))) for w in (words(t, str.lower) for _, t in items) if w]
    kept = Counter()
    for doc_id, text in docs:
        own = words(text, str.lower)
        known = {n: bag(own, n).keys() for n in {n for _, n, _ in sized}}

        def found(item, n, want):
            if not known[n] & want.keys():
                return False
            for at in range(max(1, len(own) - len(item) + 1)):
                have = bag(own[at : at + len(item)], n)
                both = (have & want).total()
                if both and both >= 0.8 * (have.total() + want.total() - both) - 1e-9:
                    return True
            return False

        if not any(found(*x) for x in sized):
            kept[doc_id] += 1
    return kept


@pytest.mark.skipif(not HAVE, reason="no tables")
def test_stages_equal_plain_versions(spark, tmp_path):
    read = lambda name, *columns: [tuple(r) for r in spark.read.parquet(f"{DATA}/{name}.parquet").select(*columns).collect()]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    # besides the table's own: near copies, leaks at an item's threshold, texts without words
    rows = [r for r in read("documents", "doc_id", "text") if r[1] and len(r[1].split()) > 40][:12]
    items = read("benchmark", "item_id", "text")
    more = [(900_000 + k, " ".join(t.split()[: -(k % 12)] if k % 12 else t.split()) + " end" * (k % 3)) for k, (_, t) in enumerate(rows)]
    more += [(910_000 + k, f"{rows[k % 12][1]} {' '.join(t.split()[: len(t.split()) - k % 9])} {rows[k % 12][1][:50]}") for k, (_, t) in enumerate(items[:20])] + [(920_000, None), (920_001, " \n"), (920_002, "")]
    extra = spark.createDataFrame(more, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    docs = docs.unionByName(extra.select(*docs.columns))
    gone = {}
    for name, stage in cp.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        after = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        gone[name] = len(before) - after.total()
        if stage is cp.select_quality:
            assert after == plain_quality(spark, before, read("labels", "doc_id", "quality"))
        elif stage is cp.drop_near_duplicates:
            assert after == plain_near(before)
        elif stage is cp.drop_leaks:
            assert after == plain_leaks(before, items)
        else:  # filters err by chance; here only that nothing comes in
            assert not after - Counter(d for d, _ in before)
    assert gone["quality classifier"] and gone["n-gram jaccard join"] and gone["benchmark decontamination"]
