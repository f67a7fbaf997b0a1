import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontaminate as dc
from folioscope.llm import jaccard_join as jj
from folioscope.llm.components import connected_components, forest

from .helpers import DATA, HAVE, empty_documents, odd_documents, prose


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text, n):
    w = words_of(text)
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n=4, percent=85):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return sorted((str(doc), len(sets[k]), str(least.get(find(k), doc))) for k, (doc, _) in enumerate(rows))


def got_components(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def varied(seed):
    """Families of near copies, shared passages and chains, and texts long enough for long sketches."""
    r = random.Random(seed)
    passage = prose(99, 55)
    texts = []
    for f in range(12):
        base = prose(seed * 100 + f, r.choice([3, 8, 40, 120, 400])).split()
        for _ in range(r.choice([1, 2, 6])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(w) + (" " + passage if r.random() < 0.4 else ""))
    long = prose(seed + 7000, 2500).split()
    for k in range(4):
        w = list(long)
        for _ in range(k * 25):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        texts.append(" ".join(w))
    return list(enumerate(texts))


@pytest.mark.parametrize("unit", [jj.UNIT, 300])
@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed, unit):
    rows = varied(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got_components(jj.components(df, unit=unit)) == brute_components(rows)
    assert got_components(jj.components(df, 5, 80, unit)) == brute_components(rows, 5, 80)


def test_odd_rows(spark):
    df = odd_documents(spark)
    assert got_components(jj.components(df)) == brute_components([(r["doc_id"], r["text"]) for r in df.collect()])
    assert jj.components(empty_documents(spark)).count() == 0


@pytest.mark.skipif(not HAVE, reason="no tables")
def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert got_components(jj.op5_jaccard_join(spark, DATA)) == brute_components(rows)


def test_trie_finds_all_links():
    r = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = r.integers(0, 2**60, int(r.integers(1, 200))).astype(np.uint64)
        for _ in range(3):
            other = base.copy()
            other[r.random(len(base)) < r.choice([0, 0.02, 0.08, 0.2])] = r.integers(0, 2**60)
            sets.append(np.unique(other))
    sets = list({s.tobytes(): s for s in sets}.values())
    everything, ranks = np.unique(np.concatenate(sets), return_inverse=True)
    ranked = [np.sort(x).astype(np.uint32) for x in np.split(ranks, np.cumsum([len(s) for s in sets])[:-1])]
    trie = jj.Trie(ranked, np.arange(len(sets)))
    for k, s in enumerate(ranked):
        inside = np.zeros(len(everything), np.int64)
        inside[s] = 1
        got = set(trie.names[trie.search(inside, len(s), 85)].tolist())
        assert got == {j for j, o in enumerate(ranked) if 185 * len(np.intersect1d(s, o)) >= 85 * (len(s) + len(o))}, k


def test_sketches_lose_no_link():
    r = np.random.default_rng(4)
    sets = []
    for n in (30, 900, 1000, 1100, 3000, 9000, 12000):
        base = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        for share in (0, 0.04, 0.08, 0.3):
            other = base.copy()
            k = int(len(base) * share)
            other[r.choice(len(base), k, replace=False)] = r.integers(0, 2**63, k)
            sets.append(np.unique(other))
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sizes = [sets[k] for k in order], sizes[order]
    short = np.stack([np.frombuffer(jj.parity(s), np.uint64) for s in sets])
    long = [jj.parity(s, jj.LONG[len(s) > 2 * jj.LONG[0]]) if len(s) > jj.BITS else jj.parity(s) for s in sets]
    for a, b in (jj.plausible(np.arange(len(sets)), sizes, short, 85), jj.plausible_long(np.arange(len(sets)), sizes, long, 85)):
        node, root = forest(np.array(a, np.int64), np.array(b, np.int64))
        label = dict(zip(node.tolist(), root.tolist()))
        for i, s in enumerate(sets):
            for j in range(i):
                if 185 * len(np.intersect1d(s, sets[j])) >= 85 * (sizes[i] + sizes[j]):
                    assert label.get(i, i) == label.get(j, j)


def test_connected_components(spark):
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(250)] + [(-5, -9), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for x in list(root) if x not in alone}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_that_share_their_smallest_id(spark):
    """w - x - y - z are a chain of links; x and y have the same doc_id."""
    base = prose(800, 200).split()
    text = lambda k: " ".join(base[k : k + 100])
    rows = [(3, text(0)), (1, text(6)), (1, text(12)), (2, text(18))]
    sets = [jj.Shingles().of(t) for _, t in rows]
    near = lambda i, j: len(np.intersect1d(sets[i], sets[j])) * 185 >= 85 * (len(sets[i]) + len(sets[j]))
    assert [near(i, j) for i, j in ((0, 1), (1, 2), (2, 3), (0, 2), (1, 3), (0, 3))] == [True] * 3 + [False] * 3
    got = jj.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["component_id"] for r in got] == [1] * 4


# --- benchmark decontamination


def brute_leaks(docs, items, n=5, similarity=0.8):
    found = {}
    for item, it in items:
        want = words_of(it)
        if not want:
            continue
        k = min(n, len(want))
        grams = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else []  # noqa: E731, B023
        theirs = grams(want)
        for doc, text in docs:
            w = words_of(text)
            for start in range(max(1, len(w) - len(want) + 1)):
                own = grams(w[start : start + len(want)])
                both = sum(min(own.count(g), theirs.count(g)) for g in set(own))
                if own and both / (len(own) + len(theirs) - both) >= similarity:
                    found[(doc, item)] = max(found.get((doc, item), 0), both / (len(own) + len(theirs) - both))
    return found


def test_leaks_equal_brute_force(spark):
    items = [(1, prose(50, 40)), (2, prose(51, 60)), (3, "three short words"), (4, None), (5, ""), (6, prose(52, 5)), (7, "the the the the the the the the")]
    base = prose(51, 60).split()
    changed = lambda *at: " ".join("zz" if k in at else w for k, w in enumerate(base))
    docs = [(1, prose(60, 30) + " " + items[0][1].upper() + " " + prose(61, 30)), (2, changed(30)), (3, prose(9, 10) + " " + changed(0, 59)), (4, changed(10, 20, 30, 40)), (5, "say three short  words now"), (6, None), (7, ""), (8, items[5][1]), (9, "the " * 40), (10, prose(62, 200)), (11, " ".join(base[:45])), (12, "x " + " ".join(base[:30]) + " inserted " + " ".join(base[30:]))]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got.collect()} == {k: round(v, 9) for k, v in brute_leaks(docs, items).items()}


def test_no_leak_is_lost_outside_the_radius(spark):
    """Ends replaced by one repeated word: similarity 0.80 to 0.85, but fingerprints of words that are far apart."""
    items, docs = [], []
    for k, (size, tail) in enumerate([(50, 5), (58, 6), (58, 5), (100, 10), (100, 9), (31, 3)] * 4):
        words = [f"w{k}x{i}" for i in range(size)]
        items.append((k, " ".join(words)))
        docs.append((k, prose(k, 20) + " " + " ".join(words[: size - tail] + ["....."] * tail) + " " + prose(100 + k, 20)))
    want = brute_leaks(docs, items)
    assert len(want) >= 20 and sum(0.8 <= v < 0.85 for v in want.values()) >= 16
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = dc.contaminated(*frames).collect()
    few = dc.contaminated(*frames, radius=3).collect()
    assert any(r["hamming"] > 3 for r in few)
    for got in (rows, few):
        assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_leaks_that_no_alignment_finds(spark):
    """Parts of an item in another order, at every kind of place, against all windows; and how many of them the radius itself has."""
    r = random.Random(11)
    items, docs = [], []
    for k in range(30):
        words = [f"v{k}x{i}" if i % 7 else "and" for i in range(r.choice([5, 9, 31, 45, 80, 81]))]
        items.append((k, " ".join(words)))
        cut = r.randrange(len(words))
        edits = {"swap": words[cut:] + words[:cut], "less": words[: -(len(words) // 10) or None], "same": words, "twice": words + words, "in": words[:cut] + ["new"] + words[cut:]}
        for j, w in enumerate(edits.values()):
            docs.append((10 * k + j, " ".join([prose(k + j, r.choice([0, 1, 30])), *w, prose(900 + k, r.choice([0, 2, 50]))])))
    want = brute_leaks(docs, items)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = dc.contaminated(*frames).collect()
    assert {(x["doc_id"], x["item_id"]): round(x["similarity"], 9) for x in got} == {k: round(v, 9) for k, v in want.items()}
    assert sum(k[0] % 10 == 0 for k in want) >= 8  # swapped parts
    assert sum(x["hamming"] <= dc.RADIUS for x in got) / len(got) >= 0.9


def test_leaks_of_odd_rows(spark):
    items = spark.createDataFrame([(1, prose(1, 60)), (None, "x"), (2, "word word word word word word")], "item_id long, text string")
    got = dc.contaminated(odd_documents(spark), items)
    assert {(7, 1), (8, 1), (10, 2)} == {(r["doc_id"], r["item_id"]) for r in got.collect()}
    nameless = odd_documents(spark).withColumn("doc_id", F.lit(None).cast("long"))
    assert {(None, 1), (None, 2)} == {(r["doc_id"], r["item_id"]) for r in dc.contaminated(nameless, items).collect()}
    assert dc.contaminated(empty_documents(spark), items).count() == 0
    assert dc.contaminated(odd_documents(spark), items.limit(0)).count() == 0


@pytest.mark.skipif(not HAVE, reason="no tables")
def test_query_finds_all_verbatim_items(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    flat = lambda c: F.concat(F.lit(" "), F.array_join(dc.words_of(c), " "), F.lit(" "))
    inside = docs.select("doc_id", flat(F.col("text")).alias("d")).crossJoin(F.broadcast(items.select("item_id", flat(F.col("text")).alias("i")))).where(F.contains("d", "i"))
    got = {(r["doc_id"], r["item_id"]) for r in dc.op10_decontaminate(spark, DATA).collect()}
    assert {(r["doc_id"], r["item_id"]) for r in inside.collect()} <= got


def test_blocks_cover_the_radius(spark):
    r = random.Random(2)
    rows = []
    for k in range(200):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), dc.RADIUS):
            b ^= 1 << bit
        rows.append((k, a - (1 << 63), b - (1 << 63)))
    df = spark.createDataFrame(rows, "k int, a long, b long")
    left = dc.with_blocks(df.select("k", F.col("a").alias("print")), dc.RADIUS)
    right = dc.with_blocks(df.select("k", F.col("b").alias("print")), dc.RADIUS).withColumnRenamed("print", "other")
    assert left.join(right, ["k", "block", "bits"]).select("k").distinct().count() == 200
