"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

A window is as many words of a document as an item has, at any place. Its 64-bit SimHash (of its n-word shingles, weighted by their
counts) is cut into radius + 1 blocks; a window and an item of its size whose fingerprints differ in at most `radius` bits agree
in a block, so an equi-join on size and blocks finds all of them. They are verified by the exact weighted similarity of their shingles
(the sum of the smaller counts over the sum of the larger).

A window can be similar to no item of its size unless nearly all of its places (`needed` of them) have a shingle of such items. So
documents are first joined with the items' shingles, and windows are made wherever enough of these places lie together: that leaves
out no window that could be found. Windows with the same shingles are fingerprinted and verified once, and so are equal texts.

A SimHash bounds no similarity for certain: at the threshold, some similar windows lie outside the radius. They aren't lost: windows
that have enough places with shingles of one and the same item are verified too, however far apart the fingerprints.

Words are runs of anything but white space, in lower case. An item of fewer than n words is one shingle, its words; a document that is
shorter than an item is one window. Shingles are equal if their 64-bit hashes are.

Nulls: a null or empty text or item has no words and matches nothing; a null item_id is left out; a null doc_id is searched and given
back as null. Rows that repeat a doc_id count together, each text searched by itself. Ties in similarity go to the earliest window. A very
long text is one row and gives as many windows as it has places to look at. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, table, written

WORDS, SIMILARITY, RADIUS = 5, 0.8, 12
#: Rows of the items' shingles or blocks, of texts' numbers and of windows found, up to which they are broadcast (some tens of MB); beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), "")


def shingle_rows(df: DataFrame, n: int) -> DataFrame:
    """df with `words` exploded to n-word shingles: columns pos and gram (a hash); df's other columns stay."""
    others = [c for c in df.columns if c != "words"]
    arrays = [F.col("words")] + [F.slice("words", F.lit(k + 1), F.size("words")) for k in range(1, n)]
    zipped = F.arrays_zip(*[a.alias(f"w{k}") for k, a in enumerate(arrays)])
    rows = df.where(F.size("words") >= n).select(*others, F.posexplode(zipped).alias("pos", "g"))
    parts = [F.col("g")[f"w{k}"] for k in range(n)]
    return rows.where(parts[-1].isNotNull()).select(*others, "pos", F.xxhash64(*parts).alias("gram"))


def grams_of(words: Column, len_: Column) -> Column:
    """Hashes of all shingles of len_ words; the hash of an array is that of its elements one after the other, as in shingle_rows."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - len_ + 1), lambda k: F.xxhash64(F.slice(words, k, len_)))


def fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `print`: the SimHash of each group's `gram`s; a bit is set if more than half of them have it."""
    ones = [F.sum(F.shiftrightunsigned("gram", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    bits = [F.when(F.col(f"b{b}") * 2 > F.col("n_grams"), F.lit(-(1 << 63) if b == 63 else 1 << b)).otherwise(F.lit(0)) for b in range(64)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n_grams"), *ones).select(*keys, reduce(Column.bitwiseOR, bits).alias("print"))


def with_blocks(prints: DataFrame, radius: int) -> DataFrame:
    """A row for each of radius + 1 blocks of the fingerprint: `block` and its value `bits`."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    cut = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("print", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    return prints.select("*", F.inline(F.array(*cut)))


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def window_starts(matched: DataFrame, keys: list[str], n: int, similarity: float) -> DataFrame:
    """keys and `start` of every window with as many matched places as a similar one needs. matched: keys (n_words and size among
    them) and pos, a place whose shingle is known.

    Matched places m in order: a window that has m[j] to m[j + needed - 1] begins from just so late that the last is in it to m[j]. Places
    that an earlier j has covered are left out."""
    len_ = F.least("size", F.lit(n))
    width = F.least("size", "n_words") - len_ + 1  # shingles of a window
    needed = F.ceil((F.col("size") - len_ + 1 + width) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9)).cast("int")
    groups = matched.groupBy(*keys).agg(F.sort_array(F.collect_set("pos")).alias("m"))
    groups = groups.select("*", width.alias("width"), needed.alias("needed"), (F.col("n_words") - F.least("size", "n_words")).alias("last")).where(F.size("m") >= F.col("needed"))
    at = lambda j: F.get("m", j)

    def span(j: Column) -> Column:
        end = at(j + F.col("needed") - 1)
        low = F.greatest(F.lit(0), end - F.col("width") + 1, F.when(j > 0, F.least(at(j - 1), "last") + 1).otherwise(0))
        high = F.least(at(j), "last")
        return F.when((end - at(j) < F.col("width")) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    spans = F.transform(F.sequence(F.lit(0), F.size("m") - F.col("needed")), span)
    return groups.select(*keys, F.explode(F.flatten(spans)).alias("start"))


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start_word (of the best window, from 0), n_words, hamming, similarity: a row for each document and item found in it."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.select("item_id", F.size("words").alias("size"), F.least(F.size("words"), F.lit(n)).alias("len"), "words")
    marks = written(items.select("item_id", "size", "len", F.explode(grams_of(F.col("words"), F.col("len"))).alias("gram")), "items")
    lens = {r["len"]: r["n"] for r in marks.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most n rows
    if not lens:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double")

    # places of texts that have a shingle of an item; equal texts are looked at once from here on
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    hits = []
    for k, count in sorted(lens.items()):
        grams = shingle_rows(keyed.select("doc_id", "text_key", F.size("words").alias("n_words"), "words"), k)
        hits.append(grams.join(few(marks.where(F.col("len") == k).select("gram", "item_id", "size").distinct(), count), "gram").drop("gram"))
    hits = written(reduce(DataFrame.unionAll, hits), "hits")
    places = hits.drop("doc_id").distinct()

    # windows of each size, and their shingles: only texts that have a window are read again
    starts = written(window_starts(places, ["text_key", "n_words", "size"], n, similarity), "starts")
    wanted = starts.groupBy("text_key").agg(F.collect_list(F.struct("size", "start")).alias("windows"))
    number = wanted.count()
    texts = keyed.join(few(wanted.select(F.col("text_key")), number), "text_key", "left_semi").groupBy("text_key").agg(F.min("words").alias("words"))
    cut = F.transform("windows", lambda w: F.struct(w["size"].alias("size"), w["start"].alias("start"), F.slice("words", w["start"] + 1, w["size"]).alias("own")))
    windows = texts.join(wanted, "text_key").select("text_key", F.inline(cut))
    windows = windows.select("text_key", "size", "start", grams_of(F.col("own"), F.least("size", F.lit(n))).alias("grams"))
    windows = written(windows.withColumn("window", F.xxhash64("size", "grams")), "windows")
    grams = written(windows.groupBy("window", "size").agg(F.first("grams").alias("grams")).select("window", "size", F.explode("grams").alias("gram")), "window-grams")

    # windows and items whose fingerprints are near: all that agree in a block
    prints = written(fingerprint(grams, ["window", "size"]), "prints")
    item_prints = written(fingerprint(marks, ["item_id", "size"]).withColumnRenamed("print", "item_print"), "item-prints")
    right = with_blocks(item_prints.withColumnRenamed("item_print", "print"), radius).withColumnRenamed("print", "item_print")
    hamming = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    near = with_blocks(prints, radius).join(few(right, sum(lens.values())), ["size", "block", "bits"]).withColumn("hamming", hamming)
    near = written(near.where(F.col("hamming") <= radius).groupBy("window", "item_id").agg(F.min("hamming").alias("hamming")), "near")

    # outside the radius: windows that have enough places of one item
    may = window_starts(places, ["text_key", "n_words", "size", "item_id"], n, similarity).join(windows.drop("grams"), ["text_key", "size", "start"])
    far = may.select("window", "item_id").distinct().join(near, ["window", "item_id"], "left_anti")
    far = far.join(prints.drop("size"), "window").join(item_prints.drop("size"), "item_id").select("window", "item_id", hamming.alias("hamming"))

    # exact: counts of shingles
    own = grams.groupBy("window", "gram").agg(F.count("*").alias("own"))
    theirs = marks.groupBy("item_id", "gram").agg(F.count("*").alias("theirs"))
    sizes = grams.groupBy("window").agg(F.count("*").alias("window_size"))
    item_sizes = marks.groupBy("item_id", F.col("size").alias("n_words")).agg(F.count("*").alias("item_size"))
    shared = near.unionAll(far).join(own, "window").join(theirs, ["item_id", "gram"]).groupBy("window", "item_id", "hamming").agg(F.sum(F.least("own", "theirs")).alias("both"))
    scored = shared.join(sizes, "window").join(item_sizes, "item_id").withColumn("similarity", F.col("both") / (F.col("window_size") + F.col("item_size") - F.col("both")))
    found = written(scored.where(F.col("similarity") >= similarity).select("window", "item_id", "n_words", "hamming", "similarity"), "found")

    best = F.max(F.struct("similarity", (-F.col("start")).alias("at"), (-F.col("hamming")).alias("h"), "n_words")).alias("x")
    of_texts = windows.drop("grams", "size").join(few(found, found.count()), "window").groupBy("text_key", "item_id").agg(best)
    rows = hits.select("doc_id", "text_key").distinct().join(of_texts, "text_key").groupBy("doc_id", "item_id").agg(F.max("x").alias("x"))
    return rows.select("doc_id", "item_id", (-F.col("x.at")).cast("long").alias("start_word"), F.col("x.n_words").cast("long").alias("n_words"), (-F.col("x.h")).cast("int").alias("hamming"), F.col("x.similarity").alias("similarity"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hamming")
