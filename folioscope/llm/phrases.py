"""Phrases: collocations mined level by level, each language by itself.

Texts, A-Z in lower case, are cut into pieces at `[.,;:!?]` and 0x0A-0x0D, pieces into words at blanks and tabs. Level 1 counts words. Level k
counts phrases of k words, of which only those are emitted whose first and last k-1 words are both frequent. What is frequent is broadcast as a
bitmap of hashes, which has the same size whatever the number of phrases: a phrase that gets through by a shared bit is counted for nothing,
since it can't be frequent itself, so the levels are exact. Each task adds up what it has counted before the shuffle.

A frequent phrase of two words or more is a candidate. Each of its cuts into two parts is scored from the level tables,
floor(1000000 * a * a / (l * r)), in decimals of 38 digits; the lowest score counts, ties go to the shortest first part. A candidate goes if a
longer one holds it and is `inside` per cent as frequent or more.

Nulls: a null text is empty; a null lang is `und`. Repeated rows count one by one. Ties at the end of a language's list go by count, then by the
phrase's bytes, so that the list is the same each time. Very long texts are rows like others; an empty table, or one without frequent phrases,
gives no rows. Columns other than text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix64, table, written

MIN_COUNT, MAX_WORDS, INSIDE, TOP = 10, 3, 50, 2_000
#: Bits of the broadcast bitmap (8 MB), and words that a task holds before it passes on what it has counted.
BITS, HELD = 1 << 26, 1_500_000
#: Parts of a language whose lists are cut to the length wanted before they meet in fewer parts, and at last in one.
PARTS = (16, 4, 2, 1)
#: What stands for the end of a piece among the words; no UTF-8 text has that byte.
END = b"\xff"
_TABLE = bytes(0xFF if c in b".,;:!?\x0a\x0b\x0c\x0d" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_OUT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, with END after each piece. What is left for split() to part at is blanks and tabs."""
    return ((text or "").encode("utf-8", "replace").translate(_TABLE) + END).replace(END, b" \xff ").split()


class Numbers(dict):
    """A number for each different word, from 0 on, END being the first."""

    def __init__(self):
        self[END]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def hashed(words: Iterable[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def bit_of(words: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    """A number below BITS for each phrase, from the hashes of its first words, second words and so on, and those of the languages."""
    with np.errstate(over="ignore"):
        mixed = reduce(lambda a, b: a * np.uint64(0x9E3779B97F4A7C15) + b, words) + lang
    return (mix64(mixed) & np.uint64(BITS - 1)).astype(np.int64)


def _counted(k: int, bits: np.ndarray | None, numbers: Numbers, ids: np.ndarray, langs: list[str], lang: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of k words among words one after the other. lang: the number of each word's language."""
    end = ids == 0
    inside = np.ones(max(len(ids) - k + 1, 0), bool)
    for j in range(k):
        inside &= ~end[j : j + len(inside)]
    if k > 1:
        h, n = hashed(numbers)[ids], max(len(ids) - k + 2, 0)  # n runs of k - 1 words
        at = bit_of([h[j : j + n] for j in range(k - 1)], hashed(x.encode() for x in langs)[lang][:n])
        frequent = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
        inside &= frequent[:-1] & frequent[1:]
    place = np.flatnonzero(inside)
    code, size = lang[place].astype(np.int64), len(langs)
    for j in range(k):
        if size * len(numbers) >= 1 << 62:
            distinct, code = np.unique(code, return_inverse=True)
            size = len(distinct)
        code, size = code * len(numbers) + ids[place + j], size * len(numbers)
    _, first, times = np.unique(code, return_index=True, return_counts=True)
    words, names = pa.array(list(numbers), pa.binary()), pa.array(langs, pa.string())
    for lo in range(0, len(first), 50_000):
        here = place[first[lo : lo + 50_000]]
        phrase = pc.binary_join_element_wise(*[words.take(pa.array(ids[here + j])) for j in range(k)], pa.scalar(b" ", pa.binary()))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[here])), phrase.cast(pa.string()), pa.array(times[lo : lo + 50_000])], schema=_OUT)
    if k == 1:
        n = np.bincount(lang[place], minlength=len(langs))
        yield pa.RecordBatch.from_arrays([names, pa.array([""] * len(langs)), pa.array(n)], schema=_OUT)


def _count(k: int, shared):
    """lang, phrase, f of the phrases of k words; at level 1 the empty phrase counts all words. shared: the bitmap of level k - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value if shared else None
        numbers, ids, langs, lang, held = Numbers(), [], {}, [], 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            if ids:
                of_word = np.repeat(np.array(lang, np.int32), [len(x) for x in ids])
                yield from _counted(k, bits, numbers, np.concatenate(ids), list(langs), of_word)

        for batch in batches:
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                words = words_of(text.as_py())
                ids.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                lang.append(langs.setdefault(name, len(langs)))
                held += len(words)
                if held > HELD:
                    yield from passed_on()
                    numbers, ids, langs, lang, held = Numbers(), [], {}, [], 0
        yield from passed_on()

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cell and bits of the bitmap for each phrase; all phrases are of the same number of words."""
    for batch in batches:
        if batch.num_rows:
            phrases = batch.column("phrase").cast(pa.binary()).to_pylist()
            names = batch.column("lang").dictionary_encode()
            lang = hashed(x.encode() for x in names.dictionary.to_pylist())[names.indices.to_numpy()]
            numbers = Numbers()
            words = [numbers[w] for w in b" ".join(phrases).split(b" ")]
            at = bit_of(list(hashed(numbers)[np.array(words)].reshape(len(phrases), -1).T), lang)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["cell", "bits"])


def _bitmap(level: DataFrame) -> np.ndarray:
    """BITS bits, those of the level's phrases set; at most BITS / 32 rows come to the driver."""
    cells = level.where("phrase <> ''").select("lang", "phrase").mapInArrow(_marks, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(BITS // 32, np.uint32)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy().astype(np.uint32)
    return bits.view(np.uint8)


def levels(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> list[DataFrame]:
    """For each number of words: lang, phrase, f of the frequent phrases, written. The first also has each lang's empty phrase, with the
    number of all words."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    found: list[DataFrame] = []
    for k in range(1, max_words + 1):
        shared = docs.sparkSession.sparkContext.broadcast(_bitmap(found[-1])) if found else None
        counted = rows.mapInArrow(_count(k, shared), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        found.append(written(counted.where((F.col("f") >= min_count) | (F.col("phrase") == "")), f"phrases-{k}"))
    return found


def scored(tables: list[DataFrame], inside: int = INSIDE) -> DataFrame:
    """lang, phrase, a, l, r, score of every candidate that stays."""
    every = reduce(DataFrame.unionAll, tables).where("phrase <> ''")
    candidates = reduce(DataFrame.unionAll, tables[1:]).withColumn("w", F.split("phrase", " "))
    # what a longer candidate holds
    part = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    held = candidates.where(F.size("w") > 2).select("lang", F.explode(part).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    stay = candidates.join(held, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * longer < {inside} * f"))
    side = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")
    cuts = stay.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", side(F.lit(1), F.col("k")).alias("first"), side(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    counts = lambda name, count: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    both = cuts.join(counts("first", "l"), ["lang", "first"]).join(counts("rest", "r"), ["lang", "rest"])
    d = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(cast(1000000 as decimal(7, 0)) * {d('a')} * {d('a')}) div ({d('l')} * {d('r')})")
    least = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def mine(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    tables = levels(docs, max_words, min_count)
    found = scored(tables, inside)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = found
    for parts in PARTS:
        ranked = ranked.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = tables[0].where("phrase = ''").select("lang", F.col("f").alias("n"))  # a row for each language
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))
