"""Quality rules: plain counts of a text, and a hashed n-gram log-likelihood ratio with a fixed threshold.

Two multinomials over hashed n-grams are counted: one of trusted text (labelled rows of good quality), one of the raw corpus (all documents).
An n-gram's weight is the log of its probability in trusted text less that in raw text, in millionths, as a whole number; a text's sum of
weights is divided by its n-grams and PRIOR more, so that a few words decide nothing. A text is kept if that is THRESHOLD or more. Sums are
of whole numbers, so the verdict on a text is the same whatever the order and number of tasks.

N-grams: tokens (runs of ASCII letters, digits and all characters beyond ASCII; runs of ASCII marks) and pairs of neighbours, hashed to
`buckets`. Each bucket's count in trusted text is raised by SMOOTH and that in raw text in proportion, so that n-grams too rare to be in
trusted text weigh little. Raw counts cover all documents; trusted text is that of at most `fit_rows` ids, the
first by a hash. Without trusted text all weights are 0, and the plain rules alone decide.

Nulls: a null or empty text has no words and fails; a null label is no label; rows with a null doc_id are in no trusted text but are judged.
Repeated rows are counted and judged one by one. A doc_id with several labels is trusted if all of them are good. A very long text is one row
like others. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS, FIT_ROWS = 1 << 16, 20_000
#: Millionths of a natural logarithm for each n-gram, and the n-grams of weight 0 that are added to each text.
THRESHOLD, PRIOR = -150_000, 32
SMOOTH = 8
#: The second of a pair is added to the first times this.
PAIR = 40_503
#: Words in a window that repeats.
WINDOW = 5
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+")
_SYMBOL = re.compile("[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Features:
    """Hashed n-grams of texts. Hashes of tokens already seen are looked up, and forgotten when they get many."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.known: dict[bytes, int] = {}

    def _new(self, token: bytes) -> int:
        if len(self.known) > 300_000:
            self.known.clear()
        self.known[token] = found = int(hashlib.md5(token).hexdigest()[:8], 16)
        return found

    def of(self, text: str | None) -> np.ndarray:
        """Buckets of all n-grams of a text, with repetition."""
        known, new = self.known, self._new
        found = _TOKEN.findall(text.encode("utf-8", "replace")) if text else []
        one = np.array([known[t] if t in known else new(t) for t in found], np.int64)
        return np.concatenate([one, one[:-1] * PAIR + one[1:]]) % self.buckets


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows that are found twice or more, by exact numbers of windows."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    codes, size = ids, len(numbers)
    for k in range(1, window):
        if size * len(numbers) >= 1 << 62:
            distinct, codes = np.unique(codes, return_inverse=True)
            size = len(distinct)
        codes = codes[: len(ids) - k] * len(numbers) + ids[k:]
        size *= len(numbers)
    _, place, times = np.unique(codes, return_inverse=True, return_counts=True)
    repeated = times[place] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + n] |= repeated
    return int(covered.sum())


def plain_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """COUNTS of a text. bytes.split() parts words at blanks and 0x09-0x0D alone."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    joined = b"".join(words)
    return len(words), len(joined.decode("utf-8")), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeat_words(words)


def _ngram_counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums = Features(buckets), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, trusted in zip(batch.column("text"), batch.column("trusted").to_pylist()):
                found = np.bincount(features.of(text.as_py()), minlength=buckets)
                sums[0] += found
                if trusted:
                    sums[1] += found
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "raw", "trusted"])

    return run


def _judged(shared, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weight = Features(buckets), shared.value
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            grams = [features.of(t) for t in texts]
            columns = [*map(list, zip(*map(plain_counts, texts))), [int(weight[g].sum()) for g in grams], list(map(len, grams))] if texts else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *COUNTS, "llr", "n_grams"])

    return run


def ngram_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """The weight of each bucket, in millionths. To the driver come at most `buckets` rows."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality = 1")
    sample = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select("doc_id", F.lit(True).alias("trusted"))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    sums = marked.mapInArrow(_ngram_counts(buckets), "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toArrow()
    counts = np.zeros((2, buckets))
    for k, name in enumerate(("raw", "trusted")):
        counts[k][sums["bucket"].to_numpy()] = sums[name].to_numpy()
    if not counts[1].sum():
        return np.zeros(buckets, np.int64)
    share = counts[1].sum() / counts[0].sum()
    return np.floor(np.log((counts[1] + SMOOTH) / (counts[0] * share + SMOOTH)) * 1e6 + 0.5).astype(np.int64)


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, fit_rows: int = FIT_ROWS, threshold: int = THRESHOLD, prior: int = PRIOR) -> DataFrame:
    """doc_id, COUNTS, base_failed, llr (sum of weights), n_grams, kept: a row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(ngram_weights(docs, labels, buckets, fit_rows))
    columns = "doc_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, "llr", "n_grams"))
    judged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_judged(shared, buckets), columns)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    verdict = F.col("llr") >= F.lit(threshold) * (F.col("n_grams") + F.lit(prior))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
