"""Quality selection by importance resampling.

Two generative models over hashed n-grams are estimated: one of target text (labelled rows of good quality), one of raw
text (all documents). A document's importance is the log ratio of its probability under the two: the sum over its n-grams. Adding
Gumbel noise and keeping the k largest draws k documents without replacement in proportion to their importance weights. k is given, or
as large a share of the documents with text as the good ones have among the labelled rows with text.

N-grams: tokens (runs of word characters, runs of other marks, as they are written) and pairs of neighbouring tokens, hashed to
`buckets`. Counts are smoothed by one for each bucket. The raw model counts all documents; the target model is fitted on at most
`fit_rows` good labels, chosen by a hash of doc_id.

Nulls: a null or empty text has no n-grams, importance null, and is not kept; null labels are no labels. Repeated rows are
drawn one by one, but with the same noise if they share a doc_id; rows without doc_id have noise of their own. Without good labels, or
with no others, every document with text is kept. Ties go to the first row. A very long text is one row like others. An empty table
gives no rows. Columns other than doc_id, text and those to keep are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

BUCKETS, SEED, FIT_ROWS = 1 << 14, 11, 20_000
#: Rows whose scores come to the driver to find the last one that is kept; where more are left, their range is narrowed once more.
EDGE_ROWS = 100_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Features:
    """Hashed n-grams of texts. Hashes of tokens already seen are looked up, and forgotten when they get many."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.known: dict[str, int] = {}

    def _new(self, token: str) -> int:
        import xxhash

        if len(self.known) > 200_000:
            self.known.clear()
        self.known[token] = found = xxhash.xxh64_intdigest(token)
        return found

    def of(self, text: str | None) -> np.ndarray:
        """Buckets of all n-grams of a text, with repetition."""
        tokens = _TOKEN.findall(text) if text else []
        if not tokens:
            return np.zeros(0, np.int64)
        known, new = self.known, self._new
        one = np.array([known.get(t) or new(t) for t in tokens], np.uint64)
        with np.errstate(over="ignore"):
            two = (one[1:] * np.uint64(0x9E3779B97F4A7C15) + one[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
        return (np.concatenate([one, two]) % np.uint64(self.buckets)).astype(np.int64)


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums = Features(buckets), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                good = batch.column("good").slice(lo, 256).to_pylist()
                each = [features.of(t) for t in batch.column("text").slice(lo, 256).to_pylist()]
                sums[0] += np.bincount(np.concatenate(each), minlength=buckets)
                if any(good):
                    sums[1] += np.bincount(np.concatenate([x for x, g in zip(each, good) if g]), minlength=buckets)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "raw", "target"])

    return run


def _importance(shared, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, ratio = Features(buckets), shared.value
        for batch in batches:
            found = [ratio[features.of(t.as_py())] for t in batch.column("text")]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array([float(x.sum()) if len(x) else None for x in found], pa.float64()), pa.array([len(x) for x in found], pa.int64())],
                [*names, "importance", "n_grams"],
            )

    return run


def importance(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, fit_rows: int = FIT_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, importance (log target probability less log raw probability; null without n-grams), n_grams, label
    (true, false or null) and row (a number of its own for each row)."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).select("doc_id", (F.col("quality") == 1).alias("label"))
    flagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[f"`{c}`" for c in keep], "text")
    spark = docs.sparkSession
    # the target sample is at most fit_rows ids, so it can be broadcast; raw counts take every row in the same pass
    sample = known.where("label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).withColumnRenamed("label", "good")
    marked = flagged.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counted = marked.mapInArrow(_counts(buckets), "bucket long, raw long, target long")
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # at most `buckets` rows
    table_ = np.zeros((2, buckets))
    table_[0][sums["bucket"].to_numpy()] = sums["raw"].to_numpy()
    table_[1][sums["bucket"].to_numpy()] = sums["target"].to_numpy()
    smooth = (table_ + 1) / (table_.sum(axis=1, keepdims=True) + buckets)
    ratio = np.log(smooth[1]) - np.log(smooth[0]) if table_[1].sum() else np.zeros(buckets)
    shared = spark.sparkContext.broadcast(ratio)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flagged.schema if f.name != "text")
    scored = flagged.mapInArrow(_importance(shared, buckets), f"{kept}, importance double, n_grams long")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "quality")
    return scored.join(known, "doc_id", "left").select("doc_id", *[f"`{c}`" for c in keep], "importance", "n_grams", "label", "row")


def gumbel(seed: int) -> "F.Column":
    """Gumbel noise from a hash of doc_id, or of the row where there is none: the same on every retry."""
    own = F.when(F.col("doc_id").isNull(), F.col("row"))
    u = (F.pmod(F.xxhash64(F.col("doc_id"), own, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, seed: int = SEED, fit_rows: int = FIT_ROWS, k: int | Callable[[DataFrame], int] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, importance, score (importance with its noise), kept: whether the row is among the k drawn.

    k may be a function of the scored rows, such as on_the_good_side."""
    found = importance(docs, labels, buckets, fit_rows, keep)
    scored = found.withColumn("score", F.when(F.col("importance").isNotNull(), F.col("importance") + gumbel(seed)))
    scored = written(scored.select("doc_id", *[f"`{c}`" for c in keep], "importance", "score", "label", "row"), "resample")
    if callable(k):
        k = k(scored)
    if k is None:
        n, good, bad = scored.where("score is not null").agg(F.count("*"), F.count_if("label"), F.count_if(~F.col("label"))).first()
        k = round(n * good / (good + bad)) if good and bad else n
    return top_k(scored, k).drop("label", "row")


def on_the_good_side(scored: DataFrame, fit_rows: int = FIT_ROWS) -> int:
    """How many documents with n-grams have more importance than the line that separates labelled rows with the fewest errors, good and
    bad ones having the same weight in all; of equal lines the lowest. Without good or bad rows: all.

    The line is fitted on at most fit_rows good and as many bad rows, chosen by a hash of doc_id."""
    usable = scored.where(F.col("importance").isNotNull() & F.col("label").isNotNull())
    each = [np.sort(usable.where(F.col("label") == x).orderBy(F.xxhash64("doc_id"), "row").limit(fit_rows).select("importance").toArrow()["importance"].to_numpy()) for x in (True, False)]
    good, bad = each
    if not len(good) or not len(bad):
        return scored.where("importance is not null").count()
    lines = np.unique(np.concatenate([[-np.inf], good, bad]))  # rows up to the line are rejected
    errors = np.searchsorted(good, lines, "right") / len(good) + 1 - np.searchsorted(bad, lines, "right") / len(bad)
    return scored.where(F.col("importance") > F.lit(float(lines[errors <= errors.min() + 1e-12][0]))).count()


def last_of(scored: DataFrame, column: str, k: int, cells: int = 1 << 12) -> tuple[float, int]:
    """The k-th largest value of a column that has more than k, and how many rows are above it.

    A histogram of bounded size finds the cell of the k-th, again and again, until few rows or one value are left in it."""
    inside, above = scored.where(F.col(column).isNotNull()), 0
    while True:
        low, high, n = inside.agg(F.min(column), F.max(column), F.count("*")).first()
        if low == high:
            return low, above
        if n <= EDGE_ROWS:
            values = np.sort(inside.select(column).toArrow()[column].to_numpy())[::-1]
            return values[k - above - 1].item(), above + int((values > values[k - above - 1]).sum())
        cell = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit((high - low) / cells)), F.lit(cells - 1)).cast("long")
        counts = {r["cell"]: r["n"] for r in inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}  # at most `cells` rows
        for at in sorted(counts, reverse=True):
            if above + counts[at] >= k:
                break
            above += counts[at]
        inside = inside.where(cell == at)


def top_k(scored: DataFrame, k: int, cells: int = 1 << 12, tie: str = "row") -> DataFrame:
    """Mark the k largest scores as kept, exactly and without sorting all rows; equal ones by the smallest `tie`, which tells rows apart."""
    n = scored.agg(F.count("score")).first()[0]
    if k <= 0 or k >= n:
        return scored.withColumn("kept", F.lit(k > 0) & F.col("score").isNotNull())
    least, above = last_of(scored, "score", k, cells)
    equal = scored.where(F.col("score") == F.lit(least)).select((-F.col(tie)).alias("tie"))
    taken = F.col("score") > F.lit(least)
    if equal.count() > k - above:
        last, _ = last_of(equal, "tie", k - above, cells)
        taken = taken | ((F.col("score") == F.lit(least)) & (-F.col(tie) >= F.lit(last)))
    else:
        taken = F.col("score") >= F.lit(least)
    return scored.withColumn("kept", F.coalesce(taken, F.lit(False)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
