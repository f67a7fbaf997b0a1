"""Ranked lexical search of many items over all documents, in whole numbers.

Postings are a table of (bucket of the term, term, row, doc_id, n, tf), written once; a document's own row has the empty term. The items'
terms are joined with the postings, each match is scored, the scores are summed by item and document, and a window over each item's sums
numbers the best. Every document with a term of the item is scored; nothing is pruned.

A term is a run of ASCII letters and digits and of all characters beyond ASCII; A-Z are lower-cased, nothing else is.

What grows: postings of the items' terms only are kept, in pieces of a bucket and a slice of the documents, so a term of every document is
in as many pieces as there are slices. For the sums they are dealt by document, so all sums of a document are made in one task, which holds
a bounded number of them; before the shuffle of the window each task keeps k rows of an item. Items are joined in blocks of at most
`BLOCK_TERMS` rows, each of them broadcast.

Nulls: a null text has no terms, is no document of N, and is in no result; a null doc_id is ranked after the others of its score. Empty
tables give no rows. Repeated rows are ranked one by one; equal scores go by doc_id, then in any order. Rows of benchmark with one item_id
are one item, with the terms of all of them; an item without terms, or without a document, has no rows. A very long text is one row like
others. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import plan_bytes, table, written

TOP, BUCKETS = 10, 16
#: Rows of (item, term) that are broadcast at once, and sums of a task, about.
BLOCK_TERMS, TASK_MATCHES = 200_000, 8_000_000
#: Slices of the documents: at least so many, or one for so many bytes of their table.
SLICES, SLICE_BYTES = 4, 1 << 30
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order, as UTF-8; bytes.lower() changes A-Z alone."""
    return _TERM.findall(text.encode("utf-8", "replace").lower()) if text else []


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.string()), ("tf", pa.int64())])
    columns: list[list] = [[], [], [], [], []]

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary()).cast(pa.string()), pa.array(columns[4], pa.int64())], schema=out)
        for c in columns:
            c.clear()
        return made

    for b in batches:
        for row, doc_id, text in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
            found = terms_of(text.as_py())
            if not found:
                continue
            counts = Counter(found)
            k = len(counts) + 1
            for c, v in zip(columns, ([row] * k, [doc_id] * k, [len(found)] * k, [b"", *counts], [1, *counts.values()])):
                c += v
            if len(columns[0]) > 50_000:
                yield batch()
    yield batch()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: each term of an item once."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.explode(F.split(lowered, "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    return items.select("item_id", terms.alias("term")).where("term <> ''").distinct()


def postings(docs: DataFrame, vocabulary: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """bucket, term, row (a number for each row of docs), doc_id, n (terms of the document with repeats), tf; a row with the empty term for
    each document that has terms. vocabulary: the terms to keep, each once (all where it is not given)."""
    slices = max(SLICES, plan_bytes(docs) // SLICE_BYTES)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(_counted, "row long, doc_id long, n long, term string, tf long")
    if vocabulary is not None:
        known = vocabulary.select("term").unionAll(docs.sparkSession.range(1).select(F.lit("")))
        found = found.join(F.broadcast(known) if known.count() <= BLOCK_TERMS else known, "term", "left_semi")
    bucketed = found.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), "term", "row", "doc_id", "n", "tf")
    piece = F.pmod(F.xxhash64("row"), F.lit(slices))
    return bucketed.repartition(buckets * slices, "bucket", piece).sortWithinPartitions("bucket", "term")


def weights(index: DataFrame, terms: DataFrame) -> tuple[DataFrame, int, int]:
    """item_id, bucket, term, df and the term's weight w; N; L."""
    n_docs, all_terms = index.where("term = ''").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = index.where("term <> ''").groupBy("bucket", "term").agg(F.count("*").alias("df"))
    w = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (F.lit(2.0) * F.col("df") + F.lit(1.0))))
    return terms.join(df, "term").select("item_id", "bucket", "term", "df", w.cast("long").alias("w")), n_docs, all_terms


def search(index: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, score above 0. index: written postings; items: item_id, text."""
    spark = index.sparkSession
    found, n_docs, all_terms = weights(index, item_terms(items))
    rated = written(found, "item-terms")
    n_terms, n_matches = rated.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    m = F.lit(100 - 90) + F.expr(f"(90L * n * {n_docs}L) div {max(1, all_terms)}L")
    part = F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")
    # a document's postings in one task, so that its sums need no further shuffle
    dealt = index.where("term <> ''").withColumn("m", m).select("bucket", "term", "row", "doc_id", part.alias("part")).repartition(max(1, -(-n_matches // TASK_MATCHES), spark.sparkContext.defaultParallelism), "row")
    blocks = max(1, math.ceil(n_terms / block_terms))
    by_item = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")

    def best(block: DataFrame) -> DataFrame:
        matched = dealt.join(F.broadcast(block.select("item_id", "bucket", "term", "w")), ["bucket", "term"])
        sums = matched.groupBy("row", "doc_id", "item_id").agg(F.sum(F.col("w") * F.col("part")).alias("score")).where("score > 0")
        return sums.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= k)

    each = [rated.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else rated for b in range(blocks)]
    return reduce(DataFrame.unionAll, map(best, each)).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    index = written(postings(table(spark, sf_dir, "documents"), item_terms(items).select("term").distinct()), "postings")
    return search(index, items)
