"""Keyword counts of a growing corpus in which documents are sent again: what an earlier version has counted is taken back.

Documents come with a version. A document's counts are made in its row; keyed state holds, for each document, its last version and its counts, and what
goes on is only by how much they change. The state's key is one of a fixed number of buckets of documents, so that Python is called a bucket, not a document. Those changes are appended to a table; their sums are the counts of the last versions, of documents as of the
corpus."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.text import FilterSpec, hit_count
from ..operators import keywords as kw
from ..sources.corpus import page_texts

CHANGES = "doc_id long, ord int, delta long"
#: Keys of the state. A batch writes the state of a bucket in which it changes a document.
BUCKETS = 16_384


def document_rows(docs: DataFrame, keywords: kw.KeywordSet, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """The columns of docs, but for text, and counts (one for each keyword, in order): a row for each row of docs, without a shuffle."""
    total = lambda pages, w: F.aggregate(F.transform(pages, lambda p: hit_count(p, w, keywords.regex)), F.lit(0), lambda a, x: a + x)
    # one array of pages in an array, so that pages are cut and cleaned once for all keywords
    pages = F.array(F.transform(page_texts(F.col("text")), spec.clean))
    counts = F.get(F.transform(pages, lambda p: F.array(*[total(p, w) for w in keywords.words])), F.lit(0))
    return docs.select(*[c for c in docs.columns if c != "text"], counts.alias("counts"))


def _changed(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """By how much the counts of a bucket's documents change. State: documents, their versions, and their counts, one document's behind another's."""
    held: dict = {}
    if state.exists:
        ids, versions, flat = state.get
        n = len(flat) // len(ids)
        held = {d: (v, list(flat[k * n : (k + 1) * n])) for k, (d, v) in enumerate(zip(ids, versions))}
    rows = [(int(v), [int(x) for x in c], d if known else None) for batch in batches for d, known, v, c in zip(batch["id"].tolist(), batch["known"], batch["version"], batch["counts"])]
    before: dict = {}
    for v, c, d in sorted(rows, key=lambda r: r[:2]):
        if d not in held or v > held[d][0]:
            before.setdefault(d, held[d][1] if d in held else [0] * len(c))
            held[d] = (v, c)
    if before:
        state.update((list(held), [v for v, _ in held.values()], [x for _, c in held.values() for x in c]))
        deltas = [(d, k, n - old[k]) for d, old in before.items() for k, n in enumerate(held[d][1]) if n != old[k]]
        yield pd.DataFrame({"doc_id": pd.array([d[0] for d in deltas], "Int64"), "ord": [d[1] for d in deltas], "delta": [d[2] for d in deltas]})


def changes(docs: DataFrame, keywords: kw.KeywordSet, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """doc_id, ord, delta of a stream of documents (doc_id, version, text).

    The highest version of a document counts, whatever the order in which versions come; a version that was there already, and one that is lower,
    changes nothing, and of two texts with one version the first counts, or within a batch the one with smaller counts. A null text has no
    keywords, which is how a document is taken out. Rows with a null doc_id are versions of one document; a null version is left out.

    Documents are dealt to the tasks of the state before they are counted, so that few large files keep all tasks busy."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
    dealt = docs.where("version is not null").select(bucket.alias("bucket"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNotNull().alias("known"), "version", "text").repartition("bucket")
    state = "ids array<long>, versions array<long>, counts array<int>"
    return document_rows(dealt, keywords, spec).groupBy("bucket").applyInPandasWithState(_changed, CHANGES, state, "append", GroupStateTimeout.NoTimeout)


def start(changed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that has arrived, then stop; changes are appended to the Parquet table at path, each once, also after a restart."""
    return changed.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_counts(deltas: DataFrame, keywords: kw.KeywordSet) -> DataFrame:
    """doc_id, ord, keyword, hits of the documents' last versions, without zeros; deltas: the table of changes."""
    words = F.array(*map(F.lit, keywords.words))
    summed = deltas.groupBy("doc_id", "ord").agg(F.sum("delta").alias("hits")).where("hits <> 0")
    return summed.select("doc_id", "ord", F.get(words, F.col("ord")).alias("keyword"), "hits")


def totals(deltas: DataFrame, keywords: kw.KeywordSet) -> DataFrame:
    """ord, keyword, hits over the last versions of all documents, zeros too."""
    listed = deltas.sparkSession.createDataFrame(list(enumerate(keywords.words)), "ord int, keyword string")
    summed = deltas.groupBy("ord").agg(F.sum("delta").alias("hits"))  # a row for each keyword
    return listed.join(summed, "ord", "left").select("ord", "keyword", F.coalesce("hits", F.lit(0)).alias("hits"))
