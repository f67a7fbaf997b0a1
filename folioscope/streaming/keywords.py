"""Keyword counts of a growing corpus: the batch expressions over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import FilterSpec
from ..operators import keywords as kw
from ..sources.corpus import text_pages


def stream_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", kind: str = "parquet", files_a_batch: int = 1_000) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_a_batch).load(path)


def running_totals(docs: DataFrame, keywords: kw.KeywordSet, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Corpus counts so far; the state is a row for each keyword."""
    hits = kw.page_hits(kw.clean_pages(text_pages(docs), spec), keywords)
    return kw.totals(hits)


def start(totals: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """All that has arrived, then stop; counts are kept in a table in memory."""
    writer = totals.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
