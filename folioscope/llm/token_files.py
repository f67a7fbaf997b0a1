"""Token counts by a separator scan over flat token files.

A token file is a bare run of 16-bit little-endian ids; each document ends with the end-of-document id and nothing tells
where documents begin. Files are written through Spark's text sink: one row a document, its ids as the bytes of the line,
the end id's two bytes as the line separator. The scan cuts each file into blocks, searches each block for the end id
with one vectorised comparison, and stitches documents that span blocks by a prefix scan of the blocks' last separators.

Texts are encoded without special tokens: the end id's own string inside a text is ordinary text and counts with the ids that it has as
such. So each end id in a file is a separator.

Nulls: a null text is a document of no tokens; a null doc_id stays null. Equal or repeated rows are counted once each. A very long text
is one line of its file; files have a bounded number of rows, so that each has about FILE_BYTES / 2 bytes. An empty table gives no rows.
Only the id and text columns are read. The ids of documents are found again by partition and row: `docs` that isn't a plain scan of files
is written first, and where the numbers of rows differ an error is raised.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import encoder, fresh_path, table, written

END, BLOCK = 50_256, 1 << 19  # ids a block
#: Bytes of texts that go to one token file (about half as many of ids): as many rows as have so many on average.
FILE_BYTES = 256_000_000


def _encode(vocabulary: str | None, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(0)
            for lo in range(0, len(texts), 1024):
                lines = []
                for t in texts.slice(lo, 1024).to_pylist():
                    ids = np.array(bpe.ordinary(t) if t else [], np.uint32)
                    if len(ids) and (ids.max() > 0xFFFF or (ids == end).any()):
                        raise ValueError("ids over 16 bits, or the end id inside a text")
                    lines.append(ids.astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["line"])

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END, text_col: str = "text", rows: int = 0) -> None:
    """Flat files for each partition of docs that has rows, its documents in order; `rows` of them in a file if that is given."""
    separator = int(end).to_bytes(2, "little").decode("latin-1")
    lines = docs.select(F.col(text_col).alias("text")).mapInArrow(_encode(vocabulary, end), "line binary")
    lines.select(F.col("line").cast("string").alias("value")).write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", rows).text(path)


def _scan(end: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                ids = np.frombuffer(content.as_buffer(), "<u2")
                rows = []
                for k, lo in enumerate(range(0, max(len(ids), 1), block)):
                    ends = np.flatnonzero(ids[lo : lo + block] == end) + lo
                    rows.append((path, k, min(lo + block, len(ids)), ends))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                    ["path", "block", "upto", "ends"],
                )

    return run


def scan_token_files(spark: SparkSession, path: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """path, ordinal (of the document in its file, from 0), start (its first id's place), n_tokens (without the end id).

    Ids after a file's last separator are a document that was cut off; it is returned like the others, with `open` true.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    blocks = files.mapInArrow(_scan(end, block), "path string, block long, upto long, ends array<long>")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    n, last = F.size("ends"), F.when(F.size("ends") > 0, F.element_at("ends", -1))
    blocks = blocks.withColumns({"carry": F.coalesce(F.max(last).over(before), F.lit(-1)), "first": F.coalesce(F.sum(n).over(before), F.lit(0)), "total": F.max("upto").over(whole)})
    starts = F.concat(F.array("carry"), F.col("ends"))
    found = blocks.where(n > 0).select("path", "first", F.explode(F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("k"), F.slice(starts, 1, n).alias("a"), F.col("ends").alias("b"))).alias("x"))
    found = found.select("path", (F.col("first") + F.col("x.k")).alias("ordinal"), (F.col("x.a") + 1).alias("start"), (F.col("x.b") - F.col("x.a") - 1).alias("n_tokens"), F.lit(False).alias("open"))
    final = blocks.withColumn("end_at", F.coalesce(last, F.col("carry"))).where((F.col("upto") == F.col("total")) & (F.col("end_at") + 1 < F.col("total")))
    left = final.select("path", (F.col("first") + n).alias("ordinal"), (F.col("end_at") + 1).alias("start"), (F.col("total") - F.col("end_at") - 1).alias("n_tokens"), F.lit(True).alias("open"))
    return found.unionAll(left)


def plain_scan(docs: DataFrame) -> bool:
    """Whether docs yields the rows of files, each time in the same partitions and order."""
    nodes = [re.match(r"[ :+|-]*(\w+)", line) for line in docs._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    return all(m and m[1] in ("Project", "Filter", "Relation") for m in nodes)


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, file_bytes: int = FILE_BYTES) -> DataFrame:
    """doc_id, n_tokens, file (number of the partition's token file), part (of that file), ordinal and start in it, for every row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs if plain_scan(docs) else written(docs, "documents")
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    rows = max(1, file_bytes * n // size) if size else 0
    path = fresh_path(spark, "tokens")
    write_token_files(docs, path, vocabulary, rows=rows)
    number = lambda pattern: F.regexp_extract("path", pattern, 1).cast("long")
    found = scan_token_files(spark, path, block=block).select(number(r"part-(\d+)-").alias("file"), number(r"-c(\d+)\.[^/]*$").alias("part"), "ordinal", "start", "n_tokens")
    row = F.monotonically_increasing_id()
    place = row.bitwiseAND((1 << 33) - 1)
    each = F.lit(rows or 1 << 33).cast("long")
    named = docs.select("doc_id", F.shiftright(row, 33).alias("file"), F.floor(place / each).alias("part"), (place % each).alias("ordinal"))
    sound = F.when(F.col("n_tokens").isNull() | F.col("has").isNull(), F.raise_error(F.lit("token files and documents differ"))).otherwise(F.col("n_tokens"))
    return named.withColumn("has", F.lit(1)).join(found, ["file", "part", "ordinal"], "full_outer").select("doc_id", sound.cast("long").alias("n_tokens"), "file", "part", "ordinal", "start")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
