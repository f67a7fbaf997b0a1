"""Corpora as tables of pages, and keyword lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import file_text, written



@dataclass(frozen=True)
class Separated:
    """Text files whose pages end with a separator: they need no file whole, so they may be of any size."""

    separator: str = "\f"


#: Turns the bytes of a file into its page texts, or says how text files are cut.
Extractor = Callable[[bytes], Iterable[str]] | Separated
#: Characters of page texts that leave Python at a time.
PAGES_CHARS = 4_000_000
#: Rows of the table of blocks that are broadcast.
BROADCAST_BLOCKS = 1_000_000


class ExtractorUnavailable(RuntimeError):
    """No library that reads this kind of file is installed."""


def pdf_extractor(content: bytes) -> list[str]:
    """Page texts of a PDF by pypdf, if that is installed."""
    try:
        import io

        from pypdf import PdfReader
    except ImportError as e:
        raise ExtractorUnavailable("reading PDF files needs pypdf; pass an extractor of your own") from e
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def files(spark: SparkSession, path: str, suffix: str = ".pdf", recursive: bool = False) -> DataFrame:
    """path, length and content of files with the suffix (case counts); a missing folder is an error."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "length", "content")


def file_pages(spark: SparkSession, path: str, extractor: Extractor = pdf_extractor, suffix: str = ".pdf", skip_unreadable: bool = False, folder: bool = False) -> DataFrame:
    """doc_id (the file's name, or its folder's), page (from 1) and text. An unreadable file ends the job, unless it is to be skipped.

    Files of pages with a separator are read in blocks by Spark, as `paged_files` does, whose text is never unreadable. Other extractors get a file
    whole, one at a time, and its pages leave Python in batches of bounded size: a task holds its largest file and what the extractor makes of it.
    Extractors that give their pages one by one need no list of them; of a file that is to be skipped the list is made first."""
    if isinstance(extractor, Separated):
        return paged_files(spark, path, separator=extractor.separator, folder=folder, suffix=suffix)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(name: str, first: int, texts: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(texts), pa.string()), pa.array(range(first, first + len(texts)), pa.int32()), pa.array(texts, pa.string())], ["doc_id", "page", "text"])

        for batch in batches:
            for name, content in zip(batch.column("doc_id"), batch.column("content")):
                found = extractor(content.as_py()) if not skip_unreadable else _read(extractor, content.as_py())
                first, held, texts = 1, 0, []
                for text in found:
                    texts.append(text)
                    held += len(text)
                    if held >= PAGES_CHARS:
                        yield put(name.as_py(), first, texts)
                        first, held, texts = first + len(texts), 0, []
                if texts:
                    yield put(name.as_py(), first, texts)

    found = files(spark, path, suffix)
    return found.select(F.element_at(F.split("path", "/"), -2 if folder else -1).alias("doc_id"), "content").mapInArrow(extract, "doc_id string, page int, text string")


def _read(extractor: Callable[[bytes], Iterable[str]], content: bytes) -> list[str]:
    """A file's pages, none if it can't be read."""
    try:
        return list(extractor(content))
    except ExtractorUnavailable:
        raise
    except Exception:
        return []


def page_texts(text: Column, lines: int = 3) -> Column:
    """The texts of a text's blocks of lines, as an array; a null text is one empty block."""

    def cut(parts: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / lines).cast("int"))
        return F.transform(numbers, lambda p: F.array_join(F.slice(parts, p * lines + 1, lines), "\n"))

    # lines in an array of their own, so that a text is split once, not once a page
    return F.get(F.transform(F.array(F.split(F.coalesce(text, F.lit("")), "\n")), cut), F.lit(0))


def text_pages(docs: DataFrame, lines: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, page (from 1) and text of blocks of lines. Pages are cut inside each row, without a shuffle. A null text is one empty page, as
    an empty one is."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(page_texts(F.col(text_col), lines)).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("page"), "text")


def separated_pages(docs: DataFrame, separator: str = "\f", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pages of texts that have a separator (a form feed) between pages. A null text is one empty page."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), separator)).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("page"), "text")


def paged_files(spark: SparkSession, path: str, pages: tuple[int, int] | None = None, separator: str = "\f", folder: bool = False, suffix: str = "") -> DataFrame:
    """doc_id (the file's name, or its folder's), page (from 1) and text of text files whose pages end with a separator, a form feed.

    Large files are read by several tasks, a block each; a page's number is its place in its block and the pages of the blocks before, of which
    there is a row each, broadcast up to a checked number, so the texts aren't shuffled. They are written once, since how files are dealt to tasks
    may change with the executors between two readings. pages: the first and the last page wanted; what isn't is left out where it is read
    again. A last page that isn't ended counts, an empty one behind the last separator doesn't; a file without any byte has no pages."""
    rows = spark.read.option("lineSep", separator).option("pathGlobFilter", f"*{suffix}").text(path)
    named = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("text"))
    placed = written(named, "paged")
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counted = placed.groupBy("file", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    blocks = written(counted.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"), "n"), "blocks")
    if pages:
        blocks = blocks.where((F.col("before") < pages[1]) & (F.col("before") + F.col("n") >= pages[0]))
    page = (F.col("before") + F.col("row") - F.col("first") + 1).cast("int")
    small = F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks
    found = placed.join(small, ["file", "block"]).select(F.element_at(F.split("file", "/"), -2 if folder else -1).alias("doc_id"), page.alias("page"), "text")
    return found.where(F.col("page").between(*pages)) if pages else found


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"))


def keyword_lines(path: str | None = None, manual: str = "") -> list[str]:
    """A file's lines if a path is given (of any storage that Spark reads), else the lines of the manual text. Lines end with \\n, \\r\\n or \\r."""
    return re.split("\r\n|\r|\n", file_text(path) if path else manual)


def normal_keywords(lines: list[str]) -> list[str]:
    """In lower case, without line ends, each once in first order; blank ones are left out."""
    found = list(dict.fromkeys(x.rstrip("\r\n").lower() for x in lines))
    return [x for x in found if x.strip()]


def keyword_table(lines: DataFrame, ord_col: str = "ord", keyword_col: str = "keyword") -> DataFrame:
    """The same for a table of lines: ord (the first position) and keyword."""
    rows = lines.select(F.col(ord_col).alias("ord"), F.lower(F.rtrim(F.col(keyword_col), F.lit("\r\n"))).alias("keyword")).where(F.trim("keyword") != "")
    return rows.groupBy("keyword").agg(F.min("ord").alias("ord"))
