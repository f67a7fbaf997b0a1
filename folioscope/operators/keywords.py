"""Keyword counts over pages: per page, document and corpus, as long, wide and chart tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.text import FilterSpec, hit_count, percent_label
from ..sources.corpus import normal_keywords
from ..storage import written


@dataclass(frozen=True)
class KeywordSet:
    """Keywords in input order, in lower case, each once. Regular expressions unless `regex` is False."""

    words: tuple[str, ...]
    regex: bool = True

    @classmethod
    def of(cls, lines: list[str], regex: bool = True) -> KeywordSet:
        words = normal_keywords(lines)
        if not words:
            raise ValueError("no keywords")
        return cls(tuple(words), regex)

    def validate(self, pages: DataFrame) -> None:
        """Raise ValueError for a keyword that isn't a regular expression, before any job runs."""
        if self.regex:
            compile_ = pages.sparkSession._jvm.java.util.regex.Pattern.compile
            for w in self.words:
                try:
                    compile_(w)
                except Exception as e:
                    raise ValueError(f"keyword {w!r} is not a regular expression") from e

    def prefilter(self) -> str | None:
        """A pattern that every page with a hit matches; None where one can't be told (back-references)."""
        if any(re.search(r"\\[1-9k]|\(\?", w) for w in self.words) and self.regex:
            return None
        return "\\s(?:" + "|".join(f"(?:{w})" if self.regex else re.escape(w) for w in self.words) + ")\\s"


def clean_pages(pages: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    return pages.select("doc_id", "page", spec.clean(F.col("text")).alias("text"))


#: Keyword lists up to this length become one expression each, in the page's row; up to the other, they are broadcast.
INLINE_WORDS, BROADCAST_WORDS = 256, 1_000_000
#: Rows of hits that a task gathers before it puts them out.
OUTPUT_ROWS = 50_000
_SPACE = "[ \\t\\n\\x0B\\f\\r]"
#: What makes a keyword more than its own characters.
_META = re.compile(r"[\\^$.|?*+()\[\]{}]")


def page_hits(pages: DataFrame, keywords: KeywordSet, keep_text: bool = False) -> DataFrame:
    """doc_id, page, ord, keyword, hits (all keywords for every page, zeros too). pages: cleaned.

    Counts are made in the page's row, each with a constant pattern that is compiled once, and only they are exploded: no join, no
    shuffle, and no copies of the text. Of longer lists, see `listed_hits`; its counts are set among zeros in the page's row."""
    keywords.validate(pages)
    others = ["doc_id", "page", *["text"] * keep_text]
    if len(keywords.words) <= INLINE_WORDS:
        counted = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(w).alias("keyword"), hit_count(F.col("text"), w, keywords.regex).alias("hits")) for k, w in enumerate(keywords.words)])
        return pages.select(*others, F.inline(counted))
    numbered = written(pages.withColumn("number", F.monotonically_increasing_id()), "pages")
    found = listed_hits(numbered, keywords, ("number",)).groupBy("number").agg(F.map_from_entries(F.collect_list(F.struct("ord", "hits"))).alias("found"))
    counted = F.transform(_listed(enumerate(keywords.words)), lambda x: F.struct(x["ord"].alias("ord"), x["keyword"].alias("keyword"), F.coalesce(F.col("found")[x["ord"]], F.lit(0)).alias("hits")))
    return numbered.join(found, "number", "left").select(*others, F.inline(counted))


def _listed(words: Iterable[tuple[int, str]]) -> Column:
    """ord and keyword of each word, as one literal, however many there are."""
    return F.from_json(F.lit(json.dumps([{"ord": k, "keyword": w} for k, w in words])), "array<struct<ord:int,keyword:string>>")


def listed_hits(pages: DataFrame, keywords: KeywordSet, by: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """The columns `by`, ord, keyword, hits of the keywords that a page has, without zeros, for lists of any length. pages: cleaned; rows
    equal in `by` are one page each only if `by` tells them apart.

    Literal keywords are looked up instead of searched: the page's runs of as many tokens as keywords have are looked up in the list, which is
    broadcast up to a checked number of words, and nothing is shuffled; beyond it runs are joined with the list, and matches are shuffled. Regular expressions are counted in the page's
    row. A match uses up the white space around it, as in `hit_count`, so of overlapping ones the first counts. A null text has no hits; no
    pages give no rows."""
    keywords.validate(pages)
    literal = [(k, w) for k, w in enumerate(keywords.words) if not (keywords.regex and _META.search(w))]
    patterns = [(k, w) for k, w in enumerate(keywords.words) if keywords.regex and _META.search(w)]
    parts = []
    if literal:
        parts.append(_literal_hits(pages, literal, by))
    if patterns:
        counted = F.transform(_listed(patterns), lambda x: F.struct(x["ord"].alias("ord"), x["keyword"].alias("keyword"), hit_count(F.col("text"), x["keyword"]).alias("hits")))
        parts.append(pages.select(*by, F.inline(F.filter(counted, lambda x: x["hits"] > 0))))
    return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])


def _counted(words: dict[str, int], sizes: list[int], text: str) -> dict[int, int]:
    """Hits of each word in a page: the runs of as many tokens as words have are looked up."""
    parts = re.split(f"({_SPACE})", text)
    tokens, between = parts[::2], parts[1::2]
    found: dict[int, int] = {}
    for n in sizes:
        free: dict[int, int] = {}  # where a word may be matched again
        inner = tokens[1:-n] if n == 1 else map("".join, zip(*[x for j in range(n) for x in ([between[j:]] if j else []) + [tokens[1 + j : len(tokens) - n + j]]])) if len(tokens) > n + 1 else ()
        for at, word in enumerate(inner):
            k = words.get(word)
            if k is not None and free.get(k, 0) <= at:
                free[k] = at + n + 1
                found[k] = found.get(k, 0) + 1
    return found


def _literal_hits(pages: DataFrame, words: list[tuple[int, str]], by: tuple[str, ...]) -> DataFrame:
    """Up to a checked number of words are sent to the tasks, which look them up page by page, so that nothing is shuffled."""
    if len(words) > BROADCAST_WORDS:
        return _joined_hits(pages, words, by)
    sizes = sorted({len(re.split(_SPACE, w)) for _, w in words})
    listed = pages.sparkSession.sparkContext.broadcast({w: k for k, w in words})
    rows = pages.select(*by, "text").where("text is not null")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(listed.value.keys(), pa.string())
        at = dict(zip(listed.value, range(len(names))))
        ords = pa.array(listed.value.values(), pa.int32())
        for batch in batches:
            texts, first = batch.column(len(by)), 0
            while first < len(texts):  # a part of a batch at a time, as pages of many words have many rows
                row, word, hits = [], [], []
                while first < len(texts) and len(row) < OUTPUT_ROWS:
                    found = _counted(at, sizes, texts[first].as_py())
                    row += [first] * len(found)
                    word += found.keys()
                    hits += found.values()
                    first += 1
                row, word = pa.array(row, pa.int64()), pa.array(word, pa.int64())
                columns = [c.take(row) for c in batch.columns[: len(by)]] + [ords.take(word), names.take(word), pa.array(hits, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [*by, "ord", "keyword", "hits"])

    fields = [rows.schema[c] for c in by]
    return rows.mapInArrow(look_up, StructType([*fields, StructField("ord", IntegerType()), StructField("keyword", StringType()), StructField("hits", IntegerType())]))


def _joined_hits(pages: DataFrame, words: list[tuple[int, str]], by: tuple[str, ...]) -> DataFrame:
    """The same for longer lists: runs of tokens are joined with the list, and matches are shuffled."""
    sizes = {w: len(re.split("[ \t\n\x0b\f\r]", w)) for _, w in words}
    listed = pages.sparkSession.createDataFrame([(k, w, sizes[w]) for k, w in words], "ord int, keyword string, size int")
    # the tokens between single white space characters, and those characters; a run counts if it has one on either side
    cut = pages.select(*by, F.monotonically_increasing_id().alias("row"), F.split("text", _SPACE).alias("t"), F.regexp_extract_all("text", F.lit(_SPACE), F.lit(0)).alias("s"))

    def run(n: int):
        def text(i):
            return F.concat(*[x for j in range(n) for x in ([F.get("s", i + j - 1)] if j else []) + [F.get("t", i + j)]])

        places = F.when(F.size("t") >= n + 2, F.sequence(F.lit(1), F.size("t") - n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.lit(n).alias("size"), i.alias("at"), text(i).alias("keyword")))

    runs = F.flatten(F.array(*[run(n) for n in sorted(set(sizes.values()))]))
    matched = cut.where("t is not null").select(*by, "row", F.inline(runs)).join(listed, ["size", "keyword"])
    step = lambda acc, at: F.when(at >= acc["next"], F.struct((acc["n"] + 1).alias("n"), (at + F.col("size") + 1).alias("next"))).otherwise(acc)
    places = matched.groupBy(*by, "row", "ord", "keyword", "size").agg(F.array_sort(F.collect_list("at")).alias("places"))
    hits = F.aggregate("places", F.struct(F.lit(0).alias("n"), F.lit(0).alias("next")), step, lambda acc: acc["n"])
    return places.select(*by, "ord", "keyword", hits.alias("hits"))


def document_counts(hits: DataFrame) -> DataFrame:
    """doc_id, ord, keyword, hits: a row for each document and keyword, zeros included."""
    return hits.groupBy("doc_id", "ord", "keyword").agg(F.sum("hits").alias("hits"))


def overview(hits: DataFrame, keywords: KeywordSet) -> DataFrame:
    """A row for each document, a column for each keyword in input order; that of the keyword `doc_id` is named `doc_id.1`. A document whose
    pages are all empty has zeros."""
    counts = hits.groupBy("doc_id").pivot("keyword", list(keywords.words)).agg(F.sum("hits"))
    counts = counts.toDF("doc_id", *[f"c{k}" for k in range(len(keywords.words))]).na.fill(0, [f"c{k}" for k in range(len(keywords.words))])
    return counts.toDF("doc_id", *["doc_id.1" if w == "doc_id" else w for w in keywords.words])


def totals(hits: DataFrame) -> DataFrame:
    return hits.groupBy("ord", "keyword").agg(F.sum("hits").alias("hits"))


def rollup(hits: DataFrame) -> DataFrame:
    """Both levels at once: counts per document (level 0) and over the corpus (level 1, doc_id null)."""
    return hits.groupingSets([["doc_id", "keyword"], ["keyword"]], "doc_id", "keyword").agg(F.sum("hits").alias("hits"), F.grouping("doc_id").cast("int").alias("level"))


def _series(counts: DataFrame, by: list[str]) -> DataFrame:
    rows = counts.where("hits > 0")
    ordered, whole = Window.partitionBy(*by).orderBy("hits", "keyword"), Window.partitionBy(*by)
    total = F.sum("hits").over(whole)
    return rows.select(*by, "keyword", "hits", (F.col("hits") * F.lit(100.0) / total).alias("pct"), percent_label(F.col("hits"), total).alias("label"), (F.row_number().over(ordered) - 1).cast("long").alias("rank"))


def chart_by_document(counts: DataFrame) -> DataFrame:
    """Series of each document, without zeros, by count and keyword: share, label and bar position."""
    return _series(counts, ["doc_id"])


def chart_total(total: DataFrame) -> DataFrame:
    """The corpus's series; its rows are as many as the keywords."""
    return _series(total.withColumn("corpus", F.lit("all")), ["corpus"]).drop("corpus")


def running_totals(counts: DataFrame) -> DataFrame:
    """Each keyword's count up to each document, by doc_id.

    Ranges of doc_id are summed each by itself and shifted by the sums of the ranges before, so no task holds all of a keyword."""
    ranged = written(counts.repartitionByRange("doc_id").select("doc_id", "keyword", "hits", F.spark_partition_id().alias("range")), "counts")
    within = Window.partitionBy("keyword", "range").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("keyword").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("keyword", "range").agg(F.sum("hits").alias("n"))  # a row for each keyword and range
    before = sums.select("keyword", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return ranged.select("doc_id", "keyword", "range", F.sum("hits").over(within).alias("own")).join(before, ["keyword", "range"]).select("doc_id", "keyword", (F.col("own") + F.col("before")).alias("running"))
