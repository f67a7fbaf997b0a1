"""Keywords in context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse_phrase, context_slice, half_window, hit_count, keyword_class, keyword_tokens, tokens_dash_blank, tokens_ws
from ..storage import written
from . import keywords as kw
from .keywords import KeywordSet


def hit_pages(pages: DataFrame, keyword: str, regex: bool = True) -> DataFrame:
    """Pages on which the keyword counts at least once; only these are cut into tokens."""
    return pages.where(hit_count(F.col("text"), keyword, regex) > 0)


def contexts(pages: DataFrame, keywords: KeywordSet, length: int = 30, compat: bool = False) -> DataFrame:
    """keyword, doc_id, page, pos (of the token, from 0) and context, for every token equal to a keyword on pages with a hit.

    Contexts are cut inside each page's row; only pages that may have a hit of any keyword are read further. For long lists, see
    `listed_contexts`."""
    keywords.validate(pages)
    if len(keywords.words) > kw.INLINE_WORDS:
        return listed_contexts(pages, keywords, length, compat)
    pattern = keywords.prefilter()
    pages = pages.where(F.col("text").rlike(pattern)) if pattern else pages
    # tokens of each kind are a column, made once a page and only where a keyword of the kind has a hit
    kinds: dict[str, list[str]] = {}
    for word in keywords.words:
        kind = keyword_class(word)
        kinds.setdefault(word if kind == "phrase" else kind, []).append(word)
    hit = {word: hit_count(F.col("text"), word, keywords.regex) > 0 for word in keywords.words}
    columns = {words[0]: F.when(reduce(Column.__or__, [hit[w] for w in words]), keyword_tokens(F.col("text"), words[0])) for words in kinds.values()}
    flags = [F.array(*[hit[w] for w in keywords.words]).alias("hit")]
    rows = pages.select("doc_id", "page", *flags, *[c.alias(f"t{k}") for k, c in enumerate(columns.values())])
    half = half_window(length)
    at = {w: f"t{k}" for k, words in enumerate(kinds.values()) for w in words}
    found = [F.when(F.col("hit")[k], _contexts_of(w, F.col(at[w]), half, compat)) for k, w in enumerate(keywords.words)]
    made = rows.select("doc_id", "page", F.inline(F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull()))))
    return made.select("keyword", "doc_id", "page", "pos", "context")


def listed_contexts(pages: DataFrame, keywords: KeywordSet, length: int = 30, compat: bool = False) -> DataFrame:
    """The same as `contexts` for lists of any length: what a page has of the list is found as by `keywords.listed_hits`, and its contexts are cut in
    its row, to which the few keywords that it has are joined once. A null text has none; no pages give no rows."""
    numbered = written(pages.select("doc_id", "page", "text").withColumn("number", F.monotonically_increasing_id()), "pages")
    had = kw.listed_hits(numbered, keywords, ("number",)).groupBy("number").agg(F.array_sort(F.collect_list("keyword")).alias("had"))
    rows = numbered.join(had, "number").select("doc_id", "page", "had", tokens_dash_blank(F.col("text")).alias("t"), tokens_ws(F.col("text")).alias("w"))
    half = half_window(length)

    def each(word: Column) -> Column:
        tokens = F.when(F.contains(word, F.lit("-")), F.col("w")).when(F.contains(word, F.lit(" ")), collapse_phrase(F.col("t"), word)).otherwise(F.col("t"))
        return _contexts_of(word, tokens, half, compat)

    return rows.select("doc_id", "page", F.inline(F.flatten(F.transform("had", each)))).select("keyword", "doc_id", "page", "pos", "context")


def _contexts_of(word: Column | str, tokens: Column, half: int, compat: bool) -> Column:
    """(keyword, pos, context) of each token equal to the word."""
    word = F.lit(word) if isinstance(word, str) else word
    places = F.filter(F.transform(tokens, lambda x, i: F.when(x == word, i)), lambda i: i.isNotNull())
    return F.transform(places, lambda i: F.struct(word.alias("keyword"), i.alias("pos"), context_slice(tokens, i, half, compat).alias("context")))


def contexts_by_frame(pages: DataFrame, keyword: str, length: int = 30) -> DataFrame:
    """The same for one keyword, with a row frame over exploded tokens."""
    half = half_window(length)
    rows = hit_pages(pages, keyword).select("doc_id", "page", F.posexplode(keyword_tokens(F.col("text"), keyword)).alias("pos", "w"))
    frame = Window.partitionBy("doc_id", "page").orderBy("pos").rowsBetween(-half, half - 1)
    return rows.withColumn("context", F.array_join(F.collect_list("w").over(frame), " ")).where(F.col("w") == keyword).select(F.lit(keyword).alias("keyword"), "doc_id", "page", "pos", "context")
