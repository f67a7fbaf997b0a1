"""Answers of metadata providers as rows of canonical keys.

Answers are a table: provider, lookup (the key that was asked for, a DOI), status, body. Network access is left to a fetcher that fills it; everything after
is column expressions. JSON is read as it comes (VARIANT), so a year may be a number or a text, a title a text or a list, an author a name, a text or a
list of either; values that aren't there, or of a kind that can't be read, are null.

Nulls: a null body, one that isn't JSON (XML) or not an object, and a status other than 200 give no row. A null lookup is kept. Answers that repeat give a row
each; no answers give none. Other columns are ignored."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import authors, clean_citation, is_number, issued_year, strip_ws
from ..operators.references import reference_text
from ..progress import log
from .articles import fields, root_tag, text_nodes, wrapped

#: The canonical keys.
KEYS = ("DOI", "title", "container-title", "author", "issued", "volume", "issue", "page", "publisher", "abstract", "reference", "language", "affiliation", "keywords", "corresponding-author", "document-type")


def _rows(df: DataFrame, **values) -> DataFrame:
    found = {k.replace("_", "-"): v for k, v in values.items()}
    return df.select("lookup", *[found.get(k, F.lit(None)).cast("string").alias(k) for k in KEYS])


def _parsed(answers: DataFrame) -> DataFrame:
    """Answers whose body is a JSON object, as x."""
    parsed = answers.where("status = 200").withColumn("x", F.try_parse_json("body"))
    return parsed.where(F.startswith(F.schema_of_variant("x"), F.lit("OBJECT")))


def _text(x: Column, path: str) -> Column:
    """A text or number as text; null for a list or an object."""
    kind = F.schema_of_variant(F.try_variant_get(x, path, "variant"))
    return F.when(~kind.rlike("^(ARRAY|OBJECT)"), F.try_variant_get(x, path, "string"))


def _list(x: Column, path: str) -> Column:
    return F.try_variant_get(x, path, "array<variant>")


def _one(x: Column, path: str) -> Column:
    """A text, or the first of a list of them."""
    return F.coalesce(_text(x, path), _text(x, f"{path}[0]"))


def _joined(values: Column) -> Column:
    """Values that aren't null, joined; null if there are none."""
    kept = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, "; "))


def _people(x: Column, path: str) -> Column:
    """Names of a list of persons and texts, or a text as it is."""
    whole = lambda v: F.when(~F.schema_of_variant(v).rlike("^(ARRAY|OBJECT|VOID)"), F.try_variant_get(v, "$", "string"))
    person = lambda v: F.struct(_text(v, "$.family").alias("family"), _text(v, "$.given").alias("given"), F.coalesce(_text(v, "$.literal"), whole(v)).alias("literal"))
    listed = F.transform(_list(x, path), person)
    return F.coalesce(F.when(F.size(listed) > 0, authors(listed)), _text(x, path))


def _year(x: Column, path: str, compat: bool) -> Column:
    """A plain year, number or text; compat: nothing."""
    return issued_year(F.lit(None).cast("array<array<int>>"), _text(x, path), compat)


def citation_list(answers: DataFrame) -> DataFrame:
    """Provider 1: an array of citations."""
    x = F.col("x")
    cited = F.transform(_list(x, "$.citations"), lambda v: F.try_variant_get(v, "$", "string"))
    return _rows(_parsed(answers).where(F.size(cited) > 0), reference=F.array_join(cited, "; "))


def csl(answers: DataFrame, compat: bool = False) -> DataFrame:
    """Provider 2: one CSL record. compat: a plain year is dropped."""
    x = F.col("x")
    record = lambda v: F.struct(_text(v, "$.unstructured").alias("unstructured"), _text(v, "$.DOI").alias("DOI"))
    said = lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), reference_text(record(v))).otherwise(F.try_variant_get(v, "$", "string"))
    refs = F.filter(F.transform(_list(x, "$.reference"), lambda v: clean_citation(said(v))), lambda r: r.isNotNull() & (F.lower(r) != "none"))
    listed = F.coalesce(F.when(F.size(refs) > 0, F.array_join(refs, "; ")), _text(x, "$.reference"))
    issued = F.coalesce(_text(x, "$.issued['date-parts'][0][0]"), issued_year(F.lit(None).cast("array<array<int>>"), _text(x, "$.issued"), compat))
    plain = {k: _text(x, f"$.{k}") for k in ("volume", "issue", "page", "publisher", "abstract", "language")}
    return _rows(_parsed(answers), DOI=strip_ws(_text(x, "$.DOI")), title=_one(x, "$.title"), container_title=_one(x, "$['container-title']"), author=_people(x, "$.author"), issued=issued, reference=listed, **plain)


def crossref(answers: DataFrame) -> DataFrame:
    """Provider 5: a CSL record as the message, for keys that begin with '10.'."""
    message = F.get_json_object("body", "$.message")
    return csl(answers.where(F.startswith("lookup", F.lit("10."))).withColumn("body", message))


def works(answers: DataFrame, compat: bool = False) -> DataFrame:
    """Provider 4: a work. compat: its plain year is dropped."""
    x = F.col("x")
    people = F.transform(_list(x, "$.authorships"), lambda v: _text(v, "$.author.display_name"))
    cited = F.transform(_list(x, "$.referenced_works"), lambda v: F.try_variant_get(v, "$", "string"))
    return _rows(_parsed(answers), DOI=_text(x, "$.doi"), title=_text(x, "$.display_name"), container_title=_text(x, "$.host_venue.display_name"), author=_joined(people), issued=_year(x, "$.publication_year", compat), reference=F.array_join(cited, "; "))


def papers(answers: DataFrame, compat: bool = False) -> DataFrame:
    """Provider 6: a paper; its DOI is the key. compat: its plain year is dropped."""
    x = F.col("x")
    people = F.transform(_list(x, "$.authors"), lambda v: _text(v, "$.name"))
    refs = F.transform(_list(x, "$.reference"), lambda v: F.when(_text(v, "$.doi") != "", _text(v, "$.doi")))
    return _rows(_parsed(answers), DOI=F.col("lookup"), title=_text(x, "$.title"), container_title=_text(x, "$.venue"), author=_joined(people), issued=_year(x, "$.year", compat), abstract=_text(x, "$.abstract"), reference=_joined(refs))


def article_ids(conversions: DataFrame) -> DataFrame:
    """lookup and the id of the first converted record; conversions: lookup, status, body."""
    return conversions.where("status = 200").select("lookup", F.get(F.from_json("body", "struct<records:array<struct<pmcid:string>>>")["records"], F.lit(0))["pmcid"].alias("article_id")).where("article_id is not null and article_id <> ''")


def search_ids(queries: DataFrame, searches: DataFrame) -> DataFrame:
    """query and id: a number is an id already; others get the first id of their search's answer (query, status, body)."""
    found = searches.where("status = 200").select("query", F.get(F.from_json("body", "struct<esearchresult:struct<idlist:array<string>>>")["esearchresult"]["idlist"], F.lit(0)).alias("found")).groupBy("query").agg(F.min("found").alias("found"))
    term = F.trim("query")
    return queries.select("query").distinct().join(found, "query", "left").select("query", F.when(is_number(term), term).otherwise(F.col("found")).alias("id")).where("id is not null")


def articles(answers: DataFrame) -> DataFrame:
    """Provider 3: article XML. What isn't well-formed, and an article without any of the fields, gives no row; what comes more than once is
    joined by '; '."""
    # rows are made by generators, below which the optimizer moves no condition, so that nothing is worked out twice
    read = answers.where("status = 200").select("lookup", F.explode(F.array_compact(F.array(wrapped(F.col("body"))))).alias("xml"))
    read = read.select("lookup", F.explode(F.array(F.struct(root_tag(F.col("xml")).alias("tag"), text_nodes(F.col("xml")).alias("nodes")))).alias("x"))
    found = fields(F.col("x.tag"), F.col("x.nodes"))
    made = F.array(F.struct(*[found.get(k, F.lit(None)).cast("string").alias(k) for k in KEYS]))
    made = F.transform(made, lambda r: F.struct(*[F.when(r[k] != "", r[k]).alias(k) for k in KEYS]))
    return read.select("lookup", F.inline(F.filter(made, lambda r: F.coalesce(*[r[k] for k in found]).isNotNull())))


def articles_by_key(conversions: DataFrame, answers: DataFrame) -> DataFrame:
    """Article fields for each converted key. conversions: lookup, status, body; answers: lookup (an article id), status, body. The
    first converted record counts; a key that converts to nothing, or whose article can't be read, gives no row."""
    ids = article_ids(conversions).groupBy("lookup").agg(F.min("article_id").alias("article_id"))
    return articles(ids.join(answers.select(F.col("lookup").alias("article_id"), "status", "body"), "article_id").select("lookup", "status", "body"))


def records_by_search(queries: DataFrame, searches: DataFrame, answers: DataFrame) -> DataFrame:
    """CSL fields for each query: its own number or its search's first hit is looked up. answers: lookup (an id), status, body."""
    ids = search_ids(queries, searches)
    return csl(ids.join(answers.select(F.col("lookup").alias("id"), "status", "body"), "id").select(F.col("query").alias("lookup"), "status", "body"))


#: What turns the answers of each provider, in order of priority, into rows of canonical keys.
PARSERS = {"NIH-OCC": citation_list, "PubMed": csl, "PMC": articles, "OpenAlex": works, "Crossref": crossref, "Semantic Scholar": papers}


def offers(answers: DataFrame) -> DataFrame:
    """prio (from 1), lookup and canonical keys of all providers' answers."""
    parts = [parse(answers.where(F.col("provider") == name)).withColumn("prio", F.lit(k)) for k, (name, parse) in enumerate(PARSERS.items(), 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Gets (status, body) for a provider and a key.
Fetcher = Callable[[str, str], tuple[int, str]]


def fetch(keys: DataFrame, fetcher: Fetcher, attempts: int = 4, pause: float = 30.0) -> DataFrame:
    """Answers for distinct (provider, lookup) rows. A key whose attempts all fail gets status 0 and no body."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for provider, key in zip(batch["provider"], batch["lookup"]):
                answer: tuple[int, str | None] = (0, None)
                for k in range(attempts):
                    try:
                        answer = fetcher(provider, key)
                        break
                    except Exception as e:
                        log.warning("%s, %s: attempt %d of %d failed: %s", provider, key, k + 1, attempts, e)
                        time.sleep(pause if k + 1 < attempts else 0)
                rows.append((provider, key, *answer))
            yield pd.DataFrame(rows, columns=["provider", "lookup", "status", "body"])

    return keys.select("provider", "lookup").distinct().mapInPandas(ask, "provider string, lookup string, status int, body string")
