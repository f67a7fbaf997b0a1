"""The registered queries over the fixture tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as fn
from ..functions.languages import catalogue, catalogue_table
from ..functions.text import FilterSpec
from ..operators import enrich as en
from ..operators import keywords as kw
from ..operators import kwic, ocr, records, references
from ..sources import corpus

KEYWORDS = ("the", "of", "de", "that", "on the", "by-nc", "error")
#: The sample list of characters that the character filter deletes.
FILTER_CHARS = "!@#$%^&*()_-+=[{]}\\|;:'\",<.>/?`~®"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.text_pages(_table(spark, sf_dir, "documents"))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kw.clean_pages(_pages(spark, sf_dir))


def _keywords() -> kw.KeywordSet:
    return kw.KeywordSet.of(list(KEYWORDS))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kw.page_hits(_clean(spark, sf_dir), _keywords())


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- common table expressions --------------------------------------------------------------------------------------

_PAGES = "lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), numbered AS (SELECT doc_id, l, unnest(range((len(l) + 2) // 3)) AS p FROM lines), pages AS (SELECT doc_id, p + 1 AS page, array_to_string(l[p * 3 + 1 : p * 3 + 3], chr(10)) AS text FROM numbered)"
_WORDS = "keywords(ord, keyword) AS (VALUES " + ", ".join(f"({k}, {_quoted(w)})" for k, w in enumerate(KEYWORDS)) + ")"
_HITS = f"{_PAGES}, {_WORDS}, hits AS (SELECT doc_id, page, ord, keyword, len(regexp_extract_all(lower(text), '\\s' || keyword || '\\s')) AS hits FROM pages, keywords)"
_COUNTS = f"{_HITS}, counts AS (SELECT doc_id, ord, keyword, CAST(sum(hits) AS BIGINT) AS hits FROM hits GROUP BY ALL)"
_LABEL = "concat(CAST(({h} * 20000 + {t}) // (2 * {t}) // 100 AS VARCHAR), '.', lpad(CAST(({h} * 20000 + {t}) // (2 * {t}) % 100 AS VARCHAR), 2, '0'), '% (', CAST({h} AS VARCHAR), ')')"


def _series_sql(source: str, part: str) -> str:
    total = f"CAST(sum(hits) OVER ({part}) AS BIGINT)"
    by = "doc_id, " if part else ""
    order = f"{part} ORDER BY hits, keyword" if part else "ORDER BY hits, keyword"
    return f"SELECT {by}keyword, hits, hits * 100e0 / {total} AS pct, {_LABEL.format(h='hits', t=total)} AS label, row_number() OVER ({order}) - 1 AS rank FROM {source} WHERE hits > 0"


# --- corpus --------------------------------------------------------------------------------------------------------


@query("page_split", f"WITH {_PAGES} SELECT doc_id, CAST(page AS INTEGER) AS page, text FROM pages")
def page_split(spark, sf_dir):
    return _pages(spark, sf_dir)


@query("page_count", f"WITH {_PAGES} SELECT doc_id, count(*) AS pages FROM pages GROUP BY doc_id")
def page_count(spark, sf_dir):
    return corpus.page_counts(_pages(spark, sf_dir))


def _filtered(spec: FilterSpec):
    return lambda spark, sf_dir: _table(spark, sf_dir, "documents").select("doc_id", spec.clean(F.col("text")).alias("clean"))


query("filter_basic", "SELECT doc_id, lower(regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g')) AS clean FROM documents")(_filtered(FilterSpec.resolve(basic=True)))
query("filter_charset", f"SELECT doc_id, lower(translate(text, {_quoted(FILTER_CHARS)}, '')) AS clean FROM documents")(_filtered(FilterSpec.resolve(manual=FILTER_CHARS)))
query("filter_none", "SELECT doc_id, lower(text) AS clean FROM documents")(_filtered(FilterSpec.resolve()))

@query("keyword_normalise", "SELECT lower(source) AS keyword, min(doc_id) AS ord FROM documents WHERE trim(source) <> '' GROUP BY lower(source)")
def keyword_normalise(spark, sf_dir):
    """A line for each document, in capitals, with the line end of another system."""
    return corpus.keyword_table(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.upper("source"), F.lit("\r\n")).alias("keyword")))


# --- keyword counts ------------------------------------------------------------------------------------------------


@query("keyword_page_hits", f"WITH {_HITS} SELECT doc_id, CAST(page AS INTEGER) AS page, keyword, CAST(hits AS INTEGER) AS hits FROM hits WHERE hits > 0")
def keyword_page_hits(spark, sf_dir):
    return _hits(spark, sf_dir).where("hits > 0").select("doc_id", "page", "keyword", "hits")


@query("keyword_document_counts", f"WITH {_COUNTS} SELECT doc_id, keyword, hits FROM counts")
def keyword_document_counts(spark, sf_dir):
    return kw.document_counts(_hits(spark, sf_dir)).select("doc_id", "keyword", "hits")


@query("keyword_overview", f"WITH {_COUNTS} SELECT doc_id, " + ", ".join(f"CAST(sum(hits) FILTER (WHERE keyword = {_quoted(w)}) AS BIGINT) AS \"{w}\"" for w in KEYWORDS) + " FROM counts GROUP BY doc_id")
def keyword_overview(spark, sf_dir):
    return kw.overview(_hits(spark, sf_dir), _keywords())


@query("keyword_totals", f"WITH {_COUNTS} SELECT ord, keyword, CAST(sum(hits) AS BIGINT) AS hits FROM counts GROUP BY ord, keyword")
def keyword_totals(spark, sf_dir):
    return kw.totals(_hits(spark, sf_dir))


@query("keyword_rollup", f"WITH {_HITS} SELECT coalesce(doc_id, -1) AS doc_id, keyword, CAST(sum(hits) AS BIGINT) AS hits, CAST(grouping(doc_id) AS INTEGER) AS level FROM hits GROUP BY GROUPING SETS ((doc_id, keyword), (keyword))")
def keyword_rollup(spark, sf_dir):
    return kw.rollup(_hits(spark, sf_dir)).na.fill(-1, ["doc_id"])  # -1: the corpus


@query("chart_doc", f"WITH {_COUNTS} " + _series_sql("counts", "PARTITION BY doc_id"))
def chart_doc(spark, sf_dir):
    return kw.chart_by_document(kw.document_counts(_hits(spark, sf_dir)))


@query("chart_total", f"WITH {_COUNTS}, totals AS (SELECT keyword, CAST(sum(hits) AS BIGINT) AS hits FROM counts GROUP BY keyword) " + _series_sql("totals", ""))
def chart_total(spark, sf_dir):
    return kw.chart_total(kw.totals(_hits(spark, sf_dir)))


@query("corpus_running_total", f"WITH {_COUNTS} SELECT doc_id, keyword, CAST(sum(hits) OVER (PARTITION BY keyword ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM counts")
def corpus_running_total(spark, sf_dir):
    return kw.running_totals(kw.document_counts(_hits(spark, sf_dir)))


# --- keywords in context -------------------------------------------------------------------------------------------


def _kwic_sql(words: tuple[str, ...], half: int) -> str:
    parts = []
    for w in words:
        if "-" in w:
            tokens = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')"
        else:
            tokens = "regexp_split_to_array(lower(text), '[- ]')"
            if " " in w:
                run = " || ".join(f"chr(1) || {_quoted(x)} || chr(1)" for x in w.split())
                marked = f"array_to_string(list_transform({tokens}, lambda x: chr(1) || x || chr(1)), '')"
                joined = f"replace({marked}, {run}, chr(1) || {_quoted(w)} || chr(1))"
                tokens = f"string_split(substring({joined}, 2, length({joined}) - 2), chr(1) || chr(1))"
        hit = f"len(regexp_extract_all(lower(text), '\\s{w}\\s')) > 0"
        parts.append(f"SELECT {_quoted(w)} AS keyword, doc_id, page, pos, array_to_string(t[greatest(pos - {half}, 0) + 1 : pos + {half}], ' ') AS context FROM (SELECT doc_id, page, t, unnest(range(len(t))) AS pos FROM (SELECT doc_id, page, {tokens} AS t FROM pages WHERE {hit})) WHERE t[pos + 1] = {_quoted(w)}")
    return f"WITH {_PAGES} SELECT keyword, doc_id, CAST(page AS INTEGER) AS page, CAST(pos AS INTEGER) AS pos, context FROM (" + " UNION ALL ".join(parts) + ")"


def _kwic(words: tuple[str, ...], length: int):
    return lambda spark, sf_dir: kwic.contexts(_clean(spark, sf_dir), kw.KeywordSet.of(list(words)), length)


query("kwic_plain", _kwic_sql(("the", "de", "that"), 15))(_kwic(("the", "de", "that"), 30))
query("kwic_multiword", _kwic_sql(("on the",), 2))(_kwic(("on the",), 5))
query("kwic_hyphen", _kwic_sql(("by-nc",), 4))(_kwic(("by-nc",), 7))


@query("kwic_window", _kwic_sql(("of",), 15))
def kwic_window(spark, sf_dir):
    return kwic.contexts_by_frame(_clean(spark, sf_dir), "of", 30)


# --- records -------------------------------------------------------------------------------------------------------

#: Three sources, with gaps of each kind; {s} is the name of the text type.
_RECORDS = """SELECT doc_id AS rec_id,
       CASE WHEN doc_id % 3 = 0 THEN 'wos' WHEN doc_id % 3 = 1 THEN 'scopus' ELSE 'pubmed' END AS db,
       CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 10 = 1 THEN NULL WHEN doc_id % 10 = 2 THEN ' None '
            WHEN doc_id % 10 = 3 THEN concat(' 10.5555/d', CAST(doc_id AS {s}), '  ') ELSE concat('10.5555/d', CAST(doc_id AS {s})) END AS di,
       CASE WHEN doc_id % 4 = 0 THEN 'none' ELSE text END AS ti,
       CASE WHEN doc_id % 5 = 0 THEN CAST(2000 + doc_id % 24 AS {s}) ELSE '' END AS py,
       CASE WHEN doc_id % 6 = 0 THEN NULL ELSE source END AS so,
       lang AS la,
       CASE WHEN doc_id % 7 = 0 THEN '12' ELSE '' END AS bp,
       '' AS ep
FROM {documents}"""
#: Of every document six offers; every third is for a DOI that no record has.
_OFFERS = """SELECT p.prio, concat('10.5555/', CASE WHEN (doc_id * 7 + p.prio) % 3 = 0 THEN 'x' ELSE 'd' END, CAST(doc_id AS {s})) AS doi,
       CASE WHEN (doc_id + p.prio) % 3 = 0 THEN text WHEN (doc_id + p.prio) % 3 = 1 THEN 'none' ELSE NULL END AS title,
       CASE WHEN (doc_id * p.prio) % 5 = 0 THEN CAST(1990 + doc_id % 30 AS {s}) ELSE '' END AS issued,
       CASE WHEN (doc_id + p.prio) % 4 = 0 THEN concat('J-', source) ELSE NULL END AS container,
       CASE WHEN (doc_id + p.prio) % 2 = 0 THEN concat(CAST(doc_id % 90 AS {s}), '-', CAST(doc_id % 90 + p.prio AS {s})) ELSE '7' END AS pages
FROM {documents} CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6]) AS prio) p"""
_STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_MISSING = "({c} IS NULL OR lower(" + _STRIP + ") IN ('', 'none'))"
_DOI_KEY = "concat('doi:', regexp_replace(lower(" + _STRIP.format(c="di") + "), '^https?://(dx\\.)?doi\\.org/', ''))"
_TITLE = "upper(regexp_replace(ti, '[^\\p{L}\\p{M}\\p{N} ]', '', 'g'))"
_TITLE_KEY = f"concat('ti:', {_TITLE}, '|', coalesce(py, ''))"
_DEDUP = f"keyed AS (SELECT *, CASE WHEN NOT {_MISSING.format(c='di')} THEN {_DOI_KEY} WHEN NOT {_MISSING.format(c='ti')} AND trim({_TITLE}) <> '' THEN {_TITLE_KEY} END AS k FROM records), ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE db WHEN 'wos' THEN 0 WHEN 'scopus' THEN 1 ELSE 2 END, rec_id) AS r FROM keyed) SELECT rec_id, db, di, ti, py, so, la, bp, ep FROM ranked WHERE r = 1 OR k IS NULL"
_REC = "records AS (" + _RECORDS.format(s="VARCHAR", documents="documents") + ")"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RECORDS.format(s="STRING", documents="{documents}"), documents=_table(spark, sf_dir, "documents"))


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers in rows of a document each, priorities exploded beside it."""
    docs = _table(spark, sf_dir, "documents").select("*", F.explode(F.array(*[F.lit(k) for k in range(1, 7)])).alias("prio"))
    return spark.sql(_OFFERS.format(s="STRING", documents="{documents}").replace(" CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6]) AS prio) p", " p"), documents=docs)


def _sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The three exports, of different columns."""
    rows = _records(spark, sf_dir)
    return [rows.where("db = 'wos'").drop("bp"), rows.where("db = 'scopus'").drop("la", "ep"), rows.where("db = 'pubmed'").drop("so")]


_UNION = f"WITH {_REC} SELECT rec_id, db, di, ti, py, CASE WHEN db <> 'pubmed' THEN so END AS so, CASE WHEN db <> 'scopus' THEN la END AS la, CASE WHEN db <> 'wos' THEN bp END AS bp, CASE WHEN db <> 'scopus' THEN ep END AS ep, row_number() OVER (ORDER BY db, rec_id) - 1 AS index FROM records"


@query("records_union", _UNION)
def records_union(spark, sf_dir):
    return records.with_index(records.union_by_name(_sources(spark, sf_dir)), "db", "rec_id")


@query("records_dedup", f"WITH {_REC}, {_DEDUP}")
def records_dedup(spark, sf_dir):
    return records.dedup(_records(spark, sf_dir))


@query("records_reference_swap", 'SELECT doc_id AS rec_id, lower(source) AS "CR" FROM documents')
def records_reference_swap(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), F.col("source").alias("CR"), F.lower("source").alias("CR_raw"))
    return records.swap_reference_column(rows)


_TAGS = ("DI", "TI", "SO", "AU", "PY", "VL", "IS", "BP", "EP", "PU", "AB", "CR", "LA", "C1", "DE", "RP", "DT")


@query("records_ensure_columns", 'SELECT doc_id AS rec_id, lang AS "LA", source AS "SO", ' + ", ".join(f"'' AS \"{t}\"" for t in _TAGS if t not in ("LA", "SO")) + " FROM documents")
def records_ensure_columns(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), F.col("lang").alias("LA"), F.col("source").alias("SO"))
    return records.ensure_columns(rows, list(_TAGS))


# --- scalar functions ----------------------------------------------------------------------------------------------

_CITE = "regexp_replace(regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '^\\s*[0-9]+[).]\\s*', ''), '^\\s+|\\s+$', '', 'g')"


@query("clean_citation", "SELECT page_id, " + _CITE.format(c="concat(CAST(page_id AS VARCHAR), '. ', html)") + " AS citation FROM pages")
def clean_citation(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", fn.clean_citation(F.concat(F.col("page_id").cast("string"), F.lit(". "), "html")).alias("citation"))


_WORD = "string_split(replace(text, chr(10), ' '), ' ')[{k}]"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ").alias("w"))


_W = "words AS (SELECT doc_id, lang, source, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents)"


@query("authors", f"WITH {_W}, named AS (SELECT doc_id, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i % 3 = 0 THEN concat('The ', w[i]) ELSE trim(concat(w[i], ', ', coalesce(w[i + 1], '')), ', ') END) AS n FROM words) SELECT doc_id, array_to_string(list_filter(n, lambda x: x <> ''), '; ') AS authors FROM named")
def authors(spark, sf_dir):
    """Every word as a family name with the next one as given name, every third as the name of a group."""
    w = lambda i: F.get("w", i)
    person = lambda x, i: F.struct(x.alias("family"), w(i + 1).alias("given"), F.when(i % 3 == 2, F.concat(F.lit("The "), x)).alias("literal"))
    return _words(spark, sf_dir).select("doc_id", fn.authors(F.transform("w", person)).alias("authors"))


@query("issued_year", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(1990 + doc_id % 30 AS VARCHAR) WHEN doc_id % 3 = 1 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS year, CASE WHEN doc_id % 3 = 0 THEN CAST(1990 + doc_id % 30 AS VARCHAR) ELSE '' END AS compat_year FROM documents")
def issued_year(spark, sf_dir):
    year = (F.lit(1990) + F.col("doc_id") % 30).cast("int")
    parts = F.when(F.col("doc_id") % 3 == 0, F.array(F.array(year, F.lit(1)))).otherwise(F.array().cast("array<array<int>>"))
    scalar = F.when(F.col("doc_id") % 3 == 1, F.col("doc_id"))
    return _table(spark, sf_dir, "documents").select("doc_id", fn.issued_year(parts, scalar).alias("year"), fn.issued_year(parts, scalar, compat=True).alias("compat_year"))


@query("page_range", "WITH p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat(CAST(doc_id AS VARCHAR), ' - ', CAST(doc_id + 9 AS VARCHAR), '-x') ELSE CAST(doc_id AS VARCHAR) END AS v FROM documents) SELECT doc_id, CASE WHEN contains(v, '-') THEN trim(split_part(v, '-', 1)) ELSE v END AS bp, CASE WHEN contains(v, '-') THEN trim(split_part(v, '-', 2)) ELSE '' END AS ep FROM p")
def page_range(spark, sf_dir):
    v = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(" - "), (F.col("doc_id") + 9).cast("string"), F.lit("-x"))).otherwise(F.col("doc_id").cast("string"))
    return _table(spark, sf_dir, "documents").select("doc_id", fn.begin_page(v).alias("bp"), fn.end_page(v).alias("ep"))


@query("issn_join", "SELECT doc_id, concat(lang, ', ', source) AS issn FROM documents")
def issn_join(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", fn.issn(F.array("lang", "source")).alias("issn"))


@query("first_of_list", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS first FROM documents")
def first_of_list(spark, sf_dir):
    value = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source"))
    return _table(spark, sf_dir, "documents").select("doc_id", fn.first_of_list(value).alias("first"))


# --- references ----------------------------------------------------------------------------------------------------

_WORKS = "works AS (SELECT concat('W', CAST(doc_id AS VARCHAR)) AS id, " + _CITE.format(c="concat_ws(', ', nullif(upper(concat(lang, ', ', source)), ''), nullif(text, ''), nullif(upper(source), ''), nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE '4' END, ''), '(2001)')") + " AS citation FROM documents)"


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("W"), "doc_id").alias("work_id"), F.array("lang", "source").alias("authors"), F.col("text").alias("title"), F.col("source").alias("journal"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("4").alias("volume"), F.lit("2001").alias("year"))


@query("citation_format", f"WITH {_WORKS} SELECT id AS work_id, citation FROM works")
def citation_format(spark, sf_dir):
    return references.citations(_works(spark, sf_dir))


#: The resolver's address is followed by an id that no document has, for every third row.
_REFS = "concat('1. ', lang, ' <i>x</i>; none;; W', CAST(doc_id AS VARCHAR), ' ; https://openalex.org/W', CAST(CASE WHEN doc_id % 3 = 0 THEN -1 - doc_id ELSE doc_id END AS VARCHAR), ';', source, ' ')"


@query("references_string", f"""WITH {_WORKS}, parts AS (SELECT doc_id AS rec_id, list_transform(string_split({_REFS}, ';'), lambda x: {_STRIP.format(c='x')}) AS p FROM documents),
each AS (SELECT rec_id, unnest(range(len(p))) AS pos, unnest(p) AS ref FROM parts), named AS (SELECT *, CASE WHEN regexp_matches(ref, '^W[0-9]+$') THEN ref WHEN starts_with(ref, 'https://openalex.org/') THEN replace(ref, 'https://openalex.org/', '') END AS wid FROM each WHERE lower(ref) NOT IN ('', 'none')),
found AS (SELECT rec_id, pos, CASE WHEN wid IS NOT NULL THEN citation ELSE {_CITE.format(c='ref')} END AS t FROM named LEFT JOIN works ON wid = id)
SELECT rec_id, coalesce(string_agg(t, '; ' ORDER BY pos), '') AS "references" FROM found GROUP BY rec_id""")
def references_string(spark, sf_dir):
    text = F.expr(_REFS.replace("VARCHAR", "STRING"))
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), references.split_references(text).alias("refs"))
    return references.resolve(rows, F.col("refs"), _works(spark, sf_dir))


@query("references_list", f"SELECT doc_id AS rec_id, CASE WHEN doc_id % 3 = 0 THEN concat('1/', source) WHEN doc_id % 3 = 1 THEN lang ELSE concat('{{\"unstructured\":\"\",\"DOI\":\"\",\"key\":\"', source, '\"}}') END || '; ' || source AS \"references\" FROM documents")
def references_list(spark, sf_dir):
    k = F.col("doc_id") % 3
    ref = F.struct(F.when(k == 1, F.concat(F.lit(" 2) "), "lang")).otherwise("").alias("unstructured"), F.when(k == 0, F.concat(F.lit("10.1/"), "source")).otherwise("").alias("DOI"), F.when(k == 2, F.col("source")).alias("key"))
    plain = F.struct(F.col("source").alias("unstructured"), F.lit("").alias("DOI"), F.lit(None).cast("string").alias("key"))
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), F.transform(F.array(ref, plain), references.reference_text).alias("refs"))
    return references.resolve(rows, F.col("refs"), _works(spark, sf_dir))


# --- providers -----------------------------------------------------------------------------------------------------


@query("provider_json", "SELECT concat('10.9/', CAST(doc_id AS VARCHAR)) AS doi, text AS title, CASE WHEN doc_id % 2 = 0 THEN source ELSE NULL END AS container, concat(lang, '; ', source) AS author, CAST(1990 + doc_id % 30 AS VARCHAR) AS issued, concat('W', CAST(doc_id AS VARCHAR), '; W1') AS reference FROM documents WHERE doc_id % 4 <> 0")
def provider_json(spark, sf_dir):
    from ..sources import providers

    name = lambda c: F.struct(F.struct(c.alias("display_name")).alias("author"))
    venue = F.when(F.col("doc_id") % 2 == 0, F.struct(F.col("source").alias("display_name")))
    body = F.to_json(F.struct(F.col("text").alias("display_name"), venue.alias("host_venue"), F.array(name(F.col("lang")), name(F.col("source"))).alias("authorships"), (F.lit(1990) + F.col("doc_id") % 30).alias("publication_year"), F.array(F.concat(F.lit("W"), "doc_id"), F.lit("W1")).alias("referenced_works")))
    answers = _table(spark, sf_dir, "documents").select(F.concat(F.lit("10.9/"), "doc_id").alias("lookup"), F.when(F.col("doc_id") % 4 == 0, 404).otherwise(200).alias("status"), body.alias("body"))
    return providers.works(answers).select(F.col("lookup").alias("doi"), "title", F.col("container-title").alias("container"), "author", "issued", "reference")


# --- enrichment ----------------------------------------------------------------------------------------------------

_RULES = (en.FieldRule.of("title", "TI"), en.FieldRule.of("container-title", "SO"), en.FieldRule.of("issued", "PY"), en.FieldRule.of("page", "BP", "EP"))
_OFFER_COLUMNS = {"TI": "title", "SO": "container", "PY": "issued", "BP": "bp", "EP": "ep"}
_OFF = "offers AS (SELECT *, CASE WHEN contains(pages, '-') THEN split_part(pages, '-', 1) ELSE pages END AS bp, CASE WHEN contains(pages, '-') THEN split_part(pages, '-', 2) ELSE '' END AS ep FROM (" + _OFFERS.format(s="VARCHAR", documents="documents") + "))"
_FILLS = f"{_REC}, {_OFF}, open AS (SELECT * FROM records WHERE NOT {_MISSING.format(c='di')}), " + "fills AS (" + " UNION ALL ".join(
    f"SELECT rec_id, '{t}' AS field, r.{t.lower()} AS old_value, arg_min(o.{c}, prio) AS new_value, min(prio) AS prio, {k} AS map_pos FROM open r JOIN offers o ON trim(di) = doi WHERE {_MISSING.format(c='r.' + t.lower())} AND NOT {_MISSING.format(c='o.' + c)} GROUP BY rec_id, r.{t.lower()}" for k, (t, c) in enumerate(_OFFER_COLUMNS.items())
) + ")"
_NAMES = "CASE prio " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(en.PROVIDERS, 1)) + " END"


def _enrichment(spark: SparkSession, sf_dir: str) -> en.Enrichment:
    rows = _records(spark, sf_dir).select("rec_id", "db", F.col("di").alias("DI"), F.col("ti").alias("TI"), F.col("py").alias("PY"), F.col("so").alias("SO"), F.col("la").alias("LA"), F.col("bp").alias("BP"), F.col("ep").alias("EP"))
    offers = _offers(spark, sf_dir).select("prio", F.col("doi").alias("lookup"), "title", "issued", F.col("container").alias("container-title"), F.col("pages").alias("page"))
    return en.enrich(rows, offers, _RULES)


@query("enrich_fill", f"WITH {_FILLS} SELECT r.rec_id, r.db, r.di AS \"DI\", coalesce(max(CASE WHEN field = 'TI' THEN new_value END), any_value(r.ti)) AS \"TI\", coalesce(max(CASE WHEN field = 'PY' THEN new_value END), any_value(r.py)) AS \"PY\", coalesce(max(CASE WHEN field = 'SO' THEN new_value END), any_value(r.so)) AS \"SO\", any_value(r.la) AS \"LA\", coalesce(max(CASE WHEN field = 'BP' THEN new_value END), any_value(r.bp)) AS \"BP\", coalesce(max(CASE WHEN field = 'EP' THEN new_value END), any_value(r.ep)) AS \"EP\" FROM records r LEFT JOIN fills f ON f.rec_id = r.rec_id GROUP BY r.rec_id, r.db, r.di")
def enrich_fill(spark, sf_dir):
    return _enrichment(spark, sf_dir).table


@query("enrich_changelog", f"WITH {_FILLS} SELECT rec_id, field, old_value, new_value, {_NAMES} AS provider, CAST(prio AS INTEGER) AS prio, CAST(map_pos AS INTEGER) AS map_pos FROM fills")
def enrich_changelog(spark, sf_dir):
    return _enrichment(spark, sf_dir).changes


@query("enrich_column_counts", f"WITH {_FILLS} SELECT field, count(*) AS edits FROM fills GROUP BY field")
def enrich_column_counts(spark, sf_dir):
    return en.column_counts(_enrichment(spark, sf_dir).changes).select("field", "edits")


@query("enrich_changed_rows", f"WITH {_FILLS} SELECT count(DISTINCT rec_id) AS changed_rows FROM fills")
def enrich_changed_rows(spark, sf_dir):
    return en.changed_rows(_enrichment(spark, sf_dir).changes)


@query("enrich_skipped", f"WITH {_REC} SELECT count(*) AS skipped FROM records WHERE {_MISSING.format(c='di')}")
def enrich_skipped(spark, sf_dir):
    return en.skipped_count(_records(spark, sf_dir))


@query("enrich_unchanged", f"WITH {_FILLS} SELECT rec_id, db FROM records WHERE rec_id NOT IN (SELECT rec_id FROM fills)")
def enrich_unchanged(spark, sf_dir):
    return en.unchanged_records(_records(spark, sf_dir), _enrichment(spark, sf_dir).changes).select("rec_id", "db")


@query("enrich_changed", f"WITH {_FILLS} SELECT rec_id, db FROM records WHERE rec_id IN (SELECT rec_id FROM fills)")
def enrich_changed(spark, sf_dir):
    return en.changed_records(_records(spark, sf_dir), _enrichment(spark, sf_dir).changes).select("rec_id", "db")


@query("change_lines", f"WITH {_FILLS} SELECT rec_id, CAST(map_pos AS INTEGER) AS map_pos, concat('Row ', CAST(rec_id AS VARCHAR), ' - ', field, ' updated from ''', coalesce(old_value, ''), ''' to ''', new_value, ''' via ', {_NAMES}, '.') AS line FROM fills")
def change_lines(spark, sf_dir):
    return en.change_lines(_enrichment(spark, sf_dir).changes).select("rec_id", "map_pos", "line")


# --- OCR -----------------------------------------------------------------------------------------------------------

_PATH = "concat('/in/', regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), CASE WHEN page_id % 5 = 0 THEN '.txt' ELSE '.pdf' END)"


@query("ocr_plan", f"WITH p AS (SELECT {_PATH} AS path FROM pages) SELECT path AS in_path, substring(path, 5) AS rel_path, concat('/out/', substring(path, 5)) AS out_path, regexp_replace(concat('/out/', substring(path, 5)), '\\.[^./]*$', '') || '.txt' AS sidecar_path, 'eng+deu' AS language, 15 AS threshold, true AS skip_text FROM p WHERE path LIKE '%.pdf'")
def ocr_plan(spark, sf_dir):
    paths = _table(spark, sf_dir, "pages").select(F.expr(_PATH).alias("path"))
    options = ocr.OcrOptions(("English", "German"), rotate=True, sidecar=True)
    jobs = ocr.plan(paths, "/in", "/out", options)
    return jobs.select("in_path", "rel_path", "out_path", "sidecar_path", "options.language", F.col("options.rotate_pages_threshold").alias("threshold"), "options.skip_text")


_LANG_NAMES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish/Castilian"}


@query("language_codes", "SELECT doc_id, lang, CASE lang " + " ".join(f"WHEN '{k}' THEN '{catalogue()[v]}'" for k, v in _LANG_NAMES.items()) + " END AS code FROM documents")
def language_codes(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for pair in _LANG_NAMES.items() for x in pair])
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", names[F.col("lang")].alias("name"))
    return docs.join(F.broadcast(catalogue_table(spark)), "name", "left").select("doc_id", "lang", "code")


from . import interchange, matching  # noqa: E402, F401  adds the queries of imports, providers, sinks and matching
