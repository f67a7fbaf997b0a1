"""Registered queries of records that are one by any key, long keyword lists, works that very many refer to, exports of mixed columns, and of what is
run again: enrichment with more offers, counts of documents that are sent again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import enrich as en
from ..operators import keywords as kw
from ..operators import kwic, records, references
from ..sources import corpus, sinks
from ..sources import records as rec
from ..storage import fresh_path, written
from ..streaming import corrections
from ..streaming.keywords import stream_documents
from .catalogue import _CITE, _FILLS, _HITS, _MISSING, _NAMES, _PAGES, _RULES, _STRIP, _WORKS, ORACLE_SQL, _clean, _keywords, _offers, _records, _table, _works, query

# --- exports of mixed columns --------------------------------------------------------------------------------------


@query("import_csv_mixed", "SELECT CAST(doc_id AS VARCHAR) AS \"DI\", text AS \"TI\", CASE WHEN doc_id % 3 <> 1 THEN '2001' END AS \"PY\", CASE WHEN doc_id % 3 = 1 THEN concat(source, ', \"', lang, '\"') END AS \"SO\", CASE WHEN doc_id % 3 = 2 THEN lang END AS other, 'scopus' AS db FROM documents")
def import_csv_mixed(spark, sf_dir):
    """Three exports in one folder, columns in other orders, some only in one; whole texts, line ends and quotes included."""
    path = fresh_path(spark, "mixed")
    rest = F.col("doc_id") % 3
    column = {"DOI": F.col("doc_id"), "Title": F.col("text"), "Year": F.when(rest.isNotNull(), "2001"), "Source title": F.concat_ws("", "source", F.lit(', "'), "lang", F.lit('"')), "other": F.col("lang")}
    # documents without an id, or with one below 0, go with the first
    export = F.when(rest.isin(1, 2), rest).otherwise(0)
    for k, names in enumerate((("DOI", "Title", "Year"), ("Title", "Source title", "DOI"), ("other", "Year", "DOI", "Title"))):
        sinks.write_table(_table(spark, sf_dir, "documents").where(export == k).select(*[column[n].alias(n) for n in names]), f"{path}/{k}")
    return rec.csv_records(spark, f"{path}/*", keep_empty=True).select("DI", "TI", "PY", "SO", "other", "db")


# --- records that are one by any key -------------------------------------------------------------------------------

#: Each document as three records, of which the first two share a DOI and the last two a title; ids chain documents 7k, 7k + 1 and 7k + 2.
_COPIES = """SELECT 3 * doc_id + s AS rec_id, CASE s WHEN 0 THEN 'wos' WHEN 1 THEN 'scopus' ELSE 'pubmed' END AS db,
       CASE s WHEN 0 THEN concat('10.5555/D', CAST(doc_id AS {t})) WHEN 1 THEN concat(' https://doi.org/10.5555/d', CAST(doc_id AS {t})) ELSE 'None' END AS di,
       CASE s WHEN 0 THEN NULL WHEN 1 THEN text ELSE concat('.', text, '!') END AS ti,
       CASE s WHEN 0 THEN NULL ELSE CAST(2000 + (doc_id * 7919) % 3 AS {t}) END AS py,
       CASE WHEN s = 0 AND doc_id % 7 IN (1, 2) THEN CAST((doc_id - doc_id % 7) AS {t}) ELSE '' END AS ut,
       CASE WHEN s = 2 AND doc_id % 7 IN (0, 1) THEN CAST((doc_id - doc_id % 7) AS {t}) END AS pmid
FROM {documents}"""
_TITLE = "upper(regexp_replace(ti, '[^\\p{L}\\p{M}\\p{N} ]', '', 'g'))"
_CLASSES = f"""WITH RECURSIVE records AS ({_COPIES.format(t='VARCHAR', documents='documents CROSS JOIN (SELECT unnest([0, 1, 2]) AS s)')}),
keys AS (SELECT rec_id, concat('doi:', regexp_replace(lower({_STRIP.format(c='di')}), '^https?://(dx\\.)?doi\\.org/', '')) AS k FROM records WHERE NOT {_MISSING.format(c='di')}
UNION ALL SELECT rec_id, concat('ti:', {_TITLE}, '|', coalesce(py, '')) FROM records WHERE NOT {_MISSING.format(c='ti')} AND trim({_TITLE}) <> ''
UNION ALL SELECT rec_id, concat('ut:', ut) FROM records WHERE NOT {_MISSING.format(c='ut')} UNION ALL SELECT rec_id, concat('pmid:', pmid) FROM records WHERE NOT {_MISSING.format(c='pmid')}),
firsts AS (SELECT k, min(rec_id) AS f FROM keys GROUP BY k), links AS (SELECT DISTINCT rec_id AS x, f AS y FROM keys JOIN firsts USING (k) WHERE rec_id <> f), steps AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(rec_id, r) AS (SELECT rec_id, rec_id FROM records UNION SELECT reach.rec_id, steps.y FROM reach JOIN steps ON reach.r = steps.x),
classes AS (SELECT rec_id, min(r) AS class_id FROM reach GROUP BY rec_id),
whole AS (SELECT rec_id, db, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, row_number() OVER (PARTITION BY class_id ORDER BY CASE db WHEN 'wos' THEN 0 WHEN 'scopus' THEN 1 ELSE 2 END, rec_id) = 1 AS kept FROM classes JOIN records USING (rec_id))"""


def _copies(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("s"))
    return spark.sql(_COPIES.format(t="STRING", documents="{documents}"), documents=docs)


@query("records_classes", f"{_CLASSES} SELECT rec_id, db, class_id, class_size, kept FROM whole")
def records_classes(spark, sf_dir):
    return records.duplicate_classes(_copies(spark, sf_dir), ids=("ut", "pmid")).select("rec_id", "db", "class_id", "class_size", "kept")


@query("records_dedup_any", f"{_CLASSES} SELECT r.* FROM records r JOIN whole w ON w.rec_id = r.rec_id WHERE kept")
def records_dedup_any(spark, sf_dir):
    return records.dedup_any(_copies(spark, sf_dir), ids=("ut", "pmid"))


# --- long keyword lists --------------------------------------------------------------------------------------------

#: A list of so many words and so many phrases of two, the most frequent of the corpus.
_LIST_WORDS, _LIST_PHRASES = 9_000, 1_000
_BLANKS = "'[ \\t\\n\\x0B\\f\\r]'"
_LISTED = f"""{_PAGES}, cut AS (SELECT doc_id, page, regexp_split_to_array(lower(text), {_BLANKS}) AS t, regexp_extract_all(lower(text), {_BLANKS}) AS s FROM pages),
tokens AS (SELECT doc_id, page, unnest(range(2, len(t))) AS i, unnest(t[2 : len(t) - 1]) AS w FROM cut WHERE len(t) >= 3),
pairs AS (SELECT doc_id, page, i, t[i] || s[i] || t[i + 1] AS w FROM (SELECT doc_id, page, t, s, unnest(range(2, len(t) - 1)) AS i FROM cut WHERE len(t) >= 4) WHERE t[i] <> '' AND t[i + 1] <> '' AND t[i] <> t[i + 1] AND s[i] = ' '),
listed AS ((SELECT w, 1 AS n FROM tokens WHERE w <> '' GROUP BY w ORDER BY count(*) DESC, w LIMIT {_LIST_WORDS}) UNION ALL (SELECT w, 2 FROM pairs GROUP BY w ORDER BY count(*) DESC, w LIMIT {_LIST_PHRASES})),
found AS (SELECT doc_id, page, i, w, n FROM tokens JOIN listed USING (w) WHERE n = 1 UNION ALL SELECT doc_id, page, i, w, n FROM pairs JOIN listed USING (w) WHERE n = 2),
islands AS (SELECT doc_id, page, w, count(*) AS c FROM (SELECT *, i - n * row_number() OVER (PARTITION BY doc_id, page, w ORDER BY i) AS g FROM found) GROUP BY doc_id, page, w, g),
hits AS (SELECT doc_id, page, w AS keyword, CAST(sum((c + 1) // 2) AS INTEGER) AS hits FROM islands GROUP BY ALL)"""


def _long_list(pages: DataFrame) -> kw.KeywordSet:
    """The most frequent words and pairs of words between white space, as a list that a user would bring."""
    blank = "[ \\t\\n\\x0B\\f\\r]"
    cut = pages.select(F.split("text", blank).alias("t"), F.regexp_extract_all("text", F.lit(blank), F.lit(0)).alias("s"))
    words = cut.where(F.size("t") >= 3).select(F.explode(F.slice("t", 2, F.size("t") - 2)).alias("w")).where("w <> ''")
    place = F.struct(F.get("t", F.col("i")).alias("a"), F.get("s", F.col("i")).alias("s"), F.get("t", F.col("i") + 1).alias("b"))
    pairs = cut.where(F.size("t") >= 4).select("t", "s", F.explode(F.sequence(F.lit(1), F.size("t") - 3)).alias("i")).select(place.alias("p")).where("p.a <> '' and p.b <> '' and p.a <> p.b and p.s = ' '").select(F.concat("p.a", F.lit(" "), "p.b").alias("w"))
    most = lambda rows, n: [r["w"] for r in rows.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(n).collect()]
    return kw.KeywordSet.of(most(words, _LIST_WORDS) + most(pairs, _LIST_PHRASES), regex=False)


@query("keyword_long_list", f"WITH {_LISTED} SELECT doc_id, CAST(page AS INTEGER) AS page, keyword, hits FROM hits")
def keyword_long_list(spark, sf_dir):
    """Up to 10,000 keywords over every page."""
    pages = _clean(spark, sf_dir)
    return kw.listed_hits(pages, _long_list(pages)).select("doc_id", "page", "keyword", "hits")


#: A list of plain words of medium frequency: so many, after so many that are more frequent.
_SOME_WORDS, _SKIPPED = 400, 600


@query("kwic_long_list", f"""WITH {_PAGES}, cut AS (SELECT doc_id, page, lower(text) AS text, regexp_split_to_array(lower(text), {_BLANKS}) AS t FROM pages),
inner_words AS (SELECT doc_id, page, unnest(t[2 : len(t) - 1]) AS w FROM cut WHERE len(t) >= 3),
listed AS (SELECT w FROM inner_words WHERE regexp_full_match(w, '[a-z]+') GROUP BY w ORDER BY count(*) DESC, w LIMIT {_SOME_WORDS} OFFSET {_SKIPPED}),
hits AS (SELECT DISTINCT doc_id, page, w FROM inner_words JOIN listed USING (w)),
tokens AS (SELECT doc_id, page, t, unnest(range(len(t))) AS pos, unnest(t) AS w FROM (SELECT doc_id, page, regexp_split_to_array(text, '[- ]') AS t FROM cut))
SELECT w AS keyword, doc_id, CAST(page AS INTEGER) AS page, CAST(pos AS INTEGER) AS pos, array_to_string(t[greatest(pos - 15, 0) + 1 : pos + 15], ' ') AS context FROM tokens JOIN hits USING (doc_id, page, w)""")
def kwic_long_list(spark, sf_dir):
    """Contexts of hundreds of keywords at once."""
    pages = _clean(spark, sf_dir)
    blank = "[ \\t\\n\\x0B\\f\\r]"
    cut = pages.select(F.split("text", blank).alias("t")).where(F.size("t") >= 3)
    words = cut.select(F.explode(F.slice("t", 2, F.size("t") - 2)).alias("w")).where(F.regexp_like("w", F.lit("^[a-z]+$")))
    listed = [r["w"] for r in words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").offset(_SKIPPED).limit(_SOME_WORDS).collect()]
    return kwic.contexts(pages, kw.KeywordSet.of(listed), 30)


# --- works that very many refer to ---------------------------------------------------------------------------------


@query("references_hot", f"""WITH {_WORKS}, hot AS (SELECT concat('W', CAST(min(doc_id) AS VARCHAR)) AS id FROM documents),
cited AS (SELECT citation FROM works JOIN hot USING (id))
SELECT doc_id AS rec_id, concat_ws('; ', {_CITE.format(c='source')}, c.citation, w.citation, c.citation) AS "references" FROM documents JOIN works w ON w.id = concat('W', CAST(doc_id AS VARCHAR)), cited c""")
def references_hot(spark, sf_dir):
    """Half of all references are to one work."""
    docs = _table(spark, sf_dir, "documents")
    hot = docs.agg(F.concat(F.lit("W"), F.min("doc_id")).alias("hot"))
    rows = docs.crossJoin(F.broadcast(hot)).select(F.col("doc_id").alias("rec_id"), F.array(F.col("source"), F.col("hot"), F.concat(F.lit("W"), "doc_id"), F.concat(F.lit("https://openalex.org/"), "hot")).alias("refs"))
    return references.resolve(rows, F.col("refs"), _works(spark, sf_dir))


# --- enrichment run again ------------------------------------------------------------------------------------------

#: The same fills by the offers of later providers alone, from which the second run starts.
_EARLIER = _FILLS[_FILLS.index("fills AS (") :].replace("fills AS (", "earlier AS (", 1).replace("JOIN offers o", "JOIN (SELECT * FROM offers WHERE prio >= 3) o")
_SHOWN = "rec_id, field, version, old_value, new_value, {names} AS provider, CAST(prio AS INTEGER) AS prio, CAST(map_pos AS INTEGER) AS map_pos"


def _run_twice(spark, sf_dir):
    """Offers of the last four providers, then those of the first two."""
    rows = _records(spark, sf_dir).select("rec_id", "db", *[F.col(c.lower()).alias(c) for c in ("DI", "TI", "PY", "SO", "LA", "BP", "EP")])
    offers = _offers(spark, sf_dir).select("prio", F.col("doi").alias("lookup"), "title", "issued", F.col("container").alias("container-title"), F.col("pages").alias("page"))
    first = en.enrich(rows, offers.where("prio >= 3"), _RULES)
    table, log = written(first.table, "enriched"), written(en.first_version(first.changes), "change-log")
    return en.enrich_again(table, log, offers.where("prio < 3"), _RULES)


@query("enrich_again", ORACLE_SQL["enrich_fill"])
def enrich_again(spark, sf_dir):
    """The table after two runs is that of one run over all offers."""
    return _run_twice(spark, sf_dir)[0]


@query("enrich_versions", f"WITH {_FILLS}, {_EARLIER}, versions AS (SELECT 1 AS version, * FROM earlier UNION ALL SELECT CASE WHEN e.rec_id IS NULL THEN 1 ELSE 2 END, f.* FROM fills f LEFT JOIN earlier e ON e.rec_id = f.rec_id AND e.field = f.field WHERE e.rec_id IS NULL OR e.prio <> f.prio) SELECT {_SHOWN.format(names=_NAMES)} FROM versions")
def enrich_versions(spark, sf_dir):
    return _run_twice(spark, sf_dir)[1]


# --- a growing corpus with corrections -----------------------------------------------------------------------------

_LAST = _PAGES.replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text FROM documents)")


@query("stream_corrections", f"WITH {_HITS.replace(_PAGES, _LAST)} SELECT ord, keyword, CAST(sum(hits) AS BIGINT) AS hits FROM hits GROUP BY ord, keyword")
def stream_corrections(spark, sf_dir):
    """Every document comes twice, first with other words; every fifth is taken out by a third version. They arrive in a stream of several batches."""
    docs = _table(spark, sf_dir, "documents")
    sent = docs.select("doc_id", F.explode(F.array(*map(F.lit, range(3)))).alias("version"), "text")
    sent = sent.where("version < 2 or doc_id % 5 = 0").select("doc_id", F.col("version").cast("long").alias("version"), F.when(F.col("version") == 0, F.concat(F.lit(" the error of "), "text", F.lit(" the \n of "))).when(F.col("version") == 1, F.col("text")).alias("text"))
    path = fresh_path(spark, "stream")
    sent.repartition(12, "version", F.col("doc_id") % 4).write.parquet(f"{path}/in")
    arriving = stream_documents(spark, f"{path}/in", "doc_id long, version long, text string", files_a_batch=4)
    corrections.start(corrections.changes(arriving, _keywords()), f"{path}/changes", f"{path}/checkpoint").awaitTermination()
    return corrections.totals(spark.read.schema(corrections.CHANGES).parquet(f"{path}/changes"), _keywords())


# --- paged text files ----------------------------------------------------------------------------------------------

_PAGED = "paged AS (SELECT concat('folder=', source, '-', CAST(doc_id % 8 AS VARCHAR)) AS doc_id, CAST(row_number() OVER (PARTITION BY source, doc_id % 8 ORDER BY doc_id) AS INTEGER) AS page, text FROM documents)"


def _paged(spark, sf_dir) -> str:
    """Files of many folders, each with the texts of some documents as its pages."""
    path = fresh_path(spark, "paged-files")
    rows = _table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), (F.col("doc_id") % 8).cast("string")).alias("folder"), "doc_id", "text")
    rows.repartition("folder").sortWithinPartitions("folder", "doc_id").select("folder", "text").write.option("lineSep", "\f").partitionBy("folder").text(path)
    return f"{path}/*"


@query("paged_files", f"WITH {_PAGED} SELECT doc_id, page, text FROM paged")
def paged_files(spark, sf_dir):
    return corpus.paged_files(spark, _paged(spark, sf_dir), folder=True)


@query("paged_files_range", f"WITH {_PAGED} SELECT doc_id, page, text FROM paged WHERE page BETWEEN 2 AND 4")
def paged_files_range(spark, sf_dir):
    """The second to fourth page of every file."""
    return corpus.paged_files(spark, _paged(spark, sf_dir), (2, 4), folder=True)
