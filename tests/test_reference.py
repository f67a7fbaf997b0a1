"""Operators on small inputs, against models written apart from them."""

import re

import pytest
from pyspark.sql import functions as F

from folioscope.functions import fields as fn
from folioscope.functions import text as tx
from folioscope.functions.languages import catalogue, code_of
from folioscope.operators import enrich, keywords, kwic, ocr, records, references
from folioscope.sources import corpus, providers, sheets, sinks
from folioscope.sources import records as rec
from folioscope.streaming import keywords as stream


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def pages(spark, *texts):
    return spark.createDataFrame([("d", k + 1, t) for k, t in enumerate(texts)], "doc_id string, page int, text string")


# --- filters and tokens


def test_filter_precedence():
    assert tx.FilterSpec.resolve(True, "abc", "x").mode == "basic"
    assert tx.FilterSpec.resolve(False, "a\nb", "x") == tx.FilterSpec("chars", "ab")
    assert tx.FilterSpec.resolve(False, "", "x\n") == tx.FilterSpec("chars", "x")
    assert tx.FilterSpec.resolve() == tx.FilterSpec()


@pytest.mark.parametrize(("spec", "want"), [(tx.FilterSpec("basic"), "abcd e"), (tx.FilterSpec("chars", "-\n"), "abcéd e"), (tx.FilterSpec(), "a-b\ncéd e")])
def test_filters(spark, spec, want):
    assert one(spark, spec.clean(F.col("t")), t="A-b\nCéd e") == want


def test_hits_use_up_white_space(spark):
    for t in ("the the the the ", " the the", " the\nthe  the ", "the"):
        assert one(spark, tx.hit_count(F.col("t"), "the"), t=t) == len(re.findall(r"\sthe\s", t))
    assert one(spark, tx.hit_count(F.col("t"), "a.c"), t=" abc a.c ") == 1
    assert one(spark, tx.hit_count(F.col("t"), "a.c", regex=False), t=" abc  a.c ") == 1
    assert one(spark, tx.hit_count(F.col("t"), "x", unicode_ws=True), t=" x ") == 1


def test_bad_regex_is_an_error_before_any_job(spark):
    with pytest.raises(ValueError, match="regular expression"):
        keywords.page_hits(pages(spark, " a "), keywords.KeywordSet.of(["("]))
    with pytest.raises(ValueError, match="no keywords"):
        keywords.KeywordSet.of(["", " "])


def test_keywords_are_normalised(spark, tmp_path):
    assert corpus.normal_keywords(["B", "a\n", "b", "", "A"]) == ["b", "a"]
    (tmp_path / "k").write_text("x\ny\n")
    assert corpus.keyword_lines(str(tmp_path / "k"), "z") == ["x", "y", ""]
    assert corpus.keyword_lines(None, "z\nw") == ["z", "w"]


def collapsed(tokens, phrase):
    words, out, k = phrase.split(), [], 0
    while k < len(tokens):
        if tokens[k : k + len(words)] == words:
            out.append(phrase)
            k += len(words)
        else:
            out.append(tokens[k])
            k += 1
    return out


def kwic_model(text, word, length, compat=False):
    if not re.findall(rf"\s{word}\s", text):
        return []
    tokens = text.split() if "-" in word else re.split("[- ]", text)
    tokens = collapsed(tokens, word) if " " in word and "-" not in word else tokens
    h = round(length / 2)
    rows = []
    for k, t in enumerate(tokens):
        if t == word:
            start = k - h if compat else max(0, k - h)
            rows.append((k, " ".join(tokens[start:k] + tokens[k : k + h])))
    return rows


@pytest.mark.parametrize("length", [5, 7, 30])
@pytest.mark.parametrize("compat", [False, True])
def test_contexts_equal_a_model(spark, length, compat):
    texts = ["on the on the way on the ", "x on the-a  by-nc on the b\nc the  the d", " by-nc e the f", "the", "a b the c d e f g the h"]
    words = ["the", "on the", "by-nc"]
    got = kwic.contexts(pages(spark, *texts), keywords.KeywordSet.of(words), length, compat).collect()
    want = [(w, p + 1, *r) for w in words for p, t in enumerate(texts) for r in kwic_model(t, w, length, compat)]
    assert sorted((r["keyword"], r["page"], r["pos"], r["context"]) for r in got) == sorted(want)


def test_counts_add_up(spark):
    words = keywords.KeywordSet.of(["the", "of", "zzz"])
    hits = keywords.page_hits(pages(spark, " the of the x the ", " of ", "none"), words)
    counts = keywords.document_counts(hits)
    assert {(r["keyword"], r["hits"]) for r in counts.collect()} == {("the", 3), ("of", 2), ("zzz", 0)}
    wide = keywords.overview(hits, words)
    assert wide.columns == ["doc_id", "the", "of", "zzz"] and tuple(wide.first())[1:] == (3, 2, 0)
    series = keywords.chart_by_document(counts).orderBy("rank").collect()
    assert [(r["keyword"], r["label"]) for r in series] == [("of", "40.00% (2)"), ("the", "60.00% (3)")]
    assert abs(sum(r["pct"] for r in series) - 100) < 1e-9
    levels = {(r["doc_id"], r["keyword"]): r["hits"] for r in keywords.rollup(hits).collect()}
    assert levels[(None, "the")] == levels[("d", "the")] == 3


def test_long_keyword_lists_count_alike(spark, monkeypatch):
    words = keywords.KeywordSet.of(["the", "o.", "zzz"])
    own = pages(spark, " the of the x the ", " of ", "none")
    short = {tuple(r) for r in keywords.page_hits(own, words).collect()}
    monkeypatch.setattr(keywords, "INLINE_WORDS", 1)
    assert {tuple(r) for r in keywords.page_hits(own, words, keep_text=False).collect()} == short
    assert keywords.page_hits(own, words, keep_text=True).columns == ["doc_id", "page", "text", "ord", "keyword", "hits"]


def test_counting_is_one_scan_without_copies(spark):
    words = keywords.KeywordSet.of(["the", "on the", "by-nc"])
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    own = keywords.clean_pages(corpus.text_pages(docs))
    for made in (keywords.page_hits(own, words), kwic.contexts(own, words)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and plan.count("Scan") == 1


def test_pages(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, ""), (3, None)], "doc_id int, text string")
    assert [tuple(r) for r in corpus.text_pages(docs, 3).orderBy("doc_id", "page").collect()] == [(1, 1, "a\nb\nc"), (1, 2, "d"), (2, 1, ""), (3, 1, "")]
    assert corpus.separated_pages(spark.createDataFrame([(1, "a\fb")], "doc_id int, text string")).count() == 2


def test_files_and_extractors(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.PDF").write_bytes(b"no")
    (tmp_path / "bad.pdf").write_bytes(b"\xff")
    cut = lambda b: b.decode().split("|")
    got = corpus.file_pages(spark, str(tmp_path), cut, skip_unreadable=True).orderBy("page").collect()
    assert [tuple(r) for r in got] == [("a.pdf", 1, "one"), ("a.pdf", 2, "two")]
    with pytest.raises(Exception, match="utf-8|codec"):
        corpus.file_pages(spark, str(tmp_path), cut).collect()


# --- fields


@pytest.mark.parametrize(("value", "missing"), [(None, True), ("", True), (" \t\n", True), (" None ", True), ("none x", False), ("x", False)])
def test_missing(spark, value, missing):
    assert one(spark, fn.is_missing(F.col("v").cast("string")), v=value) is missing


def test_citation_is_cleaned(spark):
    assert one(spark, fn.clean_citation(F.col("v")), v=" 12. <i>A</i> b 3) c ") == "A b 3) c"
    assert one(spark, fn.clean_citation(F.col("v")), v="10.1/x") == "1/x"


def test_authors(spark):
    rows = [("A", "B", None), ("A", None, None), (None, "B", None), (None, None, None), (None, None, "The Group")]
    df = spark.createDataFrame([(rows,)], "v array<struct<family:string,given:string,literal:string>>")
    assert df.select(fn.authors(F.col("v"))).first()[0] == "A, B; A; B; The Group"


@pytest.mark.parametrize(("value", "want"), [("1-9", ("1", "9")), ("e5", ("e5", "")), (" 1 - 2 - 3", ("1", "2"))])
def test_page_pair(spark, value, want):
    assert (one(spark, fn.begin_page(F.col("v")), v=value), one(spark, fn.end_page(F.col("v")), v=value)) == want


def test_languages(spark):
    assert len(catalogue()) == 158
    assert one(spark, code_of(F.col("n")), n="Spanish/Castilian") == "spa"
    assert one(spark, code_of(F.col("n")), n="no such") is None


# --- records


def test_union_and_dedup(spark):
    a = spark.createDataFrame([(1, "wos", "10.1/A", "T", "2000"), (2, "wos", None, "Same title!", "2001"), (3, "wos", "", None, None)], "rec_id int, db string, di string, ti string, py string")
    b = spark.createDataFrame([(4, "scopus", "https://doi.org/10.1/a ", "U", "x"), (5, "scopus", "none", "same TITLE", "2001"), (6, "scopus", None, None, "z")], "rec_id int, db string, di string, ti string, py string")
    both = records.union_by_name([a, b])
    assert sorted(r["rec_id"] for r in records.dedup(both).collect()) == [1, 2, 3, 6]
    indexed = records.with_index(both, "rec_id").orderBy("index").collect()
    assert [(r["index"], r["rec_id"]) for r in indexed] == [(k, k + 1) for k in range(6)]


def test_index_of_many_rows(spark):
    """Over a million rows and adaptive plans, ties and clashing names included: every row once, every number once, in order."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    try:
        df = spark.range(1_200_000).select(F.pmod(F.xxhash64("id"), F.lit(500_000)).alias("k"), F.col("id").alias("_part"), F.lit("x").alias("index"))
        got = records.with_index(df, "k")
        assert got.columns == ["k", "_part", "index"]
        row = got.agg(F.count("*"), F.countDistinct("_part"), F.countDistinct("index"), F.min("index"), F.max("index")).first()
        assert tuple(row) == (1_200_000, 1_200_000, 1_200_000, 0, 1_199_999)
        bad = got.alias("a").join(got.select((F.col("index") + 1).alias("index"), F.col("k").alias("before")), "index").where("before > k")
        assert bad.count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert records.with_index(df.limit(0), "k").count() == 0


def test_dedup_of_other_scripts_and_repeated_ids(spark):
    rows = [(1, "wos", None, "数据", "2001"), (2, "wos", None, "中文", "2001"), (3, "wos", None, "Данные", "2001"), (4, "wos", None, "!!!", "2001"), (5, "wos", None, "???", "2001"), (6, "wos", None, "数据!", "2001"),
            (7, "wos", "10.1/a", "T", "2000"), (7, "scopus", "10.1/a", "T", "2000"), (7, "wos", "10.1/a", "T", "2000"), (None, "pubmed", "10.1/A ", "U", None)]
    df = spark.createDataFrame(rows, "rec_id int, db string, di string, ti string, py string").withColumn("key", F.lit(1)).withColumn("row", F.lit(2))
    got = records.dedup(df)
    assert got.columns == df.columns
    assert sorted((r["rec_id"], r["db"]) for r in got.collect()) == [(1, "wos"), (2, "wos"), (3, "wos"), (4, "wos"), (5, "wos"), (7, "wos")]


def test_columns(spark):
    df = spark.createDataFrame([(1, "a", "b")], "rec_id int, CR string, CR_raw string")
    assert records.swap_reference_column(df).first().asDict() == {"rec_id": 1, "CR": "b"}
    assert records.swap_reference_column(df.drop("CR_raw")).columns == ["rec_id"]
    assert records.ensure_columns(df.select("rec_id"), ["TI", "rec_id"]).first().asDict() == {"rec_id": 1, "TI": ""}


def test_tagged_records(spark, tmp_path):
    (tmp_path / "x.txt").write_text("FN x\nVR 1.0\nPT J\nAU A, B\n   C, D\nTI One\n   two\nER\n\nPT J\nTI Three\nER\nEF\n")
    got = rec.tagged_records(rec.numbered_lines(spark, str(tmp_path))).orderBy("record").collect()
    assert [(r["TI"], r["AU"]) for r in got] == [("One two", "A, B; C, D"), ("Three", None)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "y.txt").write_text("PMID- 1\nFAU - A, B\nFAU - C, D\nTI  - T\n\nPMID- 2\nTI  - U\n")
    got = rec.tagged_records(rec.numbered_lines(spark, str(tmp_path / "m")), "medline", "pubmed").orderBy("PMID").collect()
    assert [(r["PMID"], r["AU"], r["TI"], r["db"]) for r in got] == [("1", "A, B; C, D", "T", "pubmed"), ("2", None, "U", "pubmed")]


def test_csv_records_and_sinks(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Title,DOI,Year\n"A ""q""\nb",10.1/x,2001\n')
    row = rec.csv_records(spark, str(tmp_path / "c.csv")).first()
    assert (row["TI"], row["DI"], row["PY"], row["db"]) == ('A "q"\nb', "10.1/x", "2001", "scopus")
    hits = keywords.page_hits(pages(spark, " the x the "), keywords.KeywordSet.of(["the", "x"]))
    sinks.write_overview(keywords.overview(hits, keywords.KeywordSet.of(["the", "x"])), str(tmp_path / "o"))
    assert spark.read.csv(str(tmp_path / "o"), header=True).columns == ["doc_id", "the", "x"]
    sinks.write_contexts(kwic.contexts(pages(spark, " the x the "), keywords.KeywordSet.of(["the", "x"])), str(tmp_path / "k"))
    assert {r["keyword"] for r in spark.read.csv(str(tmp_path / "k"), header=True).collect()} == {"the", "x"}
    text = rec.concatenated_text(spark, str(tmp_path / "c.csv"))
    sinks.write_lines(text, str(tmp_path / "l"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "l")).collect()][-1] == ""
    with pytest.raises(sinks.ChartUnavailable):
        sinks.draw_charts(keywords.chart_total(keywords.totals(hits)), "t", "p", "b")


# --- references and providers


def test_references(spark):
    works = spark.createDataFrame([("W1", ["a b", "c"], "T", "j", "", "2000")], "work_id string, authors array<string>, title string, journal string, volume string, year string")
    rows = spark.createDataFrame([(1, "none; W1;2. x ;https://openalex.org/W1; W9"), (2, " NONE "), (3, None)], "rec_id int, v string")
    got = references.resolve(rows.withColumn("refs", references.split_references(F.col("v"))), F.col("refs"), works)
    cite = "A B, C, T, J, (2000)"
    assert {r["rec_id"]: r["references"] for r in got.collect()} == {1: f"{cite}; x; {cite}", 2: "", 3: ""}


def answers(spark, provider, body, status=200, key="10.1/x"):
    return spark.createDataFrame([(provider, key, status, body)], "provider string, lookup string, status int, body string")


def test_providers(spark):
    csl = '{"DOI":" 10.1/x ","title":["T"],"container-title":"J","author":[{"family":"A","given":"B"}],"issued":{"date-parts":[[2001,2]]},"page":"1-2","reference":[{"unstructured":"u"},{"DOI":"d"}]}'
    row = providers.csl(answers(spark, "PubMed", csl)).first()
    assert (row["DOI"], row["title"], row["container-title"], row["author"], row["issued"], row["page"], row["reference"]) == ("10.1/x", "T", "J", "A, B", "2001", "1-2", "u; d")
    assert providers.crossref(answers(spark, "Crossref", '{"message":' + csl + "}")).first()["title"] == "T"
    assert providers.crossref(answers(spark, "Crossref", '{"message":' + csl + "}", key="W1")).count() == 0
    paper = '{"title":"P","venue":"V","authors":[{"name":"N"},{}],"year":1999,"reference":[{"doi":"d1"},{"doi":""}]}'
    row = providers.papers(answers(spark, "Semantic Scholar", paper)).first()
    assert (row["DOI"], row["title"], row["author"], row["issued"], row["reference"]) == ("10.1/x", "P", "N", "1999", "d1")
    assert providers.papers(answers(spark, "Semantic Scholar", paper), compat=True).first()["issued"] == ""
    assert providers.citation_list(answers(spark, "NIH-OCC", '{"citations":["a","b"]}')).first()["reference"] == "a; b"
    assert providers.citation_list(answers(spark, "NIH-OCC", '{"citations":[]}')).count() == 0
    assert providers.works(answers(spark, "OpenAlex", "{}", 404)).count() == 0
    assert providers.article_ids(answers(spark, "PMC", '{"records":[{"pmcid":"PMC1"},{"pmcid":"PMC2"}]}')).first()["article_id"] == "PMC1"


def test_search_ids(spark):
    queries = spark.createDataFrame([("123",), ("a b",), ("zz",)], "query string")
    searches = spark.createDataFrame([("a b", 200, '{"esearchresult":{"idlist":["7","8"]}}'), ("zz", 200, '{"esearchresult":{"idlist":[]}}')], "query string, status int, body string")
    assert {r["query"]: r["id"] for r in providers.search_ids(queries, searches).collect()} == {"123": "123", "a b": "7"}


def test_article_xml(spark):
    xml = """<article xml:lang="en" article-type="research"><front><journal-title>J</journal-title><article-title>A <i>b</i></article-title><contrib contrib-type="author"><name><surname>S</surname><given-names>G</given-names></name></contrib>
    <contrib contrib-type="author"><name><surname>T</surname></name></contrib><aff>X <b>Y</b></aff><aff> </aff><pub-date><year>2003</year></pub-date><abstract>ab</abstract><kwd>k1</kwd><kwd>k2</kwd><corresp>c</corresp></front><ref><pub-id pub-id-type="doi"> d1 </pub-id></ref><ref/></article>"""
    want = {"title": "A b", "container-title": "J", "language": "en", "issued": "2003", "abstract": "ab", "author": "S, G; T", "affiliation": "X Y", "keywords": "k1; k2", "corresponding-author": "c", "document-type": "research", "reference": "d1"}
    row = providers.articles(answers(spark, "PMC", xml)).first().asDict()
    assert {k: v for k, v in row.items() if v is not None} == want | {"lookup": "10.1/x"}
    assert providers.articles(answers(spark, "PMC", "<broken")).count() == 0


def test_fetch_gives_up(spark):
    def never(provider, key):
        raise OSError("down")

    keys = spark.createDataFrame([("p", "k"), ("p", "k")], "provider string, lookup string")
    assert [tuple(r) for r in providers.fetch(keys, never, attempts=2, pause=0).collect()] == [("p", "k", 0, None)]


# --- enrichment


def test_enrichment_equals_a_row_loop(spark):
    rules = (enrich.FieldRule.of("title", "TI"), enrich.FieldRule.of("issued", "PY"), enrich.FieldRule.of("page", "BP", "EP"))
    rows = [(k, "10.1/%d" % (k % 7) if k % 5 else [None, "", " none"][k % 3], [None, "", "None", "kept"][k % 4], "" if k % 2 else "1999", "", "5" if k % 3 else "") for k in range(40)]
    offers = [(p, f"10.1/{d}", [None, "none", f"T{p}{d}"][(p + d) % 3], str(2000 + p) if p % 2 else " ", [None, "1-9", "4"][(p * d) % 3]) for p in range(1, 7) for d in range(7) if (p + d) % 4]
    df = spark.createDataFrame(rows, "rec_id int, DI string, TI string, PY string, BP string, EP string")
    made = enrich.enrich(df, spark.createDataFrame(offers, "prio int, lookup string, title string, issued string, page string"), rules)
    missing = lambda v: v is None or v.strip().lower() in ("", "none")
    want, log = {}, set()
    for rec_id, di, *values in rows:
        row = dict(zip(("TI", "PY", "BP", "EP"), values))
        for p in range(1, 7) if not missing(di) else []:
            for _, _, title, issued, page in [o for o in offers if o[:2] == (p, di)]:
                bp, ep = ((page.split("-") + [""])[:2] if "-" in page else (page, "")) if page is not None else (None, None)
                for field, value in (("TI", title), ("PY", issued), ("BP", bp), ("EP", ep)):
                    if missing(row[field]) and not missing(value):
                        log.add((rec_id, field, row[field], value, p))
                        row[field] = value
        want[rec_id] = row
    assert {r["rec_id"]: {k: r[k] for k in ("TI", "PY", "BP", "EP")} for r in made.table.collect()} == want
    assert {(r["rec_id"], r["field"], r["old_value"], r["new_value"], r["prio"]) for r in made.changes.collect()} == log
    again = enrich.enrich(made.table, spark.createDataFrame(offers, "prio int, lookup string, title string, issued string, page string"), rules)
    assert again.changes.count() == 0
    report = [r["line"] for r in sinks.change_report(made.changes).orderBy("part", "a", "b", "c", "d").collect()]
    assert report[3] == f"Total records changed: {len({x[0] for x in log})}" and len(report) > 7 + 2 * len(log) - 1


def test_enrichment_of_odd_rows(spark):
    """White space around keys, a provider that answered twice, and columns that are named as the operator's own."""
    rules = (enrich.FieldRule.of("title", "TI"), enrich.FieldRule.of("issued", "PY"))
    df = spark.createDataFrame([(1, " 10.1/x ", "", None, "own"), (2, None, "", None, "own"), (2, "10.1/x", "kept", "", "own")], "rec_id int, DI string, TI string, PY string, lookup string")
    offers = spark.createDataFrame([(1, "10.1/x", None, "2001"), (1, "10.1/x ", "T", None), (2, "10.1/x", "U", "1990"), (1, None, "V", "1")], "prio int, lookup string, title string, issued string")
    made = enrich.enrich(df, offers, rules)
    assert made.table.columns == df.columns
    assert sorted(map(tuple, made.table.collect()), key=str) == sorted([(1, " 10.1/x ", "T", "2001", "own"), (2, None, "", None, "own"), (2, "10.1/x", "kept", "2001", "own")], key=str)
    assert enrich.enrich(df, offers.limit(0), rules).changes.count() == 0
    assert enrich.enrich(df.limit(0), offers, rules).table.count() == 0
    from folioscope.progress import enrichment_summary

    assert enrichment_summary(df, made.changes) == {"changed": 2, "skipped": 1}


def test_sheets(spark, tmp_path):
    rows = [("a", None, " <x> & \"y\"\n"), (None, "", "\x01_x0041_"), ("é", "7", "")]
    df = spark.createDataFrame(rows, "A string, B string, `c d` string").coalesce(1)
    sheets.write_sheet(df, "file://" + str(tmp_path / "t.xlsx"))
    got = sheets.read_sheet(spark, str(tmp_path / "t.xlsx"))
    assert got.columns == ["A", "B", "c d"]
    assert [tuple(r) for r in got.collect()] == rows
    with pytest.raises(sheets.SheetTooLarge):
        sheets.workbook(["a"], iter([("x" * 40_000,)]))


def test_tagged_text_in_blocks(spark, tmp_path):
    """Records that run over the blocks of a file are put together."""
    (tmp_path / "x.txt").write_text("".join(f"PT J\nTI title {k}\n   goes on {k}\nAU a\n   b\nER\n\n" for k in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = rec.numbered_lines(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 5
        got = rec.tagged_records(lines, tags=["TI", "AU"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["TI"], r["AU"]) for r in got) == sorted((f"title {k} goes on {k}", "a; b") for k in range(400))


# --- OCR


def test_ocr(spark):
    options = ocr.OcrOptions(("English", "French"), pdfa=True, rotate=True, rotation="high", sidecar=True)
    paths = spark.createDataFrame([("/in/a/b.pdf",), ("/in/c.PDF",), ("/other/d.pdf",)], "path string")
    jobs = ocr.plan(paths, "/in/", "/out", options)
    row = jobs.first()
    assert (row["rel_path"], row["out_path"], row["sidecar_path"]) == ("a/b.pdf", "/out/a/b.pdf", "/out/a/b.txt")
    assert row["options"].asDict() == {"language": "eng+fra", "output_type": "pdfa", "rotate_pages": True, "rotate_pages_threshold": 30, "deskew": False, "redo_ocr": False, "skip_text": True, "invalidate_digital_signatures": True}
    assert [r["folder"] for r in ocr.folders(jobs).collect()] == ["/out/a"]
    for bad in (ocr.OcrOptions(()), ocr.OcrOptions(("Klingon",)), ocr.OcrOptions(("English",), deskew=True, redo=True)):
        with pytest.raises(ValueError):
            ocr.plan(paths, "/in", "/out", bad)
    with pytest.raises(ValueError):
        ocr.plan(paths, "/in", "/in/", options)

    def fails(job):
        raise OSError("broken")

    assert tuple(ocr.run(jobs, fails).first()) == ("/in/a/b.pdf", False, "broken")
    with pytest.raises(Exception, match="OCR engine"):
        ocr.run(jobs).collect()


# --- streaming


def test_stream_totals_equal_batch(spark, tmp_path):
    docs = spark.createDataFrame([(k, " the of the x\nand the of ") for k in range(20)], "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    words = keywords.KeywordSet.of(["the", "of"])
    query = stream.start(stream.running_totals(stream.stream_documents(spark, str(tmp_path / "in"), files_a_batch=1), words), "counts", str(tmp_path / "cp"))
    query.awaitTermination(120)
    batch = keywords.totals(keywords.page_hits(keywords.clean_pages(corpus.text_pages(docs)), words))
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in batch.collect()}
