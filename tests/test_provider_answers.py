"""Answers of unsure types, and article XML against a parser of the standard library."""

from __future__ import annotations

import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from folioscope.sources import articles, providers


def answers(spark, *bodies, status=200):
    return spark.createDataFrame([(f"10.1/{k}", status, b, "clash") for k, b in enumerate(bodies)], "lookup string, status int, body string, x string")


def column(df, name):
    return {r["lookup"].removeprefix("10.1/"): r[name] for r in df.collect()}


def model(xml):
    """Fields of one article, by walking its tree."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return {}
    whole = lambda e: "".join(e.itertext()).strip()
    one = lambda path: (lambda e: whole(e) if e is not None else None)(root.find(path))
    every = lambda path: "; ".join(t for t in map(whole, root.iterfind(path)) if t)
    people = []
    for name in root.iterfind(".//contrib[@contrib-type='author']/name"):
        parts = [name.findtext(p) for p in ("surname", "given-names")]
        people.append((parts[0] or "") + (f", {parts[1]}" if parts[1] is not None else ""))
    date = root.find(".//pub-date")
    dois = [(r.findtext(".//pub-id[@pub-id-type='doi']") or "").strip() for r in root.iterfind(".//ref")]
    found = {
        "title": one(".//article-title"), "container-title": one(".//journal-title"), "language": root.get("{http://www.w3.org/XML/1998/namespace}lang"), "issued": date.findtext("year") if date is not None else None,
        "abstract": one(".//abstract"), "author": "; ".join(p for p in people if p), "affiliation": every(".//aff"), "keywords": every(".//kwd"), "corresponding-author": one(".//corresp"), "document-type": root.get("article-type"), "reference": "; ".join(d for d in dois if d),
    }
    return {k: v for k, v in found.items() if v}


XML = [
    '<article xml:lang="en" article-type="r"><front><journal-title>J</journal-title><article-title>T &lt;1&gt; <i>x</i> y &amp; &#233;</article-title></front></article>',
    '<?xml version="1.0" encoding="UTF-8"?>\n<!-- c --><!DOCTYPE article PUBLIC "-//X" "y.dtd">\n<article><article-title> A\n b </article-title></article>',
    '<article><front><article-title/><article-title>second</article-title><aff>A <b>q</b></aff><aff/><aff> </aff><aff id="1">one<!-- c --> <![CDATA[<two>]]></aff></front></article>',
    '<article><contrib contrib-type="author"><name><given-names>G</given-names><surname>S</surname></name></contrib><contrib contrib-type="editor"><name><surname>no</surname></name></contrib><contrib id="a" contrib-type="author"><collab>C</collab><name><surname>T</surname></name></contrib><contrib contrib-type="author"><name><given-names>only</given-names></name></contrib></article>',
    '<article><pub-date pub-type="e"><month>1</month><year>2001</year></pub-date><pub-date><year>1</year></pub-date><kwd>k1</kwd><kwd>k <i>2</i></kwd><kwd-group><kwd> k3 </kwd></kwd-group><corresp id="c">c <email>e</email></corresp><corresp>d</corresp></article>',
    '<article><pub-date><month>1</month></pub-date><abstract><title>Abs</title><p>one</p> <p>two</p></abstract><abstract>no</abstract></article>',
    '<article><back><ref-list><ref id="1"><pub-id pub-id-type="pmid">5</pub-id><pub-id pub-id-type="doi"> 10.1/a </pub-id><pub-id pub-id-type="doi">no</pub-id></ref><ref/><ref><pub-id pub-id-type="pmid">5</pub-id></ref><ref><element-citation><article-title>in ref</article-title><pub-id pub-id-type="doi">10.1/b</pub-id></element-citation></ref></ref-list></back></article>',
    "<article><front>", None, "", "no xml", "<article></article><article/>", "<article>&undefined;</article>", "<a></folioscope-article>", '<article><x:aff>unbound</x:aff></article>', "<article><p>nothing of use</p></article>", "x" * 100_000, "<article><abstract>" + "long " * 30_000 + "</abstract></article>",
]


def test_articles_equal_a_tree_walk(spark):
    got = {r["lookup"]: {k: v for k, v in r.asDict().items() if v is not None and k != "lookup"} for r in providers.articles(answers(spark, *XML)).collect()}
    want = {f"10.1/{k}": m for k, x in enumerate(XML) if (m := model(x))}
    assert want.keys() - got.keys() <= {"10.1/14"}
    for k, m in want.items():
        if k in got:
            assert got[k] == m
    assert got.keys() <= want.keys()
    assert providers.articles(answers(spark, *XML, status=404)).count() == 0
    assert providers.articles(answers(spark, *XML).limit(0)).count() == 0


def test_damaged_articles_end_no_job(spark):
    import random

    r = random.Random(8)
    damaged = []
    for _ in range(600):
        x = list(r.choice([x for x in XML if x and len(x) < 1000]))
        for _ in range(r.randrange(3)):
            at = r.randrange(len(x))
            x[at : at + r.randrange(3)] = r.choice(["<", ">", "&", "/", '"', "", "]]>", "<!--", "-->", "\x01", "&#0;", "&#65;", "<?x?>", "<![CDATA[", "</article>", "<a:b>", " a='1' a='2'"])
        damaged.append("".join(x))
    got = {r["lookup"]: {k: v for k, v in r.asDict().items() if v is not None and k != "lookup"} for r in providers.articles(answers(spark, *damaged)).collect()}
    want = {f"10.1/{k}": m for k, x in enumerate(damaged) if (m := model(x))}
    assert len(want) > 50 and sum(got.get(k) == m for k, m in want.items()) > 0.9 * len(want)


def test_articles_need_no_python(spark):
    plan = providers.articles(answers(spark, *XML))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert len(articles.ELEMENTS) == 13


def test_years_may_be_numbers_or_texts(spark):
    for parse, key in ((providers.works, "publication_year"), (providers.papers, "year")):
        bodies = [json.dumps({key: v}) for v in (2001, "2001", None, [2001], {"a": 1}, 2001.5)] + ["{}"]
        assert column(parse(answers(spark, *bodies)), "issued") == {"0": "2001", "1": "2001", "2": "", "3": "", "4": "", "5": "2001.5", "6": ""}
    dates = [{"date-parts": [[2001, 2]]}, {"date-parts": [["2001"]]}, {"date-parts": []}, {"date-parts": [None]}, {"date-parts": "x"}, "1999", 1999, None]
    bodies = [json.dumps({"issued": d}) for d in dates]
    assert list(column(providers.csl(answers(spark, *bodies)), "issued").values()) == ["2001", "2001", "", "", "", "1999", "1999", ""]
    assert list(column(providers.csl(answers(spark, *bodies), compat=True), "issued").values()) == ["2001", "2001", "", "", "", "", "", ""]


def test_titles_and_authors_may_be_texts_or_lists(spark):
    bodies = [json.dumps({"title": t, "container-title": t}) for t in ("T", ["T", "U"], [], None, 7, {"a": 1})]
    for name in ("title", "container-title"):
        assert list(column(providers.csl(answers(spark, *bodies)), name).values()) == ["T", "T", None, None, "7", None]
    people = [[{"family": "A", "given": "B"}, "C D", {"literal": "Group"}, {"given": "E"}, {}, None, ["x"]], "A, B", [], None]
    assert list(column(providers.csl(answers(spark, *[json.dumps({"author": p}) for p in people])), "author").values()) == ["A, B; C D; Group; E", "A, B", None, None]


def test_references_may_be_records_or_texts(spark):
    refs = [[{"unstructured": " 1. <b>u</b> "}, {"DOI": "d"}, "2) plain", "None", {"key": "k"}, 5, None], "a; b", [], None]
    got = list(column(providers.csl(answers(spark, *[json.dumps({"reference": r}) for r in refs])), "reference").values())
    assert got == ["u; d; plain; {}; 5", "a; b", None, None]


@pytest.mark.parametrize("parse", [providers.csl, providers.works, providers.papers, providers.citation_list])
def test_bodies_that_are_no_objects_give_no_row(spark, parse):
    assert parse(answers(spark, None, "", "no json", "[1]", '"text"', "null", "{")).count() == 0
    assert parse(answers(spark, "{}", status=500)).count() == 0


def test_an_article_is_parsed_once(spark):
    """Its attributes are read from the first element's start tag alone, whatever stands before or in it, and as XML reads them."""
    xml = (
        """<article article-type='a&gt;"b"' note="x > y / z"\n xml:lang = "d&#101;"><kwd xml:lang="no">k</kwd></article>""", "<?xml version='1.0'?><!-- <article xml:lang='no'> --><article xml:lang='en'/>",
        "<article><kwd xml:lang='no' article-type='no'>k</kwd></article>", "<article lang='no' x:lang='no' article-type=' a\nb '><kwd>k</kwd></article>", "<article note='xml:lang=en'><kwd>k</kwd></article>", "no <!-- <a> --> <?p <b>?> <article xml:lang='fr'><kwd>k</kwd></article>",
    )
    made = providers.articles(answers(spark, *xml))
    got = {(r["language"], r["document-type"], r["keywords"]) for r in made.collect()}
    assert got == {("de", 'a>"b"', "k"), ("en", None, None), (None, None, "k"), (None, " a b ", "k"), ("fr", None, "k")}
    long = answers(spark, "<article xml:lang='en'><abstract>" + "a " * 5000 + "</abstract></article>", "text", "<article>")
    assert column(long.withColumn("tag", articles.root_tag(articles.wrapped(F.col("body")))), "tag") == {"0": "<article xml:lang='en'/>", "1": None, "2": None}
