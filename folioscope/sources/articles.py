"""Fields of article XML, by Spark's XML functions.

An article is checked once by `from_xml`, which leaves out what isn't well-formed, and its text nodes are listed once, in order, by `xpath`. So that it
is seen in that list where an element begins and ends, a mark with its name is put behind each begin and before each end of the elements that
are looked for. What the first element of a name holds, or each of them, is then cut out of the joined text nodes by regular expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fields import strip_ws

#: Elements that fields come from, and which of their text nodes are read.
ELEMENTS = ("article-title", "journal-title", "pub-date", "year", "abstract", "name", "surname", "given-names", "aff", "kwd", "corresp", "ref", "pub-id")
NODES = " | ".join((
    "//article-title//text()", "//journal-title//text()", "//pub-date//text()", "//abstract//text()", "//contrib[@contrib-type='author']/name//text()", "//aff//text()", "//kwd//text()", "//corresp//text()", "//ref/text()",
    "//ref//pub-id[@pub-id-type='doi']//text()",
))
#: Private characters around the name of an element that begins, and of one that ends.
_BEGIN, _NAMED, _END, _ENDED = "\ue000", "\ue001", "\ue002", "\ue003"
_MARK = f"{_BEGIN}[^{_NAMED}]*{_NAMED}|{_END}[^{_ENDED}]*{_ENDED}"
_WRAP, _INNER, _LAST = "folioscope-article", "folioscope-inner", "folioscope-last"
_ENTITY = "&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);)"
#: Characters that XML doesn't have, as they are and by number: two patterns, each of which is searched for fast, unlike their alternation.
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"
_CONTROL_REFERENCE = r"&#0*(?:[0-8]|1[124-9]|2\d|3[01]);|&#x0*(?:[0-8bcBCe-fE-F]|1[0-9a-fA-F]);"


def wrapped(body: Column) -> Column:
    """The article with marks in elements of our own, without what comes before its first element; null if that isn't well-formed, or
    refers to entities other than those of XML itself, since document types aren't read."""
    own = body
    for mark in (_BEGIN, _NAMED, _END, _ENDED):  # a search of bytes each, much cheaper than `translate`, which looks up each character
        own = F.replace(own, F.lit(mark), F.lit(""))
    bare = F.regexp_replace(own, r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>\[]*(?:\[.*?\]\s*)?>\s*)*", "")
    # character data sections become plain text, which is how their text nodes are listed
    escape = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    at = lambda x: F.instr(x, "]]>")
    part = lambda x, k: F.when(k == 0, x).when(at(x) == 0, F.concat(F.lit("<![CDATA["), x)).otherwise(F.concat(escape(F.substring(x, F.lit(1), at(x) - 1)), F.substring(x, at(x) + 3, F.length(x))))
    joined = lambda x: F.array_join(F.transform(F.split(x, r"<!\[CDATA\["), part), "")
    plain = _once(bare, lambda x: F.when(F.contains(x, F.lit("<![CDATA[")), joined(x)).otherwise(x))
    names = "|".join(ELEMENTS)
    plain = F.regexp_replace(plain, rf"<({names})((?:\s[^<>]*)?)/>", "<$1$2></$1>")
    begun = F.regexp_replace(plain, rf"(<({names})(?:\s[^<>]*)?>)", f"$1{_BEGIN}$2{_NAMED}")
    ended = F.regexp_replace(begun, rf"(</({names})\s*>)", f"{_END}$2{_ENDED}$1")
    # the last element is only read if everything before it could be, but for the name in the end tag next to it
    whole = F.concat(F.lit(f"<{_WRAP}><{_INNER}>"), ended, F.lit(f"</{_INNER}><{_LAST}>1</{_LAST}></{_WRAP}>"))

    def checked(x: Column) -> Column:
        foreign = F.when(F.contains(x, F.lit("<!--")), F.regexp_replace(x, "(?s)<!--.*?-->", "")).otherwise(x).rlike(_ENTITY)
        read = F.from_xml(x, f"struct<`{_LAST}`:string>", {"mode": "PERMISSIVE", "rowTag": _WRAP})[_LAST]
        return F.when(~foreign & ~x.rlike(_CONTROL) & ~(F.contains(x, F.lit("&#")) & x.rlike(_CONTROL_REFERENCE)) & (read == "1"), x)

    return _once(whole, checked)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once, however often it is used and under whatever conditions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _between(name: str) -> str:
    return f"(?s){_BEGIN}{name}{_NAMED}(.*?){_END}{name}{_ENDED}"


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, _MARK, "")


def _first(text: Column, name: str) -> Column:
    """What the first element of a name holds, with marks; '' if there is none."""
    return F.regexp_extract(text, _between(name), 1)


def _each(text: Column, name: str) -> Column:
    return F.regexp_extract_all(text, F.lit(_between(name)), F.lit(1))


def _joined(values: Column) -> Column:
    return F.array_join(F.filter(values, lambda x: F.coalesce(x, F.lit("")) != ""), "; ")


def _author(name: Column) -> Column:
    # given names that are there but empty leave their comma
    given = F.when(F.contains(name, F.lit(f"{_BEGIN}given-names{_NAMED}")), F.concat(F.lit(", "), _plain(_first(name, "given-names"))))
    return F.concat(_plain(_first(name, "surname")), F.coalesce(given, F.lit("")))


def root_tag(xml: Column) -> Column:
    """The first element's start tag alone, as an element, so that its attributes are read without the article; null if there is no element."""
    attributes = r"""(?:\s+[^\s=>]+\s*=\s*(?:"[^"]*"|'[^']*'))*"""
    tag = F.regexp_extract(xml, rf"(?s)^<{_WRAP}><{_INNER}>[^<]*(?:<(?:!--.*?--|\?.*?\?)>[^<]*)*(<[^\s/>!?][^\s/>]*{attributes})", 1)
    return F.concat(F.nullif(tag, F.lit("")), F.lit("/>"))


def fields(tag: Column, nodes: Column) -> dict[str, Column]:
    """Canonical keys of an article, '' where there is nothing. tag: its `root_tag`; nodes: its text nodes, joined."""
    attribute = lambda name: F.coalesce(F.when(F.contains(tag, F.lit(name)), F.xpath_string(tag, F.lit(f"/*/@*[name()='{name}']"))), F.lit(""))
    whole = lambda name: strip_ws(_plain(_first(nodes, name)))
    every = lambda name: _joined(F.transform(_each(nodes, name), lambda x: strip_ws(_plain(x))))
    return {
        "title": whole("article-title"), "container-title": whole("journal-title"), "language": attribute("xml:lang"), "issued": _plain(_first(_first(nodes, "pub-date"), "year")), "abstract": whole("abstract"),
        "author": _joined(F.transform(_each(nodes, "name"), _author)), "affiliation": every("aff"), "keywords": every("kwd"), "corresponding-author": whole("corresp"), "document-type": attribute("article-type"),
        "reference": _joined(F.transform(_each(nodes, "ref"), lambda x: strip_ws(_plain(_first(x, "pub-id"))))),
    }


def text_nodes(xml: Column) -> Column:
    return F.array_join(F.xpath(xml, F.lit(NODES)), "")
