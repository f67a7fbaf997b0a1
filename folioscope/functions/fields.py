"""Scalar functions of bibliographic fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS

RESOLVER = "https://openalex.org/"


def strip_ws(c: Column) -> Column:
    """Without white space of any kind at both ends (trim takes blanks only)."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def is_missing(c: Column) -> Column:
    """Null, blank or the word none. Long texts are told by their begin: nothing is stripped or copied."""
    return c.isNull() | c.rlike(f"^{WS}*(?:(?i:none){WS}*)?\\z")


def usable(c: Column) -> Column:
    return ~is_missing(c)


def clean_citation(c: Column) -> Column:
    """Without markup and without one leading number with its point or bracket."""
    return strip_ws(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), f"^{WS}*[0-9]+[).]{WS}*", ""))


def first_of_list(c: Column) -> Column:
    return F.coalesce(F.get(c, F.lit(0)), F.lit(""))


def authors(c: Column) -> Column:
    """An array of (family, given, literal): 'family, given' without commas and blanks at the ends, or the literal; joined by '; '."""
    name = lambda x: F.coalesce(x["literal"], F.btrim(F.concat(F.coalesce(x["family"], F.lit("")), F.lit(", "), F.coalesce(x["given"], F.lit(""))), F.lit(", ")))
    return F.array_join(F.filter(F.transform(c, name), lambda z: z != ""), "; ")


def issued_year(parts: Column, scalar: Column | None = None, compat: bool = False) -> Column:
    """The first number of date parts; a plain year where there are none (compat: nothing then)."""
    nested = F.get(F.get(parts, F.lit(0)), F.lit(0)).cast("string")
    return F.coalesce(nested, *([scalar.cast("string")] if scalar is not None and not compat else []), F.lit(""))


def begin_page(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("-")), strip_ws(F.split_part(c, F.lit("-"), F.lit(1)))).otherwise(c)


def end_page(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("-")), strip_ws(F.split_part(c, F.lit("-"), F.lit(2)))).otherwise(F.lit(""))


def issn(c: Column) -> Column:
    return F.array_join(c, ", ")


def is_work_id(c: Column) -> Column:
    return c.rlike("^W[0-9]+$")


def work_id(c: Column) -> Column:
    """The work id that a reference names, by itself or behind the resolver's address; null for other references."""
    return F.when(is_work_id(c), c).when(F.startswith(c, F.lit(RESOLVER)), strip_ws(F.replace(c, F.lit(RESOLVER), F.lit(""))))


def citation(author_names: Column, title: Column, journal: Column, volume: Column, year: Column) -> Column:
    """Authors, title, JOURNAL, volume, (year); empty parts are left out. Null without a title."""
    blank = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    text = F.concat_ws(", ", blank(F.upper(F.array_join(author_names, ", "))), blank(title), blank(F.upper(journal)), blank(volume), F.when(blank(year).isNotNull(), F.concat(F.lit("("), year, F.lit(")"))))
    return F.when(title.isNotNull(), clean_citation(text))


def is_number(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def normal_doi(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip_ws(c)), "^https?://(dx\\.)?doi\\.org/", "")
