"""Text filters, tokenisers and keyword classes as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..storage import file_text

WS = "[ \\t\\n\\x0B\\f\\r]"


@dataclass(frozen=True)
class FilterSpec:
    """How page text is cleaned before it is lower-cased: 'basic' keeps ASCII letters, digits and blanks; 'chars' deletes
    each character of a set; 'none' keeps everything."""

    mode: str = "none"
    chars: str = ""

    @classmethod
    def resolve(cls, basic: bool = False, file_text: str | None = None, manual: str | None = None) -> FilterSpec:
        """Basic comes before a file's characters, those before manual ones. Line ends never count as characters."""
        if basic:
            return cls("basic")
        chars = "".join(dict.fromkeys((file_text if file_text else manual or "").replace("\r", "").replace("\n", "")))
        return cls("chars", chars) if chars else cls()

    @classmethod
    def from_file(cls, path: str) -> FilterSpec:
        """Read once on the driver, from any storage that Spark reads."""
        return cls.resolve(file_text=file_text(path))

    def apply(self, text: Column) -> Column:
        if self.mode == "basic":
            return F.regexp_replace(text, "[^a-zA-Z0-9 ]", "")
        if self.mode == "chars" and self.chars:
            return F.translate(text, self.chars, "")
        return text

    def clean(self, text: Column) -> Column:
        return F.lower(self.apply(text))


def hit_count(text: Column, keyword: Column | str, regex: bool = True, unicode_ws: bool = False) -> Column:
    """Matches of white space, keyword, white space; each match uses up its white space. The keyword is a regular expression unless regex is False."""
    keyword = F.lit(keyword) if isinstance(keyword, str) else keyword
    inner = keyword if regex else F.concat(F.lit("\\Q"), F.replace(keyword, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.regexp_count(text, F.concat(F.lit("(?U)\\s" if unicode_ws else "\\s"), inner, F.lit("\\s")))


def keyword_class(keyword: str) -> str:
    """'hyphenated', 'phrase' (several words) or 'plain'."""
    return "hyphenated" if "-" in keyword else "phrase" if " " in keyword else "plain"


def tokens_dash_blank(text: Column) -> Column:
    """Pieces between single hyphens and blanks; line ends stay inside, empty pieces are kept."""
    return F.split(text, "[- ]")


def tokens_ws(text: Column) -> Column:
    """Pieces between runs of white space, without empty ones."""
    return F.filter(F.split(text, f"{WS}+"), lambda x: x != "")


def collapse_phrase(tokens: Column, phrase: Column | str) -> Column:
    """Tokens with each run of the phrase's words, left to right and not overlapping, made one token."""
    words = tokens_ws(phrase) if isinstance(phrase, Column) else F.array(*map(F.lit, phrase.split()))
    mark = lambda x: F.concat(F.lit("\x01"), x, F.lit("\x01"))
    marked = F.array_join(F.transform(tokens, mark), "")
    joined = F.replace(marked, F.array_join(F.transform(words, mark), ""), mark(F.array_join(words, " ")))
    return F.when(F.size(tokens) == 0, tokens).otherwise(F.split(F.substring(joined, F.lit(2), F.length(joined) - 2), "\x01\x01"))


def keyword_tokens(text: Column, keyword: str) -> Column:
    kind = keyword_class(keyword)
    if kind == "hyphenated":
        return tokens_ws(text)
    return collapse_phrase(tokens_dash_blank(text), keyword) if kind == "phrase" else tokens_dash_blank(text)


def half_window(length: int) -> int:
    """Half the context length, halves to even."""
    return round(length / 2)


def context_slice(tokens: Column, at: Column, half: int, compat: bool = False) -> Column:
    """half tokens before position `at` (from 0), the token, and half - 1 after it, joined by blanks.

    compat: a start before the first token counts from the end, as a negative index does, instead of being moved to 0."""
    n, start = F.size(tokens), at - half
    first = F.when(start < 0, F.greatest(n + start, F.lit(0))).otherwise(start) if compat else F.greatest(start, F.lit(0))
    before = F.slice(tokens, (first + 1).cast("int"), F.greatest(at - first, F.lit(0)).cast("int"))
    after = F.slice(tokens, (at + 1).cast("int"), F.lit(half))
    return F.array_join(F.concat(before, after), " ")


def percent_label(part: Column, total: Column) -> Column:
    """'p.pp% (n)': hundredths of per cent rounded half up on whole numbers."""
    h = F.floor((part * 20000 + total) / (total * 2)).cast("long")
    return F.concat(F.floor(h / 100).cast("string"), F.lit("."), F.lpad((h % 100).cast("string"), 2, "0"), F.lit("% ("), part.cast("string"), F.lit(")"))
