"""Language identification by bit-sliced Bloom filters of n-grams.

Each slot of the filter is a bitmask of languages: asking for an n-gram ANDs the masks of its slots and so returns, in
one look-up, every language whose filter may contain it. A document's per-language popcounts over all its n-grams are
corrected for each language's false-positive rate; the language with the largest corrected share wins.

The filters are fitted on labelled rows, about `fit_rows` of them, chosen by a hash of doc_id (a documented bound on the fit;
every document is then predicted from its whole text), but of each language about LEAST_ROWS, or all where it has fewer, so
each label is learned. A filter's size is fixed by `slots`; one holds 64 languages, and further ones get filters of their own.
More than MOST_LANGUAGES labels are an error.

Text is lower-cased; runs of anything but letters become one blank; n-grams are of bytes, within words and over their
edges. Nulls: a null text, or one without letters, is `und` with score 0; rows with a null text or label teach nothing.
Equal texts get equal predictions. With no usable labels every text is `und`. An empty table gives no rows. Columns other
than those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, mix64, table

N, SLOTS, HASHES, FIT_ROWS, MIN_DOCS = 5, 1 << 22, 2, 20_000, 3
#: Rows that each language is fitted on, if it has them; languages (64 take up to 32 MB on the driver and in each worker).
LEAST_ROWS, MOST_LANGUAGES = 300, 256
#: Bytes of text that are looked up at a time.
PIECE = 1 << 19
_OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Filters:
    languages: tuple[str, ...]
    planes: np.ndarray  # one mask of languages for each slot
    false_rate: np.ndarray  # of each language
    n: int = N
    more: tuple[Filters, ...] = ()  # of further languages

    @property
    def names(self) -> tuple[str, ...]:
        return sum((f.languages for f in self.more), self.languages)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        found = None
        for s in slots_of(grams, len(self.planes)):
            found = self.planes[s] if found is None else found & self.planes[s]
        return found


def normal(text: str | None) -> bytes:
    """Letters in lower case, everything else one blank; b'' if there is no letter."""
    plain = _OTHER.sub(" ", text.lower()).strip() if text else ""
    if not plain.isascii() and not any(map(str.isalpha, plain)):  # what is left may be numerals of other scripts
        return b""
    return f" {plain} ".encode() if plain else b""


def grams_of(data: bytes, n: int = N) -> np.ndarray:
    """All n-grams of bytes as integers, in order; those over the joint of two documents included."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(b) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(b) - n + 1, np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | b[k : k + len(out)]
    return out


def slots_of(grams: np.ndarray, slots: int) -> list[np.ndarray]:
    h = mix64(grams)
    return [((h >> np.uint64(32 * k)) & np.uint64(slots - 1)).astype(np.int64) for k in range(HASHES)]


def _distinct(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                each = [np.unique(grams_of(normal(t), n)) for x, t in zip(langs, texts) if x == lang]
                grams, docs = np.unique(np.concatenate(each), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(docs.astype(np.int64))], ["lang", "gram", "docs"])

    return run


def fit(labelled: DataFrame, n: int = N, slots: int = SLOTS, fit_rows: int = FIT_ROWS, min_docs: int = MIN_DOCS, id_col: str = "doc_id") -> Filters:
    """Filters of the n-grams that occur in at least min_docs of a language's rows (1 where a language has fewer than 10 * min_docs)."""
    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    found = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1)
    counts = {r["lang"]: r["n"] for r in found.collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    total = sum(counts.values())
    if not total:
        return Filters((), np.zeros(2, np.uint64), np.zeros(0), n)
    share = {x: min(1.0, max(fit_rows / total, LEAST_ROWS / c)) for x, c in counts.items()}
    languages = sorted(counts, key=lambda x: (-counts[x], x))  # ties go to the more frequent
    parts = [_fit_part(usable, tuple(languages[k : k + 64]), counts, share, n, slots, min_docs, id_col) for k in range(0, len(languages), 64)]
    return replace(parts[0], more=tuple(parts[1:]))


def _fit_part(usable: DataFrame, languages: tuple[str, ...], counts: dict[str, int], share: dict[str, float], n: int, slots: int, min_docs: int, id_col: str) -> Filters:
    """Filters of at most 64 languages, fitted on the given share of each one's rows."""
    of = lambda value: F.coalesce(*[F.when(F.col("lang") == x, F.lit(value(x))) for x in languages])
    sample = usable.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < of(lambda x: int(share[x] * (1 << 20)) + 1)).select("lang", "text")
    least = of(lambda x: min_docs if counts[x] * share[x] >= 10 * min_docs else 1)
    grams = sample.mapInArrow(_distinct(n), "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    # each gram sets HASHES slots; masks are ORed by slot before they come to the driver, so at most `slots` rows do
    bit = F.coalesce(*[F.when(F.col("lang") == x, F.lit(1 << k if k < 63 else -(1 << 63))) for k, x in enumerate(languages)]).cast("long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = slots_of(batch.column("gram").to_numpy().view(np.uint64), slots)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.concat_arrays([batch.column("bit")] * len(found))], ["slot", "bit"])

    masks = grams.select("gram", bit.alias("bit")).mapInArrow(place, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("mask")).toArrow()
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(k).bits >= len(languages))
    planes = np.zeros(slots, kind)
    planes[masks["slot"].to_numpy()] = masks["mask"].to_numpy().astype(kind)
    fill = np.array([((planes >> kind(k)) & kind(1)).mean() for k in range(len(languages))])
    return Filters(languages, planes, fill**HASHES, n)


def _pieces(texts: list[bytes], n: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts in lots of at most about PIECE bytes; a longer text comes in overlapping pieces, which have each of its n-grams once."""
    at: list[int] = []
    own: list[bytes] = []
    size = 0
    for k, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - n + 1), PIECE):
            own.append(t[lo : lo + PIECE + n - 1])
            at.append(k)
            size += len(own[-1])
            if size >= PIECE:
                yield at, own
                at, own, size = [], [], 0
    if own:
        yield at, own


def shares(filters: Filters, texts: list[bytes]) -> np.ndarray:
    """For each text and language the share of the text's n-grams that the language contains, corrected for false positives."""
    n, languages = filters.n, len(filters.languages)
    hits, sizes = np.zeros((len(texts), languages)), np.zeros(len(texts))
    for at, own in _pieces(texts, n):
        counts = np.array([max(0, len(t) - n + 1) for t in own], np.int64)
        if not counts.sum():
            continue
        masks = filters.masks(grams_of(b"".join(own), n))
        starts = np.concatenate([[0], np.cumsum([len(t) for t in own])[:-1]])
        ok = counts > 0
        where = np.array(at)[ok]
        np.add.at(sizes, where, counts[ok])
        for k in range(languages):
            total = np.concatenate([[0], np.cumsum((masks >> masks.dtype.type(k)) & masks.dtype.type(1), dtype=np.int64)])
            np.add.at(hits[:, k], where, total[starts[ok] + counts[ok]] - total[starts[ok]])
    got = hits / np.maximum(sizes, 1)[:, None]
    own = np.where(sizes[:, None] > 0, np.clip((got - filters.false_rate) / np.maximum(1e-9, 1 - filters.false_rate), 0, 1), 0)
    return np.hstack([own, *(shares(f, texts) for f in filters.more)]) if filters.more else own


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        names = filters.names
        for batch in batches:
            texts = batch.column("text")
            for lo in range(0, len(texts), 256):
                plain = [normal(t) for t in texts.slice(lo, 256).to_pylist()]
                got = shares(filters, plain)
                best = got.argmax(axis=1) if names else np.zeros(len(plain), int)
                known = [bool(p) and bool(names) for p in plain]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, 256) for c in batch.schema.names if c != "text"), pa.array([names[b] if k else "und" for b, k in zip(best, known)], pa.string()), pa.array([float(got[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best, known))], pa.float64())],
                    [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score"],
                )

    return run


def identify(docs: DataFrame, filters: Filters, keep: list[Column] | None = None) -> DataFrame:
    """The kept columns (doc_id if none), lang_pred and score for each row; only `text` is read for the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # its size is fixed by `slots`
    rows = docs.select(*(keep or [F.col("doc_id")]), F.col("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_predict(shared), f"{schema}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 5) == 0
    return identify(docs, fit(docs.where(~held)), [F.col("doc_id"), held.alias("held_out")])
