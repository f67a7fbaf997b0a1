"""Bibliographic records: union of sources, duplicates, columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fields import is_missing, normal_doi, strip_ws
from ..storage import written
from .components import connected
from .skew import join_one

#: Order of sources where records are the same.
SOURCE_ORDER = ("wos", "scopus", "pubmed")


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    """All rows, columns aligned by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_index(df: DataFrame, *order: str) -> DataFrame:
    """Add `index`, from 0 in the given order (rows equal in it in any order); a column of that name is replaced.

    Ranges are numbered each by itself and shifted by the rows before them. Range and place are written with the rows once, so that
    counting and shifting see the same ranges however the plan is adapted or a task repeated. An empty table gives no rows."""
    rows = df.drop("index")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.select(F.struct(*[f"`{c}`" for c in rows.columns]).alias("row"), F.monotonically_increasing_id().alias("id"))
    placed = written(numbered.select("row", F.shiftright("id", 33).alias("range"), F.col("id").bitwiseAND((1 << 33) - 1).alias("place")), "indexed")
    counts = placed.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "range", "left").select("row.*", (F.col("before") + F.col("place")).alias("index"))


def title_key(ti: Column, py: Column) -> Column:
    """The title's letters and digits of any script with the year; null where a title has neither letters nor digits."""
    title = F.upper(F.regexp_replace(ti, "[^\\p{L}\\p{M}\\p{N} ]", ""))
    return F.when(~is_missing(ti) & (F.trim(title) != ""), F.concat(F.lit("ti:"), title, F.lit("|"), F.coalesce(py, F.lit(""))))


def doi_key(di: Column) -> Column:
    return F.when(~is_missing(di), F.concat(F.lit("doi:"), normal_doi(di)))


def dedup_key(di: Column, ti: Column, py: Column) -> Column:
    """What makes records the same: the DOI; without one, the title's letters and digits of any script with the year. Null without
    either, or where a title has neither letters nor digits."""
    return F.coalesce(doi_key(di), title_key(ti, py))


def match_keys(ids: tuple[str, ...] = ()) -> Column:
    """All keys of a record: its DOI, its title with the year, and each of the columns `ids` that isn't missing."""
    own = [F.when(~is_missing(F.col(f"`{c}`").cast("string")), F.concat(F.lit(f"{c}:"), strip_ws(F.col(f"`{c}`").cast("string")))) for c in ids]
    return F.array_compact(F.array(doi_key(F.col("di")), title_key(F.col("ti"), F.col("py")), *own))


def _place(row: Column, order: tuple[str, ...]) -> Column:
    """By what the record that stays is chosen: source, rec_id, hash of the row."""
    rank = F.coalesce(*[F.when(F.col("db") == d, k) for k, d in enumerate(order)], F.lit(len(order)))
    return F.struct(rank.alias("rank"), F.col("rec_id").isNull().alias("no_id"), "rec_id", F.xxhash64(F.to_json(row)).alias("tie"))


def dedup(records: DataFrame, order: tuple[str, ...] = SOURCE_ORDER) -> DataFrame:
    """One record of each key: from the first source, then the lowest rec_id, then the least hash of the row. Records without a key all
    stay. A null db or rec_id comes last. An empty table gives no rows.

    The winner is carried through an aggregation, which combines before its only shuffle, so a key with very many rows is no hot spot."""
    row = F.struct(*[f"`{c}`" for c in records.columns])
    keyed = records.select(row.alias("row"), dedup_key(F.col("di"), F.col("ti"), F.col("py")).alias("key"), _place(row, order).alias("place"))
    first = keyed.where("key is not null").groupBy("key").agg(F.min_by("row", "place").alias("row"))
    return first.select("row.*").unionAll(keyed.where("key is null").select("row.*"))


def duplicate_classes(records: DataFrame, order: tuple[str, ...] = SOURCE_ORDER, ids: tuple[str, ...] = ()) -> DataFrame:
    """Every record with the class of records that it is one with, by any shared key, directly or by way of others: class_id (the smallest
    rec_id of the class), class_size and kept (true for one record of each class, chosen as in `dedup`).

    Keys are the DOI, the title with the year, and each of the columns `ids`, so that a work with and without DOI is one, and chains of records
    that share one key with the next are one. A record without a key is a class of its own. Records are matched by numbers of their own, so
    null and repeated rec_ids do no harm. Columns named as the new ones are replaced. An empty table gives no rows.

    A key's records are linked to the smallest of them only, so links are as many as keys of records; a key with very many records is split
    among tasks. Keys are matched by their SHA-256, and classes are found among numbers alone: rows are written once, and shuffled once, when
    they get their classes."""
    numbered, found = _classes(records, order, ids)
    return numbered.join(found.select("number", "class_id", "class_size", "kept"), "number").select("row.*", "class_id", "class_size", "kept")


def _classes(records: DataFrame, order: tuple[str, ...], ids: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """row and number of each record; and number, class_id, class_size and kept of each."""
    own = [c for c in records.columns if c not in ("class_id", "class_size", "kept")]
    row = F.struct(*[f"`{c}`" for c in own])
    keys = F.transform(match_keys(ids), lambda k: F.unhex(F.sha2(k.cast("binary"), 256)))
    numbered = written(records.select(row.alias("row"), F.monotonically_increasing_id().alias("number"), F.col("rec_id"), keys.alias("keys"), _place(row, order).alias("place")), "records")
    keyed = numbered.select("number", F.explode("keys").alias("key"))
    first = keyed.groupBy("key").agg(F.min("number").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    links = join_one(keyed, first, "key").select(F.col("number").alias("a"), F.col("first").alias("b"))
    classes = connected(links).select(F.col("node").alias("number"), F.col("component").alias("class"))
    placed = written(numbered.select("number", "rec_id", "place").join(classes, "number", "left").withColumn("class", F.coalesce("class", "number")), "classes")
    best = placed.groupBy("class").agg(F.min("rec_id").alias("class_id"), F.count("*").alias("class_size"), F.min_by("number", F.struct("place", "number")).alias("best"))
    found = join_one(placed.select("number", "class"), best, "class", "left").select("number", "class_id", "class_size", (F.col("number") == F.col("best")).alias("kept"))
    return numbered.select("row", "number"), found


def dedup_any(records: DataFrame, order: tuple[str, ...] = SOURCE_ORDER, ids: tuple[str, ...] = ()) -> DataFrame:
    """One record of each class of `duplicate_classes`."""
    numbered, found = _classes(records, order, ids)
    return numbered.join(found.where("kept").select("number"), "number").select("row.*").drop("class_id", "class_size", "kept")


def swap_reference_column(df: DataFrame) -> DataFrame:
    """CR_raw takes the place of CR; nothing happens to columns that aren't there."""
    return df.drop("CR").withColumnRenamed("CR_raw", "CR") if "CR_raw" in df.columns else df.drop("CR")


def ensure_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that are missing are added, empty."""
    have = {c.lower() for c in df.columns}
    new = {c: F.lit("") for c in columns if c.lower() not in have}
    return df.withColumns(new) if new else df
