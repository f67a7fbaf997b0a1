"""Cited references: resolved, cleaned and joined again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import citation, clean_citation, strip_ws, work_id
from .skew import join_one


def citations(works: DataFrame) -> DataFrame:
    """work_id and citation, once for each id; works: work_id, authors (array), title, journal, volume, year."""
    made = works.select("work_id", citation(F.col("authors"), F.col("title"), F.col("journal"), F.col("volume"), F.col("year")).alias("citation"))
    return made.where("citation is not null").groupBy("work_id").agg(F.min("citation").alias("citation"))


def reference_text(ref: Column) -> Column:
    """The text of a reference record (unstructured, DOI, ...): the first of these that isn't empty, else all of it as JSON."""
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", strip_ws(c))
    return F.coalesce(filled(ref["unstructured"]), filled(ref["DOI"]), F.to_json(ref))


def reference_value(value: Column) -> Column:
    """A reference that is neither a list nor a text: its text, cleaned."""
    return clean_citation(value.cast("string"))


def split_references(value: Column) -> Column:
    """Parts of a list in one text, between semicolons; none and empty parts are left out."""
    parts = F.transform(F.split(value, ";"), strip_ws)
    return F.filter(parts, lambda p: ~F.lower(p).isin("", "none"))


def resolve(rows: DataFrame, refs: Column, works: DataFrame, key: str = "rec_id") -> DataFrame:
    """key and references: each row's references in order, ids of works replaced by their citations (dropped where unknown), others
    cleaned, joined by '; '. Rows without references get ''; rows with one key are one. An empty table gives no rows.

    Citations are made of the works that are referred to, not of all; the references of a work that very many refer to are split among
    tasks."""
    each = rows.select(key, F.posexplode_outer(refs).alias("pos", "ref")).withColumn("work_id", work_id(F.col("ref")))
    wanted = each.where("work_id is not null").select("work_id").distinct()
    found = join_one(each, citations(works.join(wanted, "work_id", "left_semi")), "work_id", "left")
    found = found.withColumn("text", F.when(F.col("work_id").isNotNull(), F.col("citation")).otherwise(clean_citation(F.col("ref"))))
    ordered = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text"))))
    return found.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "; ").alias("references"))
