"""Filling of missing fields from providers in order of priority, with a change log.

The first provider with a usable value wins each missing field. So offers are reduced to one row for each key - of each target field the
usable value of the smallest priority - and joined once.

Nulls: a record without a DOI, and a null lookup, match nothing; a null value is missing. DOIs are compared without white space at
their ends. Where a provider answered a key more than once, the smallest usable value of each field counts. Records that repeat are
filled each; an empty table gives no rows. Columns other than DI, rec_id and the targets are carried along, whatever their names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import begin_page, end_page, is_missing, strip_ws, usable
from ..storage import leaf_bytes
from .references import resolve, split_references

#: Bytes of the files that records and offers are made from, for a task of their join.
PARTITION_BYTES = 18_000_000


def same(value: Column) -> Column:
    return value


@dataclass(frozen=True)
class FieldRule:
    """How a canonical key of a provider's answer fills fields: a target and what makes its value from the key's."""

    key: str
    targets: tuple[tuple[str, Callable[[Column], Column]], ...]

    @classmethod
    def of(cls, key: str, *targets: str) -> FieldRule:
        """Targets get the value as it is; of two, the first gets what comes before a hyphen and the second what comes after."""
        made = (begin_page, end_page) if len(targets) == 2 else (same,) * len(targets)
        return cls(key, tuple(zip(targets, made)))


#: Target field of each canonical key of a provider's answer, in mapping order.
MAPPING = (
    FieldRule.of("DOI", "DI"), FieldRule.of("title", "TI"), FieldRule.of("container-title", "SO"), FieldRule.of("author", "AU"), FieldRule.of("issued", "PY"), FieldRule.of("volume", "VL"), FieldRule.of("issue", "IS"), FieldRule.of("page", "BP", "EP"),
    FieldRule.of("publisher", "PU"), FieldRule.of("abstract", "AB"), FieldRule.of("reference", "CR"), FieldRule.of("language", "LA"), FieldRule.of("affiliation", "C1"), FieldRule.of("keywords", "DE"), FieldRule.of("corresponding-author", "RP"), FieldRule.of("document-type", "DT"),
)
#: providers' labels in order of priority.
PROVIDERS = ("NIH-OCC", "PubMed", "PMC", "OpenAlex", "Crossref", "Semantic Scholar")


@dataclass(frozen=True)
class Enrichment:
    table: DataFrame
    changes: DataFrame  # rec_id, field, old_value, new_value, provider, prio, map_pos
    rules: tuple[FieldRule, ...] = field(default=MAPPING)


def first_usable(offers: DataFrame, rules: tuple[FieldRule, ...], parts: int = 0) -> DataFrame:
    """One row for each lookup key: of each target the usable value of the smallest priority as `value_` and its name, that priority as `prio_` and
    its name. They are columns of their own, so that what needs no values moves none. parts: as of `_parts`."""
    made = [(t, make(F.col(f"`{r.key}`").cast("string"))) for r in rules for t, make in r.targets]
    told = [c for t, v in made for c in (usable(v).alias(f"has_{t}"), F.when(usable(v), v).alias(f"value_{t}"))]
    rows = offers.select(strip_ws(F.col("lookup")).alias("lookup"), "prio", *told).where("lookup is not null")
    prios = [F.min(F.when(F.col(f"has_{t}"), F.col("prio"))).alias(f"prio_{t}") for t, _ in made]
    values = [F.min(F.when(F.col(f"has_{t}"), F.struct("prio", F.col(f"value_{t}").alias("value"))))["value"].alias(f"value_{t}") for t, _ in made]
    return _dealt(rows, F.col("lookup"), parts).groupBy("lookup").agg(*prios, *values)


def _parts(*tables: DataFrame) -> int:
    """Tasks for rows of tables of this size, where the session's number of shuffle partitions is too small for them; 0 where it isn't."""
    wanted = sum(map(leaf_bytes, tables)) // PARTITION_BYTES
    return wanted if wanted > int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0


def _dealt(rows: DataFrame, key: Column, parts: int) -> DataFrame:
    return rows.repartition(parts, key) if parts else rows


def _with_best(rows: DataFrame, best: DataFrame, gaps: list[str] | None = None, parts: int = 0) -> DataFrame:
    """row, rec (its rec_id), gap, lookup and best's columns of each row; gap: of each of the fields `gaps` that is missing, its value as `old`, null for others, told
    here so that texts which are there needn't be moved for it. best: as made of `first_usable`. Rows without a DOI get keys of their own
    that no stripped lookup is equal to, since nulls would all meet in one task."""
    doi = F.when(~is_missing(F.col("DI")), strip_ws(F.col("DI")))
    none = F.concat(F.lit(" "), F.monotonically_increasing_id().cast("string"))
    told = [F.when(is_missing(F.col(f"`{t}`")), F.struct(F.col(f"`{t}`").cast("string").alias("old"))).alias(t) for t in gaps or []]
    gap = [F.struct(*told).alias("gap")] if told else []
    keyed = rows.select(F.struct(*[f"`{c}`" for c in rows.columns]).alias("row"), F.col("rec_id").alias("rec"), *gap, F.coalesce(doi, none).alias("doi"))
    return _dealt(keyed, F.col("doi"), parts).join(best, F.col("doi") == F.col("lookup"), "left")


def resolve_offers(offers: DataFrame, works: DataFrame) -> DataFrame:
    """Offers with their references resolved: ids of works become citations, unknown ones are dropped, others cleaned."""
    own = [c for c in offers.columns if c != "reference"]
    listed = offers.where("reference is not null").select("lookup", "prio", "reference").distinct()
    rows = listed.select(F.struct("lookup", "prio", "reference").alias("offer"), split_references(F.col("reference")).alias("refs"))
    found = resolve(rows, F.col("refs"), works, "offer").select(F.col("offer.lookup").alias("_l"), F.col("offer.prio").alias("_p"), F.col("offer.reference").alias("_r"), F.col("references").alias("_found"))
    same_offer = F.col("lookup").eqNullSafe(F.col("_l")) & F.col("prio").eqNullSafe(F.col("_p")) & (F.col("reference") == F.col("_r"))
    return offers.join(found, same_offer, "left").select(*[f"`{c}`" for c in own], F.col("_found").alias("reference"))


def enrich(records: DataFrame, offers: DataFrame, rules: tuple[FieldRule, ...] = MAPPING, providers: tuple[str, ...] = PROVIDERS, works: DataFrame | None = None) -> Enrichment:
    """records: rec_id, DI and target columns; offers: prio (from 1), lookup (a DOI) and canonical keys; works: as `resolve` takes them,
    for ids among the references.

    Rows without a DOI are left as they are. A page pair's halves are filled each by itself."""
    rules = tuple(r for r in rules if r.key in offers.columns)
    if works is not None and "reference" in offers.columns:
        offers = resolve_offers(offers, works)
    offers = offers.where(F.col("prio").between(1, len(providers)))
    order = [t for r in rules for t, _ in r.targets]
    parts = _parts(records, offers)
    both = _with_best(records, first_usable(offers, rules, parts), order, parts)
    filled = lambda t: F.col(f"gap.`{t}`").isNotNull()
    won = F.array(*[F.struct(F.when(filled(t), F.col(f"prio_{t}")).alias("prio"), F.lit(k).alias("map_pos")) for k, t in enumerate(order)])
    log = both.select(F.col("rec").alias("rec_id"), "gap", *[f"value_{t}" for t in order], F.inline(F.filter(won, lambda x: x["prio"].isNotNull())))
    at = lambda values: F.coalesce(*[F.when(F.col("map_pos") == k, v) for k, v in enumerate(values)])
    old, new = at([F.col(f"gap.`{t}`.old") for t in order]), at([F.col(f"value_{t}") for t in order])
    labels = F.element_at(F.array(*map(F.lit, providers)), F.col("prio").cast("int"))
    changes = log.select("rec_id", F.element_at(F.array(*map(F.lit, order)), F.col("map_pos") + 1).alias("field"), old.alias("old_value"), new.alias("new_value"), labels.alias("provider"), "prio", "map_pos")
    table = both.select(*[F.coalesce(F.when(filled(c), F.col(f"value_{c}")), F.col(f"row.`{c}`")).alias(c) if c in order else F.col(f"row.`{c}`") for c in records.columns])
    return Enrichment(table, changes, rules)


#: What a row of the versioned change log has besides its version.
_CHANGE = ("old_value", "new_value", "provider", "prio", "map_pos")


def first_version(changes: DataFrame) -> DataFrame:
    """A change log as the first version of itself."""
    return changes.select("rec_id", "field", F.lit(1).alias("version"), *_CHANGE)


def latest(versions: DataFrame) -> DataFrame:
    """The change log that holds: of each record and field the row of the highest version. old_value is what the field had before any version."""
    found = versions.groupBy("rec_id", "field").agg(F.max_by(F.struct(*_CHANGE), "version").alias("x"))
    return found.select("rec_id", "field", *[f"x.{c}" for c in _CHANGE])


def enrich_again(table: DataFrame, versions: DataFrame, offers: DataFrame, rules: tuple[FieldRule, ...] = MAPPING, providers: tuple[str, ...] = PROVIDERS, works: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A filled table and its versioned change log, after more offers: the table, and the log with a version more of each field whose value
    changes. Both are as if all offers had been there from the start: an offer of a provider that comes before the one that filled a field takes its
    place, one that comes later doesn't, and a field that is still missing is filled.

    table: as `enrich` takes it, after earlier offers; versions: rec_id, field, version and the columns of a change log. Only the log is looked
    at for what was there before, so a field that a user has filled by hand since stays. rec_id must tell the rows of table apart; rows with a
    null one are filled as new and not logged against earlier versions. Without offers nothing changes."""
    rules = tuple(r for r in rules if r.key in offers.columns)
    if works is not None and "reference" in offers.columns:
        offers = resolve_offers(offers, works)
    order = [t for r in rules for t, _ in r.targets]
    parts = _parts(table, offers)
    best = first_usable(offers.where(F.col("prio").between(1, len(providers))), rules, parts)
    held = versions.groupBy("rec_id", "field").agg(F.max_by(F.struct("version", *_CHANGE), "version").alias("x"))
    known = held.groupBy(F.col("rec_id").alias("_rec")).agg(F.map_from_entries(F.collect_list(F.struct("field", "x"))).alias("known"))  # at most a row for each target
    rows = _dealt(_with_best(table, best, parts=parts), F.col("row.rec_id"), parts)
    rows = rows.join(known, F.col("row.rec_id") == F.col("_rec"), "left")
    now = {t: F.col(f"row.`{t}`") for t in order}
    was = {t: F.when(F.col("known")[t]["new_value"].eqNullSafe(now[t].cast("string")), F.col("known")[t]) for t in order}
    before = {t: F.when(was[t].isNotNull(), was[t]["old_value"]).otherwise(now[t].cast("string")) for t in order}
    offered = {t: F.when(is_missing(before[t]) & F.col(f"prio_{t}").isNotNull(), F.struct(F.col(f"prio_{t}").alias("prio"), F.col(f"value_{t}").alias("value"))) for t in order}
    wins = {t: offered[t].isNotNull() & (was[t].isNull() | (F.struct(offered[t]["prio"], offered[t]["value"]) < F.struct(was[t]["prio"].cast("int"), was[t]["new_value"]))) for t in order}
    labels = lambda prio: F.element_at(F.array(*map(F.lit, providers)), prio.cast("int"))
    change = lambda k, t: F.struct(F.lit(t).alias("field"), (F.coalesce(F.col("known")[t]["version"], F.lit(0)) + 1).alias("version"), before[t].alias("old_value"), offered[t]["value"].alias("new_value"), labels(offered[t]["prio"]).alias("provider"), offered[t]["prio"].alias("prio"), F.lit(k).alias("map_pos"), wins[t].alias("wins"))
    log = rows.select("row.rec_id", F.inline(F.filter(F.array(*[change(k, t) for k, t in enumerate(order)]), lambda x: x["wins"])))
    filled = rows.select(*[F.when(wins[c], offered[c]["value"]).otherwise(now[c]).alias(c) if c in now else F.col(f"row.`{c}`") for c in table.columns])
    return filled, versions.select("rec_id", "field", "version", *_CHANGE).unionByName(log.select("rec_id", "field", "version", *_CHANGE))


def column_counts(changes: DataFrame) -> DataFrame:
    """Edits of each field, and the first edit's place (row, provider, mapping), by which fields are listed."""
    return changes.groupBy("field").agg(F.count("*").alias("edits"), F.min(F.struct("rec_id", "prio", "map_pos")).alias("first_edit"))


def changed_rows(changes: DataFrame) -> DataFrame:
    return changes.agg(F.countDistinct("rec_id").alias("changed_rows"))


def changed_records(records: DataFrame, changes: DataFrame) -> DataFrame:
    return records.join(changes.select("rec_id"), "rec_id", "left_semi")


def unchanged_records(records: DataFrame, changes: DataFrame) -> DataFrame:
    return records.join(changes.select("rec_id"), "rec_id", "left_anti")


def skipped_count(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(is_missing(F.col("DI"))).alias("skipped"))


def change_lines(changes: DataFrame) -> DataFrame:
    """seq-ordered text of each change."""
    text = F.concat(F.lit("Row "), F.col("rec_id"), F.lit(" - "), F.col("field"), F.lit(" updated from '"), F.coalesce("old_value", F.lit("")), F.lit("' to '"), F.col("new_value"), F.lit("' via "), F.col("provider"), F.lit("."))
    return changes.select("rec_id", "prio", "map_pos", text.alias("line"))
