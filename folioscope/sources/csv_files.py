"""CSV exports as one table by column name, read in blocks.

A line end inside quotes doesn't end a record, so where a block of a file begins it isn't known whether it begins inside quotes. Each line is
a function of that: what it leaves behind if it begins outside, and if it begins inside. Functions are combined within each block, blocks'
functions within each file, of which there is a row a block; then each line knows how it begins. Large files are thus read by many tasks.

Quotes follow the usual rules: a field is quoted if a quote is its first character; two quotes inside it stand for one; other quotes are
characters. Lines end with \\n or \\r\\n.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written

#: Files of different first records that a folder may have; their names of columns come to the driver.
MAX_HEADERS = 10_000
#: Rows of the tables of files and of blocks that are broadcast.
BROADCAST_FILES = 100_000
#: Where a line stands: before a field, in a plain field (or behind a quoted one), in a quoted field, behind a quote in a quoted field.
START, PLAIN, QUOTED, QUOTE = range(4)
#: The parser loses NUL in quoted values, so it gets MARK and 0 for NUL, MARK and 1 for MARK. A value that is MARK alone is thus no text.
MARK, NUL = "\x01", "\x00"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where its part of the file begins), line_no (ascending within the block) and line, without \\n but with \\r; written."""
    lines = spark.read.option("lineSep", "\n").text(path)
    numbered = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return written(numbered, "lines")


def ends_inside(line: Column, begins_inside: bool) -> Column:
    """Whether a line leaves a quoted field open: its parts between quotes are taken one by one."""
    parts = F.split(line, '"')

    def text(state: Column, part: Column) -> Column:
        behind = F.when(F.endswith(part, F.lit(",")), START).otherwise(PLAIN)
        return F.when((part == "") | (state == QUOTED), state).otherwise(behind)

    def step(state: Column, part: Column) -> Column:
        quoted = F.when(state == START, QUOTED).when(state == QUOTED, QUOTE).when(state == QUOTE, QUOTED).otherwise(PLAIN)
        return text(quoted, part)

    first = text(F.lit(QUOTED if begins_inside else START), F.get(parts, F.lit(0)))
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), first, step) == QUOTED


def _combined(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Add what comes of the functions before each row, and with its own: `known`, the state if that doesn't depend on the begin of the group,
    else null, and `turned`, whether the begin's state is turned. Functions: `fixed` (the state that is left behind, whatever the begin) or
    null, and then `turn` (whether they turn the state)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turns = rows.withColumn("turns", F.sum(F.coalesce(F.col("turn").cast("int"), F.lit(0))).over(w))
    last = F.when(F.col("fixed").isNotNull(), F.struct("fixed", F.col("turns").alias("at")))
    found = turns.withColumn("last", last).withColumn("last_before", F.last("last", True).over(before)).withColumn("last", F.coalesce("last", "last_before"))
    found = found.withColumn("turns_before", F.col("turns") - F.coalesce(F.col("turn").cast("int"), F.lit(0)))
    state = lambda at, n: F.when(F.col(at).isNotNull(), (F.col(f"{at}.fixed").cast("int") + F.col(n) - F.col(f"{at}.at")) % 2 == 1)
    odd = lambda n: F.col(n) % 2 == 1
    found = found.withColumn("known_after", state("last", "turns")).withColumn("turned_after", odd("turns")).withColumn("known", state("last_before", "turns_before")).withColumn("turned", odd("turns_before"))
    return found.drop("turns", "turns_before", "last", "last_before")


def whole_records(lines: DataFrame) -> DataFrame:
    """file, place (block and line_no of its first line) and text of each record that isn't blank; lines: file, block, line_no, line."""
    out, in_ = ends_inside(F.col("line"), False), ends_inside(F.col("line"), True)
    rows = lines.withColumn("out_", out).withColumn("in_", in_).withColumn("fixed", F.when(F.col("out_") == F.col("in_"), F.col("out_"))).withColumn("turn", (F.col("out_") != F.col("in_")) & F.col("out_"))
    rows = _combined(rows, ["file", "block"], "line_no").withColumn("of_block", F.struct("known_after", "turned_after"))
    # a row for each block, so that these windows are small
    blocks = rows.groupBy("file", "block").agg(F.max_by("of_block", "line_no").alias("f")).select("file", "block", F.col("f.known_after").alias("fixed"), (F.col("f.known_after").isNull() & F.col("f.turned_after")).alias("turn"))
    begins = _combined(blocks, ["file"], "block").select("file", "block", F.coalesce("known", "turned").alias("begins"))
    placed = rows.join(begins, ["file", "block"])
    inside = F.coalesce("known", F.when(F.col("turned"), ~F.col("begins")).otherwise(F.col("begins")))
    placed = placed.select("file", "block", "line_no", "line", inside.alias("inside"), F.when(inside, F.col("in_")).otherwise(F.col("out_")).alias("open"))
    stripped = F.regexp_replace("line", "\\r$", "")
    place = F.struct("block", "line_no")
    # written before it is used twice, with each line's begin of its record within the block, so that lines are shuffled once for both
    own = F.max(F.when(~F.col("inside"), place)).over(Window.partitionBy("file", "block").orderBy("line_no"))
    placed = written(placed.withColumn("own", own), "parts")
    alone = placed.where(~F.col("inside") & ~F.col("open")).select("file", place.alias("place"), stripped.alias("text"))
    # only lines of records of several lines are put together
    parts = placed.where(F.col("inside") | F.col("open"))
    firsts = parts.groupBy("file", "block").agg(F.max("own").alias("start"))
    carried = firsts.select("file", "block", F.max("start").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    carried = written(carried, "carried")
    joined = parts.join(F.broadcast(carried) if carried.count() <= BROADCAST_FILES else carried, ["file", "block"]).select("file", F.coalesce("own", "carried").alias("place"), F.struct(place.alias("at"), "line").alias("part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["line"]), "\n")
    several = joined.groupBy("file", "place").agg(F.regexp_replace(text, "\\r$", "").alias("text"))
    return alone.unionAll(several).where(F.trim("text") != "")


def column_names(header: str) -> list[str]:
    """Names in a file's first record; one that is used again gets a number, an empty one its place."""
    names: list[str] = []
    for k, name in enumerate(next(csv.reader([header.removeprefix("﻿")]), [])):
        name, n = name or f"_c{k}", 0
        while (name if not n else f"{name}.{n}").lower() in {x.lower() for x in names}:
            n += 1
        names.append(name if not n else f"{name}.{n}")
    return names


def _marked(text: Column) -> Column:
    marked = F.replace(F.replace(text, F.lit(MARK), F.lit(MARK + "1")), F.lit(NUL), F.lit(MARK + "0"))
    return F.when(F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(NUL)), marked).otherwise(text)


def _unmarked(value: Column) -> Column:
    plain = F.replace(F.replace(value, F.lit(MARK + "0"), F.lit(NUL)), F.lit(MARK + "1"), F.lit(MARK))
    return F.when(F.contains(value, F.lit(MARK)), plain).otherwise(value)


def read_csv(spark: SparkSession, path: str, ragged: str = "drop", keep_empty: bool = False) -> DataFrame:
    """All rows of the CSV files of a folder, all columns as text, by name.

    Columns come in the order of their first file; what a file doesn't have is null. Names that differ in case only are one column. Empty
    values, quoted or not, are null; with keep_empty, quoted ones are empty texts, as Spark writes them. Missing fields at a row's end are null;
    fields beyond the header's are left out, or, with ragged="error", end the job if they aren't empty. Blank records are left out; a file
    without any record has no columns, a folder without one gives an error. Rows may repeat."""
    if ragged not in ("drop", "error"):
        raise ValueError("ragged is drop or error")
    records = written(whole_records(lines_of(spark, path)), "csv-records")
    firsts = written(records.groupBy("file").agg(F.min("place").alias("first"), F.min_by("text", "place").alias("header")), "csv-files")  # a row a file
    found = firsts.groupBy("header").agg(F.min("file").alias("file")).orderBy("file").limit(MAX_HEADERS + 1).collect()
    if not found:
        raise ValueError(f"no CSV records in {path}")
    if len(found) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different first records in {path}")
    headers = {r["header"]: column_names(r["header"]) for r in found}
    columns = list({name.lower(): name for names in reversed(headers.values()) for name in reversed(names)}.values())[::-1]
    order = {name.lower(): None for names in headers.values() for name in names}
    spelled = {c.lower(): c for c in columns}
    columns = [spelled[c] for c in order]
    places = [(h, len(names), [{n.lower(): k for k, n in enumerate(names)}.get(c.lower(), -1) for c in columns]) for h, names in headers.items()]
    files = firsts.join(F.broadcast(spark.createDataFrame(places, "header string, names int, places array<int>")), "header").select("file", "first", "names", "places")
    width = max(map(len, headers.values())) + (ragged == "error")
    schema = ", ".join(f"c{k} string" for k in range(width))
    rows = records.join(F.broadcast(files) if files.count() <= BROADCAST_FILES else files, "file").where(F.col("place") != F.col("first"))
    parsed = rows.select("file", "text", "names", "places", F.from_csv(_marked(F.col("text")), schema, {"escape": '"', "multiLine": "true", "nullValue": MARK}).alias("row"))
    fields = [_unmarked(F.col(f"row.c{k}")) for k in range(width)]
    v = F.array(*[x if keep_empty else F.nullif(x, F.lit("")) for x in fields])
    if ragged == "error":
        beyond = F.exists(F.slice(v, F.col("names") + 1, F.lit(width)), lambda x: F.coalesce(x, F.lit("")) != "")
        v = F.when(beyond, F.raise_error(F.concat(F.lit("more fields than columns in "), "file", F.lit(": "), F.substring("text", 1, 200))).cast("array<string>")).otherwise(v)
    values = parsed.select("places", v.alias("v"))
    return values.select(*[F.get("v", F.col("places")[k]).alias(c) for k, c in enumerate(columns)])
