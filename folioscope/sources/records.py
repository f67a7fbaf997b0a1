"""Exports of bibliographic databases as record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written
from .csv_files import lines_of, read_csv

#: Columns of a CSV export and the field tags that they become.
CSV_TAGS = {
    "DOI": "DI", "Title": "TI", "Source title": "SO", "Authors": "AU", "Year": "PY", "Volume": "VL", "Issue": "IS", "Page start": "BP", "Page end": "EP", "Publisher": "PU",
    "Abstract": "AB", "References": "CR", "Language of Original Document": "LA", "Affiliations": "C1", "Author Keywords": "DE", "Correspondence Address": "RP", "Document Type": "DT",
}
#: Tags of the second tagged-text format and the field tags that they become; others keep their names.
MEDLINE_TAGS = {"TI": "TI", "JT": "SO", "FAU": "AU", "DP": "PY", "VI": "VL", "IP": "IS", "PG": "BP", "AB": "AB", "LA": "LA", "AD": "C1", "OT": "DE", "PT": "DT", "LID": "DI", "PMID": "PMID"}
#: How lines of the two tagged formats look: tag and value of a tagged line, and the tag that begins a record.
FORMATS = {"plaintext": (r"(?s)^([A-Z][A-Z0-9])(?: (.*))?$", "PT", {}), "medline": (r"(?s)^([A-Z]{2,4}) *- (.*)$", "PMID", MEDLINE_TAGS)}
#: Tags of the first format of which each continued line is a value of its own.
LIST_TAGS = ("AU", "AF", "C1", "CR")


def csv_records(spark: SparkSession, path: str, tags: dict[str, str] | None = None, db: str = "scopus", ragged: str = "drop", keep_empty: bool = False) -> DataFrame:
    """Rows of all CSV files of a folder by column name, all as text, with field tags for names; see csv_files.read_csv. A name that is a
    tag already keeps its place, and a column whose tag is taken keeps its name. A column db of the files' own gives way to the database's name."""
    df = read_csv(spark, path, ragged, keep_empty)
    for old, new in (CSV_TAGS if tags is None else tags).items():
        if old in df.columns and new.lower() not in {c.lower() for c in df.columns if c != old}:
            df = df.withColumnRenamed(old, new)
    return df.withColumn("db", F.lit(db))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where its part of the file begins), line_no (ascending within the block) and line of text files.

    Large files are read in blocks, by a task each. The lines are written once, so that their numbers stay."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return written(lines, "lines")


def tagged_records(lines: DataFrame, kind: str = "plaintext", db: str = "wos", tags: list[str] | None = None) -> DataFrame:
    """A row for each record of tagged text: columns by tag, repeated values joined by '; ', continued ones by ' ', or by '; ' where each line of
    the tag is a value (authors, addresses, references).

    A record begins at its format's first tag; lines without a tag continue the value before; lines before the first record are left
    out. tags: the wanted columns (found by a job where not given). Blocks of a file are numbered each by itself; what a block begins in
    the middle of is told by the blocks before it, of which there is a row each. A null line counts as empty; no lines give no rows."""
    pattern, start, names = FORMATS[kind]
    order = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tag = F.regexp_extract("line", pattern, 1)
    rows = lines.where(F.trim("line") != "").select("file", "block", "line_no", F.when(tag != "", tag).alias("tag"), F.when(tag != "", F.regexp_extract("line", pattern, 2)).otherwise(F.trim("line")).alias("value"))
    place = F.struct("block", "line_no")
    marks = {"record": F.when(F.col("tag") == start, place), "entry": F.when(F.col("tag").isNotNull(), place)}
    blocks = rows.groupBy("file", "block").agg(*[F.max(m).alias(k) for k, m in marks.items()])
    carried = blocks.select(F.col("file").alias("of_file"), F.col("block").alias("of_block"), *[F.max(k).over(earlier).alias(f"carried_{k}") for k in marks])
    rows = rows.select("*", *[F.max(m).over(order).alias(k) for k, m in marks.items()]).join(carried, (F.col("file") == F.col("of_file")) & (F.col("block") == F.col("of_block")))
    rows = rows.select("file", place.alias("place"), "tag", "value", *[F.coalesce(k, f"carried_{k}").alias(k) for k in marks]).where("record is not null")
    # dealt by record once, which serves the three groupings below
    rows = rows.repartition("file", "record")
    listed = lambda value, at: F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value])
    entries = rows.groupBy("file", "record", "entry").agg(F.max("tag").alias("tag"), listed("value", "place").alias("lines"))
    by = F.when(F.col("tag").isin(*LIST_TAGS), F.array_join("lines", "; ")) if kind == "plaintext" else F.lit(None)
    entries = entries.select("file", "record", "entry", "tag", F.coalesce(by, F.array_join("lines", " ")).alias("value"))
    renamed: Column = F.col("tag")
    for old, new in names.items():
        renamed = F.when(F.col("tag") == old, F.lit(new)).otherwise(renamed)
    entries = entries.where(~F.col("tag").isin("EF", "ER", "FN", "VR")).withColumn("tag", renamed)
    wanted = tags or sorted(r["tag"] for r in entries.select("tag").distinct().collect())
    values = entries.groupBy("file", "record", "tag").agg(F.array_join(listed("value", "entry"), "; ").alias("value"))
    return values.groupBy("file", "record").pivot("tag", wanted).agg(F.first("value")).withColumn("db", F.lit(db))


def concatenated_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files of a folder, by path, each file followed by a line end: file, block, line_no, line.

    So a file whose last line is ended is followed by an empty line, as is an empty file, and one whose last line isn't ended is followed by
    nothing. Which of them it is shows by the files' lengths; nothing is read for it. \\r\\n and \\r become \\n, as when files are read as text."""
    one_way = F.regexp_replace("file", "^file:/+", "file:///")  # local paths are written in two ways
    lines = lines_of(spark, path).withColumn("file", one_way)
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length").withColumn("file", one_way)
    known = lines.groupBy("file").agg(F.sum(F.octet_length("line") + 1).alias("bytes"))  # a row a file
    # readers leave out empty files; the driver has the paths of all
    every = spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "file string").select(one_way.alias("file"))
    ended = files.join(known, "file").where(F.col("bytes") == F.col("length")).select("file").unionAll(every.join(known, "file", "left_anti"))
    plain = F.regexp_replace(F.regexp_replace("line", "\\r$", ""), "\\r", "\n")
    last = ended.select("file", F.lit(2**63 - 1).alias("block"), F.lit(0).cast("long").alias("line_no"), F.lit("").alias("line"))
    return lines.select("file", "block", "line_no", plain.alias("line")).unionAll(last)
