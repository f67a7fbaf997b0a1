"""Results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import enrich, records
from ..progress import log

#: Values are written as they are, white space at their ends and quotes included.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_contexts(contexts: DataFrame, path: str) -> None:
    """CSV files of each keyword in a folder of its own, with a header."""
    contexts.select("keyword", "doc_id", "page", "context").write.partitionBy("keyword").mode("overwrite").options(**CSV).csv(path)


def write_overview(overview: DataFrame, path: str) -> None:
    """CSV files in order of documents, as parts in order."""
    overview.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").options(**CSV).csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Text in order of file and line."""
    order = ["file", "block", "line_no"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def write_merged(lines: DataFrame, path: str) -> DataFrame:
    """The same, of any length, as parts that are one text when they are put one behind the other; returns the manifest: part (the file's
    name), offset (of its first byte in the whole), bytes, in order. Nothing is gathered in one task but the manifest, a row a part."""
    write_lines(lines, path)
    found = lines.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("_metadata.file_name").alias("part"), F.col("length").alias("bytes"))
    place = F.regexp_extract("part", "^part-([0-9]+)", 1).cast("long")
    before = F.sum("bytes").over(Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1))
    return found.select("part", F.coalesce(before, F.lit(0)).alias("offset"), "bytes").orderBy("offset", "part")


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    df.write.mode("overwrite").options(**(CSV if kind == "csv" else {})).format(kind).save(path)
    log.info("table written to %s", path)


def write_indexed(df: DataFrame, path: str, *order: str) -> None:
    """CSV files with a first column `index`, numbered from 0 in the given order over all files."""
    numbered = records.with_index(df, *order)
    write_table(numbered.select("index", *[f"`{c}`" for c in numbered.columns if c != "index"]), path)


def change_report(changes: DataFrame) -> DataFrame:
    """Fixed values in the wording. Lines of the change log and their order: title, numbers, each field's edits, then every change."""
    spark = changes.sparkSession
    rule = "----------------------------------"
    head = spark.createDataFrame([(0, "Changelog of Spreadsheet Updates"), (1, rule), (2, ""), (5, ""), (6, "Detailed Changes:")], "part int, line string")
    head = head.select("part", F.lit(0).cast("long").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d"), "line")
    total = enrich.changed_rows(changes).select(F.lit(3).alias("part"), F.lit(0).cast("long").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d"), F.concat(F.lit("Total records changed: "), "changed_rows").alias("line"))
    counts = enrich.column_counts(changes).select(F.lit(4).alias("part"), F.col("first_edit.rec_id").cast("long").alias("a"), F.col("first_edit.prio").alias("b"), F.col("first_edit.map_pos").alias("c"), F.lit(0).alias("d"), F.concat(F.lit("Column "), "field", F.lit(" updated "), "edits", F.lit(" times.")).alias("line"))
    each = enrich.change_lines(changes).select(F.lit(7).alias("part"), F.col("rec_id").cast("long").alias("a"), F.col("prio").alias("b"), F.col("map_pos").alias("c"), F.explode(F.array(F.struct(F.lit(0).alias("d"), F.col("line").alias("line")), F.struct(F.lit(1).alias("d"), F.lit(rule).alias("line")))).alias("x")).select("part", "a", "b", "c", "x.d", "x.line")
    return head.unionAll(total).unionAll(counts).unionAll(each)


def write_change_report(changes: DataFrame, path: str) -> None:
    order = ["part", "a", "b", "c", "d"]
    change_report(changes).repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


class ChartUnavailable(RuntimeError):
    """No plotting library is installed."""


def draw_charts(series: DataFrame, title: str, pie_path: str, bar_path: str) -> None:
    """Pie and bar images of one series (as many rows as keywords), by matplotlib if that is installed."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot as plt
    except ImportError as e:
        raise ChartUnavailable("drawing charts needs matplotlib") from e
    rows = series.orderBy("rank").collect()
    names, values, labels = [r["keyword"] for r in rows], [r["hits"] for r in rows], [r["label"] for r in rows]
    for path, draw in ((pie_path, lambda: plt.pie(values, labels=[f"{n} {x}" for n, x in zip(names, labels)])), (bar_path, lambda: plt.bar(names, values))):
        plt.figure()
        draw()
        plt.title(title)
        plt.savefig(path)
        plt.close()
