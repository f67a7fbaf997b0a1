"""Spreadsheets (Office Open XML workbooks) read and written with the standard library: the first sheet, all cells as text.

A sheet has at most MOST_ROWS rows by the format's own rule, so one is a bounded piece of data. Larger tables go to several workbooks, each made
and written by a task, which `read_sheet` reads as one table. There a text that is longer than a cell goes on in columns of the same name."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import rename, write_bytes

#: Fixed values of the format.
MOST_ROWS, MOST_COLUMNS, MOST_CELL = 1_048_576, 16_384, 32_767
#: Rows, and characters of cells, of a workbook among several, which a task holds.
BOOK_ROWS, BOOK_CHARS = 100_000, 64_000_000
#: Rows and characters of cells that leave Python at a time.
LOT_ROWS, LOT_CHARS = 10_000, 4_000_000
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)|\r")
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


class SheetTooLarge(ValueError):
    """More rows or columns than a sheet may have, or a longer text than a cell may have."""


def _column(k: int) -> str:
    name = ""
    k += 1
    while k:
        k, rest = divmod(k - 1, 26)
        name = chr(65 + rest) + name
    return name


def _place(name: str) -> int:
    k = 0
    for c in name:
        k = 26 * k + ord(c) - 64
    return k - 1


def workbook(columns: list[str], rows: Iterator[tuple], comment: bytes = b"") -> bytes:
    """A workbook of one sheet: a header, then the rows. Null cells are left out; control characters are escaped by the format's rule.
    comment: the archive's own, its last bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.comment = comment
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
            sheet.write(_row(1, tuple(columns)))
            for k, row in enumerate(rows, 2):
                if k > MOST_ROWS:
                    raise SheetTooLarge(f"a sheet has at most {MOST_ROWS} rows")
                sheet.write(_row(k, row))
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _row(number: int, cells: tuple) -> bytes:
    parts = []
    for k, value in enumerate(cells):
        if value is None:
            continue
        if len(text := str(value)) > MOST_CELL:
            raise SheetTooLarge(f"a cell has at most {MOST_CELL} characters")
        text = escape(_CONTROL.sub(lambda m: f"_x{ord(m[0]):04X}_", text))
        parts.append(f'<c r="{_column(k)}{number}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>')
    return f'<row r="{number}">{"".join(parts)}</row>'.encode()


def _pieces(text: str | None) -> list[str | None]:
    """A text in parts that each fit a cell, which counts a character beyond U+FFFF as two."""
    if text is None or len(text) <= MOST_CELL // 2:
        return [text]
    most = MOST_CELL if len(text.encode("utf-16-le")) == 2 * len(text) else MOST_CELL // 2
    return [text[k : k + most] for k in range(0, len(text), most)]


def _spread(columns: list[str], rows: list[tuple]) -> tuple[list[str], Iterator[tuple]]:
    """The table with as many further columns of the same name, behind all others, as the longest text of each column needs."""
    counts = [max((len(_pieces(row[k])) for row in rows), default=1) for k in range(len(columns))]
    further = [name for name, n in zip(columns, counts) for _ in range(n - 1)]
    if len(columns) + len(further) > MOST_COLUMNS:
        raise SheetTooLarge(f"a sheet has at most {MOST_COLUMNS} columns")

    def wide() -> Iterator[tuple]:
        for row in rows:
            parts = [_pieces(text) for text in row]
            yield (*[p[0] for p in parts], *[p[k] if k < len(p) else None for p, n in zip(parts, counts) for k in range(1, n)])

    return columns + further, wide() if further else iter(rows)


def _joined(rows: Iterator[list[str | None]]) -> Iterator[list[str | None]]:
    """Rows, the header first, with the cells of columns of the same name as one text."""
    head = next(rows, [])
    places: dict[str | int, list[int]] = {}
    for k, name in enumerate(head):
        places.setdefault(name or k, []).append(k)
    yield [head[ks[0]] for ks in places.values()]
    for cells in rows:
        texts = [[cells[k] for k in ks if k < len(cells) and cells[k] is not None] for ks in places.values()]
        yield ["".join(t) if t else None for t in texts]


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cells of the first sheet's rows; numbers as they are written, shared and inline texts unescaped."""
    name = lambda tag: f"{{{_MAIN}}}{tag}"
    whole = lambda e: _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(t.text or "" for t in e.iter(name("t"))))
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = set(z.namelist())
        shared = [whole(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind(name("si"))] if "xl/sharedStrings.xml" in parts else []
        first = min((p for p in parts if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", p)), key=lambda p: int(re.search(r"(\d+)\.xml", p)[1]))
        with z.open(first) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != name("row"):
                    continue
                cells: list[str | None] = []
                for c in row.iterfind(name("c")):
                    at = _place(re.match("[A-Z]+", c.get("r", ""))[0]) if c.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    value = c.findtext(name("v"))
                    cells.append(whole(c) if c.get("t") == "inlineStr" else shared[int(value)] if c.get("t") == "s" and value is not None else value)
                yield cells
                row.clear()


def _lots(rows: Iterator[list[str | None]]) -> Iterator[tuple[int, list[list[str | None]]]]:
    """Rows in lots of bounded size, each with its first row's number."""
    first, held, lot = 0, 0, []
    for cells in rows:
        lot.append(cells)
        held += sum(len(c) for c in cells if c)
        if len(lot) >= LOT_ROWS or held >= LOT_CHARS:
            yield first, lot
            first, held, lot = first + len(lot), 0, []
    if lot:
        yield first, lot


def read_sheet(spark: SparkSession, path: str, joined: bool = False) -> DataFrame:
    """The first sheets of the workbooks at path, one below the other; columns by the first row of the first of them. A workbook is a
    task; an empty cell is null. joined: columns of the same name are one, with their cells' texts one behind the other, as
    `write_sheets` has made them of long texts."""

    def table(content: bytes) -> Iterator[list[str | None]]:
        return _joined(sheet_rows(content)) if joined else sheet_rows(content)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                for first, lot in _lots(table(content.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(lot), pa.string()), pa.array(range(first, first + len(lot)), pa.int64()), pa.array(lot, pa.list_(pa.string()))], ["file", "row", "cells"])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield pa.RecordBatch.from_arrays([pa.array([next(table(content.as_py()), [])], pa.list_(pa.string()))], ["cells"])

    books = spark.read.format("binaryFile").load(path).select("path", "content")
    first = books.agg(F.min("path")).first()[0]
    head = books.where(F.col("path") == F.lit(first)).select("content").mapInArrow(heads, "cells array<string>").collect()
    names = head[0]["cells"] if head else []
    found = books.mapInArrow(rows, "file string, row long, cells array<string>")
    return found.where("row > 0").select(*[F.get("cells", F.lit(k)).alias(n or _column(k)) for k, n in enumerate(names)])


def write_sheet(df: DataFrame, path: str) -> None:
    """One workbook of at most MOST_ROWS rows (more are an error, and nothing is written), its rows read partition by partition by the driver."""
    write_bytes(df.sparkSession, path, workbook(df.columns, map(tuple, df.toLocalIterator())))


def write_sheets(df: DataFrame, path: str) -> None:
    """A folder of workbooks, each with the header, of at most BOOK_ROWS rows and about BOOK_CHARS characters; at least one. Each is made and written by a
    task; only the files' names come to the driver. Texts that are longer than a cell go on in further columns; `read_sheet` joins them.

    Spark's text writer puts a line end behind each row, and so behind a workbook's bytes: it is the comment of one byte that ends the archive."""
    spark, columns = df.sparkSession, df.columns

    def books(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([workbook(*_spread(columns, rows), b"\n")], pa.binary())], ["content"])

        rows, held = [], 0
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(len(columns))]):
                rows.append(row)
                held += sum(len(c) for c in row if c)
                if len(rows) >= BOOK_ROWS or held >= BOOK_CHARS:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    text = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(columns)])
    content = text.mapInArrow(books, "content binary").select(F.col("content").cast("string").alias("value"))
    # a file of its own for each workbook
    content.write.option("maxRecordsPerFile", 1).text(path)
    if not rename(spark, path, ".txt", ".xlsx"):
        write_bytes(spark, f"{path}/part-00000.xlsx", workbook(columns, iter(())))
