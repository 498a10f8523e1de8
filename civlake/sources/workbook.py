"""Workbooks (.xlsx: XML in a zip) as rows of cells, and rows as workbooks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civlake.sources.stores import write_bytes

CELLS = "file string, sheet string, seq long, cells array<string>"
#: Names of the format's parts (fixed values).
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
ROWS_AT_ONCE = 5000


def _text(element: ET.Element) -> str:
    """The text of a string with or without formatted runs; what is only said aloud (rPh) does not count."""
    return "".join(t.text or "" for part in (element, *element.iter(f"{_MAIN}r")) for t in part.findall(f"{_MAIN}t"))


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, element in ET.iterparse(f):
            if element.tag == f"{_MAIN}si":
                out.append(_text(element))
                element.clear()
    return out


def sheets_of(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of a workbook's sheets, in its order."""
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    at = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return [(s.get("name"), at(targets[s.get(_REL)])) for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]


def rows_of(content: bytes, sheet: str | None = None) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number from 1, cells) of a workbook's sheets or of one; blank cells before the last are null, numbers are as the file writes them, truth is TRUE or FALSE.

    Sheets are read row by row; a workbook's shared strings are held while it is read.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = _shared(book)
        for name, part in sheets_of(book):
            if sheet is not None and name != sheet:
                continue
            number = 0
            with book.open(part) as f:
                for _, row in ET.iterparse(f):
                    if row.tag != f"{_MAIN}row":
                        continue
                    number = int(row.get("r") or number + 1)
                    cells: list[str | None] = []
                    for c in row.findall(f"{_MAIN}c"):
                        k = _column(c.get("r")) if c.get("r") else len(cells)
                        cells += [None] * (k + 1 - len(cells))
                        value, kind = c.find(f"{_MAIN}v"), c.get("t")
                        if kind == "inlineStr":
                            inline = c.find(f"{_MAIN}is")
                            cells[k] = None if inline is None else _text(inline)
                        elif value is not None and value.text is not None:
                            cells[k] = strings[int(value.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(value.text) if kind == "b" else value.text
                    yield name, number, cells
                    row.clear()


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """file, sheet, seq, cells of the workbooks at a path, as sheet_rows(), sheet_ballots() and spreadsheet_roll() take them; a file a task.

    A file that is no workbook fails with its name.
    """

    def run(batches):
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                name, held = file.rsplit("/", 1)[-1], []
                try:
                    for row in rows_of(content.as_py(), sheet):
                        held.append((name, *row))
                        if len(held) == ROWS_AT_ONCE:
                            yield _batch(held)
                            held = []
                except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
                    raise ValueError(f"{name} is no workbook: {e}") from e
                if held:
                    yield _batch(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInArrow(run, CELLS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["file", "sheet", "seq", "cells"])


def _reference(column: int, row: int) -> str:
    name = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        name = chr(65 + rest) + name
    return f"{name}{row}"


def workbook(rows: list[list[str | float | None]], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet; texts are shared strings, numbers numbers, nulls no cells. Characters that XML cannot hold are left out."""
    strings: dict[str, int] = {}
    lines = []
    for r, cells in enumerate(rows, 1):
        out = []
        for k, value in enumerate(cells):
            if isinstance(value, str):
                kept = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", value)
                out.append(f'<c r="{_reference(k, r)}" t="s"><v>{strings.setdefault(kept, len(strings))}</v></c>')
            elif value is not None:
                out.append(f'<c r="{_reference(k, r)}"><v>{value!r}</v></c>')
        lines.append(f'<row r="{r}">{"".join(out)}</row>')
    main, head = _MAIN[1:-1], '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kinds = {"xl/workbook.xml": "sheet.main", "xl/worksheets/sheet1.xml": "worksheet", "xl/sharedStrings.xml": "sharedStrings"}
    office = _REL[1 : -len("}id")]
    shared = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings).replace("\r", "&#13;")
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="/{p}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>' for p, k in kinds.items()) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{office}/sharedStrings" Target="sharedStrings.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}" uniqueCount="{len(strings)}">{shared}</sst>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, body in parts.items():
            book.writestr(name, head + body)
    return out.getvalue()


def write_workbooks(rows: DataFrame, path: str, group: str, order: str, cells: list[str], header: list[str], most: int = 1_000_000) -> DataFrame:
    """Write a workbook of each group's rows in an order, under a header; one row a workbook: name, rows. A group of more rows than a sheet holds gets several."""
    part = F.floor((F.row_number().over(_window(group, order)) - 1) / most)
    asked = rows.select(F.col(group).cast("string").alias("__g"), part.alias("__p"), F.col(order).alias("__o"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(cells)])

    def write(table: pa.Table) -> pa.Table:
        name = f"{table.column('__g')[0].as_py()}-{table.column('__p')[0].as_py()}.xlsx"
        body = [list(r.values()) for r in table.sort_by("__o").select([f"c{k}" for k in range(len(cells))]).to_pylist()]
        write_bytes(f"{path}/{name}", workbook([header, *body]))
        return pa.table({"name": [name], "rows": [len(body)]})

    return asked.groupBy("__g", "__p").applyInArrow(write, "name string, rows long")


def _window(group: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(order)
