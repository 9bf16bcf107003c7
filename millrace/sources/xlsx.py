"""Workbooks as a data source: the first sheet is read as strings under its header, and one sheet is written. Only the standard library is used."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

#: The namespaces of workbook parts and the parts that a workbook must have.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
SHEET_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def opened(path: str, mode: str):
    """A stream on a path or URI, through pyarrow's file systems."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)
    return where.open_input_stream(name) if mode == "r" else where.open_output_stream(name)


def column(ref: str) -> int:
    """The place of a cell's column, A being 0."""
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def letters(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def grid(data: bytes) -> list[list[str | None]]:
    """The cells of the first sheet as strings; empty ones are None."""
    tag = lambda x: f"{{{MAIN}}}{x}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((x for x in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)), key=lambda x: int(re.search(r"\d+", x)[0]))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(tag("t"))) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(tag("si"))]
        out = []
        for row in ElementTree.fromstring(z.read(names[0])).iter(tag("row")):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.iter(tag("c"))):
                v = c.find(tag("v"))
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(tag("t")))
                else:
                    text = v.text if v is not None else None
                    text = shared[int(text)] if c.get("t") == "s" and text is not None else text
                cells[column(c.get("r")) if c.get("r") else k] = text
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return out


def workbook(header: list[str], rows: list[tuple]) -> bytes:
    """A workbook of one sheet; numbers are numbers, the rest is text."""

    def cell(r: int, i: int, v) -> str:
        ref = f"{letters(i)}{r}"
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v:
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    lines = "".join(f'<row r="{r}">{"".join(cell(r, i, v) for i, v in enumerate(x))}</row>' for r, x in enumerate([header, *rows], 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{SHEET_KIND}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{SHEET_KIND}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{RELS}"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{RELS}"><Relationship Id="rId1" Type="{OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{lines}</sheetData></worksheet>')
    return out.getvalue()


class Workbook(DataSource):
    """Format "workbook"; a sheet is small, it is read and written by one task."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        with opened(self.options["path"], "r") as f:
            head = (grid(f.read()) or [[]])[0]
        return StructType([StructField(x or f"_c{i}", StringType()) for i, x in enumerate(head)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SheetReader(self.options["path"], len(schema))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SheetWriter(self.options["path"], schema.names)


class SheetReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        with opened(self.path, "r") as f:
            rows = grid(f.read())[1:]
        for r in rows:
            yield tuple((r + [None] * self.width)[: self.width])


class SheetWriter(DataSourceWriter):
    def __init__(self, path: str, header: list[str]):
        self.path, self.header = path, header

    def write(self, iterator):
        rows = [tuple(r) for r in iterator]
        if rows:
            with opened(self.path, "w") as f:
                f.write(workbook(self.header, rows))
        return WriterCommitMessage()
