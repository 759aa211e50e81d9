"""A batch sink for spreadsheets: ``df.write.format("gridxlsx").mode("append").save(folder)`` makes one file for each page.

Rows are cells: doc_id, page_index, row_index, col_index, value. All cells are text and the first row is bold. Rows of one
page must lie in one partition and stand together there; ``write_pages`` sees to that.
"""

from __future__ import annotations

import functools
import io
import itertools
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MOST_ROWS, MOST_COLUMNS = 1_048_576, 16_384
# The parts of a minimal workbook.
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'
_BOOK = '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'
_BOOK_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>'
_STYLES = '<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf fontId="0"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>'


def column_name(i: int) -> str:
    name = ""
    while i >= 0:
        i, k = divmod(i, 26)
        name, i = chr(65 + k) + name, i - 1
    return name


def workbook(rows: dict[int, dict[int, str]]) -> bytes:
    """A workbook of one sheet: text cells, the first row bold, columns as wide as their longest cell."""
    if rows and (max(rows) >= MOST_ROWS or max(max(r, default=0) for r in rows.values()) >= MOST_COLUMNS):
        raise ValueError("more rows or columns than a sheet can hold")
    clean = lambda s: escape("".join(c for c in s if c >= " " or c in "\t\n\r"))
    widths: dict[int, int] = {}
    lines = []
    for r in sorted(rows):
        cells = []
        for c, value in sorted(rows[r].items()):
            widths[c] = max(widths.get(c, 0), len(value))
            cells.append(f'<c r="{column_name(c)}{r + 1}" t="inlineStr" s="{int(r == 0)}"><is><t xml:space="preserve">{clean(value)}</t></is></c>')
        lines.append(f'<row r="{r + 1}">{"".join(cells)}</row>')
    cols = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{min(255, w + 2)}" customWidth="1"/>' for c, w in sorted(widths.items()))
    sheet = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{"".join(lines)}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("xl/workbook.xml", _BOOK), ("xl/_rels/workbook.xml.rels", _BOOK_RELS), ("xl/styles.xml", _STYLES), ("xl/worksheets/sheet1.xml", sheet)):
            z.writestr(name, text)
    return out.getvalue()


def file_system(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store that a path names, a local or mounted one if none."""
    return pyarrow.fs.FileSystem.from_uri(folder) if re.match(r"[a-z0-9+.-]+:/", folder) else (pyarrow.fs.LocalFileSystem(), folder)


@dataclass
class Written(WriterCommitMessage):
    #: The attempt whose parts are finished workbooks, and how many; their names stay in the folder, as a job may have millions.
    attempt: str
    n: int


class XlsxWriter(DataSourceWriter):
    """A task writes parts that bear its attempt's number, so attempts do not meet; the commit gives parts of successful tasks their names."""

    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex[:8]

    def write(self, iterator: Iterator) -> Written:
        fs, folder = file_system(self.folder)
        fs.create_dir(folder, recursive=True)
        attempt, last, n = f"{self.job}-{TaskContext.get().taskAttemptId()}", None, 0
        try:
            for (doc, page), rows in itertools.groupby(iterator, key=lambda row: (row.doc_id, row.page_index)):  # in order of pages: one is held
                held: dict[int, dict[int, str]] = {}
                for row in rows:
                    held.setdefault(row.row_index, {})[row.col_index] = row.value or ""
                name = f"{doc}_p{page + 1}"
                if name == last:
                    raise ValueError("cells of one page must stand together")
                last, n = name, n + 1
                with fs.open_output_stream(f"{folder}/_{name}.{attempt}.part") as f:
                    f.write(workbook(held))
        except BaseException:
            _remove(fs, folder, {attempt})
            raise
        return Written(attempt, n)

    def commit(self, messages: list) -> None:
        fs, folder = file_system(self.folder)
        wanted = {m.attempt: m.n for m in messages if m and m.n}
        parts: dict[str, list[str]] = {}
        for name, attempt in _parts(fs, folder):
            parts.setdefault(attempt, []).append(name)
        if any(len(parts.get(attempt, [])) != n for attempt, n in wanted.items()):
            raise RuntimeError("parts of a finished task are gone")
        for attempt, names in parts.items():
            for name in names:
                part = f"{folder}/_{name}.{attempt}.part"
                if attempt in wanted:
                    fs.move(part, f"{folder}/{name}.xlsx")
                else:  # of an attempt that was given up without a word
                    fs.delete_file(part)

    def abort(self, messages: list) -> None:
        fs, folder = file_system(self.folder)
        _remove(fs, folder, {m.attempt for m in messages if m})


def _parts(fs: pyarrow.fs.FileSystem, folder: str) -> Iterator[tuple[str, str]]:
    """The parts in a folder: the page's name and the attempt's number."""
    for f in fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)):
        found = re.fullmatch(r"_(.+)\.([0-9a-f-]+)\.part", f.base_name)
        if found:
            yield found[1], found[2]


def _remove(fs: pyarrow.fs.FileSystem, folder: str, attempts: set[str]) -> None:
    for name, attempt in list(_parts(fs, folder)):
        if attempt in attempts:
            fs.delete_file(f"{folder}/_{name}.{attempt}.part")


class XlsxSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridxlsx"

    def writer(self, schema, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(self.options["path"])


def write_pages(spark: SparkSession, cells: DataFrame, folder: str) -> None:
    """One workbook a page in a folder that driver and executors share; a page is written again over its last file."""
    spark.dataSource.register(XlsxSink)
    rows = cells.select("doc_id", "page_index", "row_index", "col_index", "value").repartition("doc_id", "page_index")
    rows.sortWithinPartitions("doc_id", "page_index").write.format("gridxlsx").mode("append").save(folder)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of such workbooks: ``doc_id, page_index, row_index, col_index, value, bold``."""
    fields = [("doc_id", pa.int64()), ("page_index", pa.int32()), ("row_index", pa.int32()), ("col_index", pa.int32()), ("value", pa.string()), ("bold", pa.bool_())]
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc, page = re.search(r"/(\d+)_p(\d+)\.xlsx$", path).groups()
                sheet = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content.as_py())).read("xl/worksheets/sheet1.xml"))
                rows = []
                for c in sheet.iter(f"{ns}c"):
                    letters, number = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                    column = functools.reduce(lambda n, x: 26 * n + ord(x) - 64, letters, 0) - 1
                    rows.append((int(doc), int(page) - 1, int(number) - 1, column, c.findtext(f"{ns}is/{ns}t") or "", c.get("s") == "1"))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder).select("path", "content")
    return files.mapInArrow(run, "doc_id long, page_index int, row_index int, col_index int, value string, bold boolean")
