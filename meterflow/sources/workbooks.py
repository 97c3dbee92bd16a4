"""Excel workbooks (.xlsx) as tables of text, and tables written as workbooks.

Executors read the files' bytes through Spark's own reader, so that any store serves, and stream the first sheet's XML; a
workbook has at most 1,048,576 rows by its format. Rows are written as a data source: each task makes whole workbooks in a
folder of the write, which the commit moves into place and an abort removes.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Rows of a sheet with its heading, and rows of an Arrow batch.
SHEET_ROWS, BATCH = 1_048_576, 4096
DATE_FORMAT = "%d %m %Y"
CELLS = "path string, sheet string, row long, cells array<string>, numbers array<boolean>"

# Fixed values of the format: number formats that are dates or times, and names of its parts.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
_DATE_LETTERS = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.')
_ESCAPED, _LITERAL, _CONTROL = re.compile("_x([0-9A-Fa-f]{4})_"), re.compile("_(?=x[0-9A-Fa-f]{4}_)"), re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def number_text(value: str) -> str:
    """A number's text as it is read: whole numbers without a fraction, others with all their digits."""
    x = float(value)
    return str(int(x)) if x == x and abs(x) != float("inf") and x == int(x) else repr(x)


def date_text(value: str, from_1904: bool) -> str:
    """A day's number as text; a number below one is a time."""
    x = float(value)
    if 0 <= x < 1:
        return str((dt.datetime.min + dt.timedelta(seconds=round(x * 86400))).time())
    try:
        start = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30 if x >= 60 else 31)  # the format has a 29th of February 1900
        return (start + dt.timedelta(days=x)).strftime(DATE_FORMAT)
    except OverflowError:
        return number_text(value)


def _text_of(element: ElementTree.Element) -> str:
    """The text of a string and of its runs, without the remarks on how to pronounce it."""
    parts = [t.text or "" for run in element if run.tag in (f"{{{_MAIN}}}t", f"{{{_MAIN}}}r") for t in run.iter(f"{{{_MAIN}}}t")]
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


def column_number(reference: str) -> int:
    """The place of a cell's column, from 0: A1 is 0, AA7 is 26."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


class Workbook:
    """The first sheet of a workbook, row by row."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        book = self._xml("xl/workbook.xml")
        first = book.find(f"{{{_MAIN}}}sheets/{{{_MAIN}}}sheet")
        if first is None:
            raise ValueError("the workbook has no sheet")
        links = {x.get("Id"): x.get("Target") for x in self._xml("xl/_rels/workbook.xml.rels").iter(f"{{{_PACKAGE}}}Relationship")}
        target = links[first.get(f"{{{_LINKS}}}id")]
        self.part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
        self.sheet = first.get("name") or ""
        pr = book.find(f"{{{_MAIN}}}workbookPr")
        self.from_1904 = pr is not None and pr.get("date1904") in ("1", "true")
        self.strings = [_text_of(x) for x in self._elements("xl/sharedStrings.xml", "si")]
        self.dates = self._date_styles()

    def _xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def _elements(self, name: str, tag: str) -> Iterator[ElementTree.Element]:
        """The elements with a tag as they end, each forgotten after its turn; none if there is no such part."""
        if name not in self.zip.namelist():
            return
        with self.zip.open(name) as stream:
            root = None
            for event, element in ElementTree.iterparse(stream, ("start", "end")):
                if root is None:
                    root = element
                if event == "end" and element.tag == f"{{{_MAIN}}}{tag}":
                    yield element
                    element.clear()
                    if tag == "row":  # rows hang under the sheet's data, which would keep them
                        root.find(f"{{{_MAIN}}}sheetData").clear()

    def _date_styles(self) -> set[str]:
        if "xl/styles.xml" not in self.zip.namelist():
            return set()
        styles = self._xml("xl/styles.xml")
        own = {int(x.get("numFmtId", 0)): x.get("formatCode", "") for x in styles.iter(f"{{{_MAIN}}}numFmt")}
        dates = DATE_FORMATS | {n for n, code in own.items() if re.search("[dmyhs]", _DATE_LETTERS.sub("", code.split(";")[0].lower().replace("general", "")))}
        formats = styles.find(f"{{{_MAIN}}}cellXfs")
        return {str(k) for k, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId", 0)) in dates}

    def cell(self, c: ElementTree.Element) -> tuple[str, bool]:
        """A cell's text, and whether it is a number; errors of formulas and empty cells are ''."""
        kind, value = c.get("t", "n"), c.findtext(f"{{{_MAIN}}}v")
        if kind == "inlineStr":
            inner = c.find(f"{{{_MAIN}}}is")
            return ("" if inner is None else _text_of(inner).strip()), False
        if value is None or kind == "e":
            return "", False
        if kind == "s":
            return self.strings[int(value)].strip(), False
        if kind == "b":
            return ("1" if value.strip() in ("1", "true") else "0"), False
        if kind == "d":
            return dt.datetime.fromisoformat(value.rstrip("Z")).strftime(DATE_FORMAT), False
        if kind == "str":
            return value.strip(), False
        if c.get("s", "0") in self.dates:
            return date_text(value, self.from_1904), False
        return number_text(value), True

    def rows(self) -> Iterator[tuple[int, list[str], list[bool]]]:
        """(number from 1, texts, whether numbers) of the rows that are there; cells that are not are ''."""
        number = 0
        for row in self._elements(self.part, "row"):
            number = int(row.get("r") or number + 1)
            texts: list[str] = []
            numbers: list[bool] = []
            for c in row.iter(f"{{{_MAIN}}}c"):
                place = column_number(c.get("r")) if c.get("r") else len(texts)
                texts += [""] * (place - len(texts))
                numbers += [False] * (place - len(numbers))
                text, is_number = self.cell(c)
                texts.append(text)
                numbers.append(is_number)
            yield number, texts, numbers


def cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells, numbers): the rows of the first sheet of each workbook at a path, as texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CELLS.split(", ")]
        types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_())]
        for batch in batches:
            for at, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                book, held = Workbook(content.as_py()), []
                for row in book.rows():
                    held.append((at, book.sheet, *row))
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CELLS)


def headings(spark: SparkSession, path: str) -> tuple[str, dict[str, int]]:
    """The sheet's name and the column of each heading, of equal ones the first; empty headings are left out."""
    first = cells(spark, path).where("row = 1").select("path", "sheet", "cells").orderBy("path").first()
    if first is None or not any(first["cells"]):
        raise ValueError(f"no row of headings: {path}")
    names: dict[str, int] = {}
    for k, name in enumerate(first["cells"]):
        if name.strip():
            names.setdefault(name.strip(), k)
    return first["sheet"], names


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """Workbooks with equal headings as one table of text columns, and row_order in the order of files and rows.

    Rows without any cell under a heading are left out.
    """
    _, names = headings(spark, path)
    at = lambda k: F.coalesce(F.get("cells", F.lit(k)), F.lit(""))
    rows = cells(spark, path).where("row > 1")
    rows = rows.where(F.exists(F.array(*[at(k) for k in names.values()]), lambda c: c != ""))
    files = spark.read.format("binaryFile").load(path).select("path").orderBy("path")  # the names alone are read
    place = {r["path"]: n for n, r in enumerate(files.toLocalIterator())}
    order = F.lit(0).cast("long") if len(place) < 2 else F.element_at(F.create_map(*[F.lit(x) for pair in place.items() for x in pair]), F.col("path")).cast("long")
    return rows.select(*[at(k).alias(n) for n, k in names.items()], (order * SHEET_ROWS + F.col("row")).alias("row_order"))


def numeric_by_kind(spark: SparkSession, path: str) -> DataFrame:
    """(column, filled, numeric, is_numeric): whether more than half of a column's filled cells are numbers in the file."""
    _, names = headings(spark, path)
    entry = lambda n, k: F.struct(F.lit(n).alias("column"), F.get("cells", F.lit(k)).alias("cell"), F.get("numbers", F.lit(k)).alias("number"))
    each = cells(spark, path).where("row > 1").select(F.explode(F.array(*[entry(n, k) for n, k in names.items()])).alias("x")).select("x.*")
    found = each.where("cell <> ''").groupBy("column").agg(F.count(F.lit(1)).alias("filled"), F.count_if("number").alias("numeric"))
    return found.withColumn("is_numeric", F.col("numeric") * 2 > F.col("filled"))


# writing


def column_letters(k: int) -> str:
    letters = ""
    k += 1
    while k:
        k, rest = divmod(k - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def _string(text: str, style: int) -> str:
    shown = escape(_CONTROL.sub(lambda m: f"_x{ord(m[0]):04X}_", _LITERAL.sub("_x005F_", text)))
    return f' s="{style}" t="inlineStr"><is><t xml:space="preserve">{shown}</t></is></c>'


@dataclass(frozen=True)
class Layout:
    """The columns of a written sheet: which are numbers, and formulas over columns of the same row, as {minuend}-{subtrahend}."""

    columns: tuple[str, ...]
    numbers: frozenset[str]
    differences: dict[str, tuple[str, str]]
    sheet: str = "Sheet1"

    def heading(self) -> str:
        return self._row(1, [_string(c, 1) for c in self.columns])

    def row(self, n: int, values: list[str | None]) -> str:
        """The XML of row n. A number's cell is a number where its text is one; a formula carries the value it has now."""
        shown = []
        for name, value in zip(self.columns, values):
            is_number = value is not None and re.fullmatch(r"-?[0-9]+([.][0-9]+)?", value) is not None
            if name in self.differences:
                a, b = (f"{column_letters(self.columns.index(x))}{n}" for x in self.differences[name])
                shown.append(f"><f>{a}-{b}</f>{f'<v>{value}</v>' if is_number else ''}</c>")
            elif value is None or value == "":
                shown.append(None)
            else:
                shown.append(f"><v>{value}</v></c>" if is_number and name in self.numbers else _string(value, 2))
        return self._row(n, shown)

    @staticmethod
    def _row(n: int, cells_: list[str | None]) -> str:
        return f'<row r="{n}">' + "".join(f'<c r="{column_letters(k)}{n}"{x}' for k, x in enumerate(cells_) if x is not None) + "</row>"


_TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPES}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPES}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPES}.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="r1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="r1" Type="{_LINKS}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{_LINKS}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" applyFont="1"/><xf numFmtId="49" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


class SheetFile:
    """A workbook that is being written: its sheet is compressed row by row."""

    def __init__(self, stream, layout: Layout):
        self.layout, self.zip = layout, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
        for name, text in _PARTS.items():
            self.zip.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{text}')
        name = escape(layout.sheet[:31], {'"': "&quot;"})
        self.zip.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets><sheet name="{name}" sheetId="1" r:id="r1"/></sheets></workbook>')
        self.part = self.zip.open("xl/worksheets/sheet1.xml", "w")
        self.part.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>{layout.heading()}'.encode())
        self.n = 1

    def add(self, values: list[str | None]) -> None:
        self.n += 1
        self.part.write(self.layout.row(self.n, values).encode())

    def close(self) -> None:
        self.part.write(b"</sheetData></worksheet>")
        self.part.close()
        self.zip.close()


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WorkbookWriter(DataSourceArrowWriter):
    """Workbooks of one write: each task's in a folder of the write, moved to their names when all tasks have ended."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.uri, self.overwrite = options["path"], overwrite
        self.limit = int(options.get("rows", SHEET_ROWS))
        pairs = [x.split("=", 1) for x in options.get("differences", "").split(";") if x]
        self.layout = Layout(tuple(schema.names), frozenset(x for x in options.get("numbers", "").split(";") if x), {k: tuple(v.split("-", 1)) for k, v in pairs}, options.get("sheet", "Sheet1"))
        self.work = f"_writing-{uuid.uuid4().hex}"

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri) if "://" in self.uri or self.uri.startswith("file:") else (fs.LocalFileSystem(), self.uri)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = self._store()
        task = TaskContext.get()
        store.create_dir(f"{at}/{self.work}", recursive=True)
        names, open_, stream = [], None, None
        for batch in iterator:
            for values in zip(*[c.to_pylist() for c in batch.columns]):
                if open_ is None or open_.n == self.limit:
                    if open_ is not None:
                        open_.close()
                        stream.close()
                    names.append(f"part-{task.partitionId():05d}-{len(names):03d}.xlsx@{task.taskAttemptId()}")
                    stream = store.open_output_stream(f"{at}/{self.work}/{names[-1]}")
                    open_ = SheetFile(stream, self.layout)
                open_.add([None if v is None else str(v) for v in values])
        if open_ is not None:
            open_.close()
            stream.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = self._store()
        old = [x.path for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.path.endswith(".xlsx")]
        if old and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.uri} has workbooks already")
        for path in old:
            store.delete_file(path)
        for name in (n for m in messages if m is not None for n in m.names):
            store.move(f"{at}/{self.work}/{name}", f"{at}/{name.split('@')[0]}")
        self._clear(store, at)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store: fs.FileSystem, at: str) -> None:
        if store.get_file_info(f"{at}/{self.work}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{self.work}")


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "meterflow_workbook"

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options, schema, overwrite)


def write_workbooks(rows: DataFrame, folder: str, order: str = "row_order", numbers: tuple[str, ...] = (), differences: dict[str, tuple[str, str]] | None = None, sheet: str = "Sheet1", most: int = SHEET_ROWS) -> None:
    """rows as workbooks of at most `most` rows in a folder, in the order of a column that is not written; what was there is replaced.

    Of the columns `numbers` cells are numbers, of others text, so that leading zeros stay. A difference is a formula over
    two columns. Workbooks are numbered in the order of their rows; rows without any make no file.
    """
    spark = rows.sparkSession
    spark.dataSource.register(WorkbookSource)
    parts = max(1, -(-rows.count() // max(1, most - 1)))
    ranged = rows.repartitionByRange(parts, order).sortWithinPartitions(order).drop(order)
    ranged = ranged.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in ranged.columns])
    options = {"path": folder, "rows": most, "numbers": ";".join(numbers), "sheet": sheet, "differences": ";".join(f"{k}={a}-{b}" for k, (a, b) in (differences or {}).items())}
    ranged.write.format("meterflow_workbook").options(**options).mode("overwrite").save()
