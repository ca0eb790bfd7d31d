"""Workbooks (xlsx) as grids of text cells: a data source with one partition per file and sheet."""

from __future__ import annotations

import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree.ElementTree import ParseError, iterparse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .delimited import MISSING

SCHEMA = "file string, sheet string, sheet_index int, block long, seq long, cells array<string>, is_text array<boolean>, error string"

# Built-in number formats that show dates, and the days that serial numbers count from.
DATE_FORMAT_IDS = frozenset([*range(14, 23), *range(45, 48)])
EPOCHS = {False: datetime(1899, 12, 30), True: datetime(1904, 1, 1)}
ROWS_PER_BATCH = 2000
#: Workbooks whose lists of sheets are read at a time while the read is planned.
PLANNERS = 16
#: What a damaged file or sheet raises; anything else, such as a lost connection, fails the task, which Spark tries again.
DAMAGE = (zipfile.BadZipFile, zlib.error, ParseError, KeyError, IndexError, ValueError, EOFError, NotImplementedError, RuntimeError, StopIteration)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, el in iterparse(f):
            if _local(el.tag) == "si":
                # Phonetic hints are not part of the text.
                out.append("".join(t.text or "" for r in el if _local(r.tag) in ("t", "r") for t in r.iter() if _local(t.tag) == "t"))
                el.clear()
    return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    custom, styles, in_cells = {}, [], False
    with book.open("xl/styles.xml") as f:
        for event, el in iterparse(f, events=("start", "end")):
            tag = _local(el.tag)
            if tag == "cellXfs":
                in_cells = event == "start"
            elif event == "end" and tag == "numFmt":
                code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", el.get("formatCode", ""))
                custom[int(el.get("numFmtId"))] = bool(re.search("[ymdh]", code, re.I))
            elif event == "end" and tag == "xf" and in_cells:
                styles.append(int(el.get("numFmtId", 0)))
    return {i for i, n in enumerate(styles) if n in DATE_FORMAT_IDS or custom.get(n)}


def _sheets(book: zipfile.ZipFile) -> tuple[list[tuple[str, str]], bool]:
    """(name, part) in workbook order, and whether dates count from 1904."""
    targets = {}
    with book.open("xl/_rels/workbook.xml.rels") as f:
        for _, el in iterparse(f):
            if _local(el.tag) == "Relationship":
                t = el.get("Target")
                targets[el.get("Id")] = t.lstrip("/") if t.startswith("/") else "xl/" + t
    out, late = [], False
    with book.open("xl/workbook.xml") as f:
        for _, el in iterparse(f):
            if _local(el.tag) == "sheet":
                rid = next(v for k, v in el.attrib.items() if _local(k) == "id")
                out.append((el.get("name"), targets.get(rid, "")))
            elif _local(el.tag) == "workbookPr":
                late = el.get("date1904", "0").lower() in ("1", "true")
    return out, late


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _value(cell, strings: list[str], dates: set[int], epoch: datetime) -> tuple[str | None, bool]:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        text = "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
        return (None, False) if text in MISSING else (text, True)
    raw = next((c.text for c in cell if _local(c.tag) == "v"), None)
    if raw is None or kind == "e":
        return None, False
    if kind in ("s", "str"):
        text = strings[int(raw)] if kind == "s" else raw
        return (None, False) if text in MISSING else (text, True)
    if kind == "b":
        return ("True" if raw == "1" else "False"), False
    if kind == "n" and int(cell.get("s", 0)) in dates:
        try:
            return (epoch + timedelta(days=float(raw))).strftime("%Y-%m-%d %H:%M:%S"), False
        except OverflowError:  # no day a calendar has: the number stays
            return raw, False
    return raw, False


def _rows(book: zipfile.ZipFile, part: str, strings: list[str], dates: set[int], epoch: datetime) -> Iterator[tuple[int, list[str | None], list[bool]]]:
    with book.open(part) as f:
        at = -1
        for _, el in iterparse(f):
            if _local(el.tag) != "row":
                continue
            at = int(el.get("r", at + 2)) - 1
            cells: list[str | None] = []
            texts: list[bool] = []
            for c in el:
                if _local(c.tag) != "c":
                    continue
                where = _column(c.get("r")) if c.get("r") else len(cells)
                while len(cells) < where:
                    cells.append(None)
                    texts.append(False)
                value, text = _value(c, strings, dates, epoch)
                cells.append(value)
                texts.append(text)
            el.clear()
            yield at, cells, texts


@dataclass
class Sheet(InputPartition):
    """One sheet of one file; without a part the file itself is damaged."""

    path: str
    file: str
    name: str | None = None
    index: int | None = None
    part: str | None = None
    late: bool = False
    error: str | None = None


def _told(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def _filesystem(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in root:
        return pyarrow.fs.FileSystem.from_uri(root)
    return pyarrow.fs.LocalFileSystem(), root.removeprefix("file:")


class WorkbookReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Sheet]:
        """One per sheet, from the workbooks' directories alone; names that Spark's own listing leaves out are left out here."""
        fs, base = _filesystem(self.root)
        single = fs.get_file_info(base).type == pyarrow.fs.FileType.File
        found = [fs.get_file_info(base)] if single else fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True))
        books = []
        for info in found:
            file = posixpath.basename(info.path) if single else posixpath.relpath(info.path, base)
            if info.type == pyarrow.fs.FileType.File and file.endswith(".xlsx") and not any(part[0] in "~._" for part in file.split("/")):
                books.append((info.path, file))

        def sheets(book: tuple[str, str]) -> list[Sheet]:
            path, file = book
            try:
                with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    listed, late = _sheets(z)
            except DAMAGE as e:
                return [Sheet(path, file, error=_told(e))]
            # Charts and dialogs have no cells.
            return [Sheet(path, file, name, i, part, late) for i, (name, part) in enumerate(listed) if not part or "worksheets" in part]

        with ThreadPoolExecutor(PLANNERS) as pool:
            return [s for group in pool.map(sheets, sorted(books)) for s in group]

    def read(self, sheet: Sheet) -> Iterator[pa.RecordBatch]:
        """Rows of a sheet in small batches, or one row that tells its damage: every cell is read once before the first row leaves."""
        if sheet.error is None:
            fs, _ = _filesystem(self.root)
            with fs.open_input_file(sheet.path) as f:
                try:
                    with zipfile.ZipFile(f) as book:
                        known = _shared_strings(book), _date_styles(book), EPOCHS[sheet.late]
                        for _ in _rows(book, sheet.part, *known):
                            pass
                        yield from self._batches(sheet, _rows(book, sheet.part, *known))
                        return
                except DAMAGE as e:
                    sheet.error = _told(e)
        yield self._batch(sheet, [(None, None, None)])

    def _batches(self, sheet: Sheet, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) >= ROWS_PER_BATCH:
                yield self._batch(sheet, held)
                held = []
        if held:
            yield self._batch(sheet, held)

    def _batch(self, sheet: Sheet, rows: list[tuple]) -> pa.RecordBatch:
        seq, cells, texts = zip(*rows)
        n = len(rows)
        return pa.RecordBatch.from_arrays([
            pa.array([sheet.file] * n, pa.string()), pa.array([sheet.name] * n, pa.string()), pa.array([sheet.index] * n, pa.int32()),
            pa.array([0] * n, pa.int64()), pa.array(seq, pa.int64()), pa.array(cells, pa.list_(pa.string())),
            pa.array(texts, pa.list_(pa.bool_())), pa.array([sheet.error] * n, pa.string()),
        ], names=[c.split()[0] for c in SCHEMA.split(", ")])


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").load(folder)``; the folder may be local or any store that pyarrow reads."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"])


def read_sheets(spark: SparkSession, root: str) -> DataFrame:
    """Rows of every sheet of every xlsx file below ``root``; of damaged files and sheets one row each, with ``error``.

    A task reads one sheet; all it holds is the workbook's shared strings. A damaged sheet gives no cells, the others of
    its file are read. Dates come out as text, counted from 1904 where the workbook says so, numbers as written, formula
    results as stored.
    """
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").load(root)


def read_cells(spark: SparkSession, root: str) -> DataFrame:
    """Cells of every readable sheet, plus ``sheet_index`` (from 0)."""
    return read_sheets(spark, root).where(F.col("error").isNull()).drop("error")


def problems(spark: SparkSession, root: str) -> DataFrame:
    """(file, sheet, error) of damaged sheets, and of damaged files with a null sheet."""
    return read_sheets(spark, root).where(F.col("error").isNotNull()).select("file", "sheet", "error")


def unreadable(files: DataFrame, cells: DataFrame) -> DataFrame:
    """Workbooks that gave no sheet at all."""
    return files.filter(F.col("extension").isin("xlsx", "xls", "xlsb")).join(cells.select("file").distinct(), "file", "left_anti")
