"""A batch source for workbook sheets: ``spark.read.format("kelvane_xlsx").option("sheet", ...).load(path)``.

A sheet is one XML stream and is read by one task, row by row. Cells are strings in their lexical form; ``row_idx`` counts the rows
with any value from 0, and ``company_id_is_float`` tells ids that the sheet stores as non-integers. Mirror a sheet to
Parquet once and work on that.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from kelvane.config import FIELDS, MASTER_SHEET, SchemaError
from kelvane.sources.headers import resolve_columns

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_NS}t")) for item in root.iter(f"{_NS}si")]


def sheet_names(path: str) -> dict[str, str]:
    """Sheet name -> its file within the workbook."""
    with zipfile.ZipFile(path) as book:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")
        return {s.get("name"): "xl/" + targets[s.get(_REL)].removeprefix("/xl/").removeprefix("xl/") for s in sheets}


def rows_of(path: str, sheet: str) -> Iterator[list[tuple[str, bool] | None]]:
    """Cells of each row: (text, stored as a non-integer number), or None."""
    names = sheet_names(path)
    if sheet not in names:
        raise SchemaError(f"sheet {sheet!r} is missing; there are {list(names)}")
    with zipfile.ZipFile(path) as book:
        shared = _shared(book)
        with book.open(names[sheet]) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{_NS}row":
                    continue
                out: list[tuple[str, bool] | None] = []
                for i, cell in enumerate(row.iter(f"{_NS}c")):
                    at = _column(cell.get("r")) if cell.get("r") else i
                    out += [None] * (at + 1 - len(out))
                    kind, value = cell.get("t"), cell.find(f"{_NS}v")
                    if kind == "inlineStr":
                        out[at] = ("".join(t.text or "" for t in cell.iter(f"{_NS}t")), False)
                    elif value is not None and value.text is not None:
                        text = value.text
                        if kind == "s":
                            out[at] = (shared[int(text)], False)
                        elif kind == "b":
                            out[at] = ("True" if text == "1" else "False", False)
                        else:
                            out[at] = (text, kind in (None, "n") and bool(re.search(r"[.eE]", text)))
                yield out
                row.clear()


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, sheet: str):
        self.path, self.sheet = path, sheet

    def read(self, partition) -> Iterator[tuple]:
        rows = rows_of(self.path, self.sheet)
        head = next(rows, None)
        if head is None:
            raise SchemaError("the sheet is empty")
        at = resolve_columns([c[0] if c else None for c in head])
        idx = 0
        for row in rows:
            if not any(c and c[0] != "" for c in row):
                continue
            cell = lambda i: row[i] if i < len(row) else None  # noqa: B023, E731
            of_id = cell(at["company_id"])
            yield (idx, bool(of_id and of_id[1]), *((c[0] or None) if (c := cell(at[f])) else None for f in FIELDS))
            idx += 1


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kelvane_xlsx"

    def schema(self) -> StructType:
        return StructType([StructField("row_idx", LongType()), StructField("company_id_is_float", BooleanType()), *[StructField(f, StringType()) for f in FIELDS]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(self.options["path"], self.options.get("sheet", MASTER_SHEET))


def read_master(spark: SparkSession, path: str, sheet: str = MASTER_SHEET) -> DataFrame:
    spark.dataSource.register(XlsxSource)
    return spark.read.format("kelvane_xlsx").option("sheet", sheet).load(path)
