"""First sheet of .xlsx workbooks, one task per file, with the standard library's zip and XML readers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}     # built-in number formats that show dates or times
_BATCH = 5_000


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def _text(element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{_MAIN}t"))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt")
              if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")).lower())}
    styles = root.find(f"{_MAIN}cellXfs")
    return {i for i, xf in enumerate(styles if styles is not None else ())
            if int(xf.get("numFmtId", 0)) in _DATE_FORMATS | custom}


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet")
    for relation in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if relation.get("Id") == sheet.get(_REL):
            target = relation.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return "xl/worksheets/sheet1.xml"


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as text; serial dates as ISO text. The sheet is read as a stream."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(item) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        dates = _date_styles(book)
        with book.open(_first_sheet(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for position, cell in enumerate(row.iter(f"{_MAIN}c")):
                    place = _column_number(cell.get("r")) if cell.get("r") else position
                    cells += [None] * (place + 1 - len(cells))
                    cells[place] = _cell_text(cell, shared, dates)
                yield cells
                row.clear()


def _cell_text(cell, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _text(cell)
    value = cell.find(f"{_MAIN}v")
    if value is None or value.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        moment = datetime(1899, 12, 30) + timedelta(seconds=round(float(value.text) * 86_400))
        return moment.isoformat(" ")
    return value.text


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows: list[tuple] = []
            for number, cells in enumerate(sheet_rows(content)):
                rows.append((path, number, cells))
                if len(rows) == _BATCH:
                    yield pd.DataFrame(rows, columns=["path", "number", "cells"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["path", "number", "cells"])


def _header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        heads = [next(sheet_rows(content), []) for content in batch["content"]]
        yield pd.DataFrame({"cells": heads})


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """All rows below the header as text columns."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    headers = [tuple(r["cells"]) for r in files.mapInPandas(_header, "cells array<string>").distinct().limit(2).collect()]
    if not headers:
        raise ValueError(f"no workbook at {path}")
    if len(headers) > 1:
        raise ValueError("the workbooks have different headers")
    rows = files.mapInPandas(_parse, "path string, number long, cells array<string>").where("number > 0")
    names = _unique([name if name else f"Unnamed: {i}" for i, name in enumerate(headers[0])])
    cells = [F.get(F.col("cells"), F.lit(i)).alias(n) for i, n in enumerate(names)]
    return rows.where(F.exists("cells", lambda c: c.isNotNull())).select(*cells)


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    result = []
    for name in names:
        count = seen.get(name, 0)
        seen[name] = count + 1
        result.append(f"{name}.{count}" if count else name)
    return result
