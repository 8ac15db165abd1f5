"""Sheets of workbooks (zipped XML) as rows: files are read by Spark, a file is a task's work, rows leave it in batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the name space of workbooks' elements.
NAMES = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ROWS = 5000


def _column(reference: str) -> int:
    """Where a cell stands in its row: A is 0, AA is 26."""
    n = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def _text(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{NAMES}t"))


def cells(content: bytes, sheet: int) -> Iterator[list[str | None]]:
    """The rows of a workbook's n-th sheet as text, empty ones too; cells that are missing are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                shared = [_text(e) for _, e in ElementTree.iterparse(f) if e.tag == f"{NAMES}si"]
        last = 0
        with book.open(f"xl/worksheets/sheet{sheet}.xml") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{NAMES}row":
                    continue
                for _ in range(int(row.get("r", last + 1)) - last - 1):
                    yield []
                last = int(row.get("r", last + 1))
                out: list[str | None] = []
                for cell in row.iter(f"{NAMES}c"):
                    at = _column(cell.get("r", "")) if cell.get("r") else len(out)
                    value, kind = cell.find(f"{NAMES}v"), cell.get("t")
                    said = _text(cell) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else value.text
                    out += [None] * (at + 1 - len(out))
                    out[at] = said
                yield out
                row.clear()


def sheet_rows(spark: SparkSession, path: str, columns: dict[str, str], *, header: int = 0, sheet: int = 1, nothing: str = "no data") -> DataFrame:
    """Rows of a sheet of each workbook under ``path``: file, row (from 1, as in the sheet) and ``columns`` as text.

    ``columns``: header as it is written there (any case, blanks around it don't count) -> column. ``header``: rows above
    the one with the headers. Columns whose header is absent are null, as are blank cells and those that say ``nothing``;
    rows without any value go. Workbooks without the sheet, and files that are none, fail.
    """
    wanted = {h.strip().lower(): c for h, c in columns.items()}
    names = ["file", "row", *columns.values()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                places: dict[str, int] = {}
                held: list[list] = []
                for i, row in enumerate(cells(content, sheet)):
                    if i < header:
                        continue
                    if i == header:
                        places = {wanted[h.strip().lower()]: k for k, h in enumerate(row) if h and h.strip().lower() in wanted}
                        continue
                    said = [row[places[c]] if c in places and places[c] < len(row) else None for c in columns.values()]
                    said = [None if x is None or x.strip() in ("", nothing) else x.strip() for x in said]
                    if any(x is not None for x in said):
                        held.append([file, i + 1, *said])
                    if len(held) == ROWS:
                        yield _batch(held, names)
                        held = []
                if held:
                    yield _batch(held, names)

    files = spark.read.format("binaryFile").load(path).select("path", "content").repartition(F.col("path"))
    return files.mapInArrow(read, "file string, row bigint, " + ", ".join(f"`{c}` string" for c in columns.values()))


def _batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * (len(names) - 2)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
