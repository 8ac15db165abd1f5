"""Workbooks written here, read back."""

import zipfile
from xml.sax.saxutils import escape

import pytest

from agora.sources import sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, rows, shared=("Question Title", "Schools & roads")):
    """rows: number -> {cell: value}; a value is a number, a text within its cell, or ("s", place among the shared texts)."""

    def cell(at, v):
        if isinstance(v, tuple):
            return f'<c r="{at}" t="s"><v>{v[1]}</v></c>'
        return f'<c r="{at}"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    body = "".join(f'<row r="{n}">{"".join(cell(f"{c}{n}", v) for c, v in cells.items())}</row>' for n, cells in rows.items())
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{''.join(f'<si><t>{escape(t)}</t></si>' for t in shared)}</sst>")


COLUMNS = {"county id": "county_id", "Question Title": "title", "Number": "number", "Absent": "absent"}


def test_sheet_with_a_line_above_its_header(spark, tmp_path):
    header = {"A": " County ID", "C": ("s", 0), "AB": "number"}
    workbook(tmp_path / "a.xlsx", {1: {"A": "About this file"}, 2: header, 3: {"A": 12, "C": ("s", 1), "AB": "CQ 1 "}, 5: {"A": "no data", "C": "Parks"}, 6: {"B": "beside"}, 7: {"AB": ""}})
    workbook(tmp_path / "b.xlsx", {2: header, 3: {"C": "Levy"}})
    got = sheets.sheet_rows(spark, f"file://{tmp_path}/*.xlsx", COLUMNS, header=1).collect()
    assert sorted((r["file"][-6:], r["row"], r["county_id"], r["title"], r["number"], r["absent"]) for r in got) == [("a.xlsx", 3, "12", "Schools & roads", "CQ 1", None), ("a.xlsx", 5, None, "Parks", None, None), ("b.xlsx", 3, None, "Levy", None, None)]


def test_sheet_of_many_rows_and_of_none(spark, tmp_path):
    workbook(tmp_path / "many.xlsx", {1: {"A": "Number"}} | {i: {"A": i} for i in range(2, 12_003)})
    rows = sheets.sheet_rows(spark, f"file://{tmp_path}/many.xlsx", COLUMNS)
    assert rows.count() == 12_001 and rows.selectExpr("sum(int(number) - row)").first()[0] == 0
    workbook(tmp_path / "none.xlsx", {})
    assert sheets.sheet_rows(spark, f"file://{tmp_path}/none.xlsx", COLUMNS).count() == 0
    (tmp_path / "bad.xlsx").write_text("not a workbook")
    with pytest.raises(Exception, match="zip"):
        sheets.sheet_rows(spark, f"file://{tmp_path}/bad.xlsx", COLUMNS).count()
