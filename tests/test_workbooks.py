"""Workbooks as a data source: sheets out of order, several, empty, and asked for by name."""

import zipfile

from folioflow.sources import files, workbooks


def book(path, sheets, order):
    """sheets: title -> rows; order: the titles in the order of their files."""
    cell = lambda x: f'<c t="inlineStr"><is><t>{x}</t></is></c>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets>' + "".join(f'<sheet name="{t}" r:id="id{t}"/>' for t in sheets) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="id{t}" Target="worksheets/sheet{i + 1}.xml"/>' for i, t in enumerate(order)) + "</Relationships>")
        for i, t in enumerate(order):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", "<worksheet><sheetData>" + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in sheets[t]) + "</sheetData></worksheet>")


def test_sheets_by_relation_and_by_name(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    book(tmp_path / "a.xlsx", {"One": [["k", "v"], ["1", "x"], ["2"]], "Two": [["k"], ["3"]], "None": []}, ["Two", "None", "One"])
    book(tmp_path / "deep" / "b.xlsx", {"Two": [["k", "7"], ["4", "y", "z"]]}, ["Two"])
    (tmp_path / "c.txt").write_text("no book")
    workbooks.register(spark)
    rows = spark.read.format("workbooks").load(str(tmp_path))
    show = lambda df: sorted((r.file.rsplit("/", 1)[1], r.sheet, r.row_idx, r.headers, r.cells) for r in df.collect())
    want = [("a.xlsx", "One", 0, ["k", "v"], ["1", "x"]), ("a.xlsx", "One", 1, ["k", "v"], ["2", ""]), ("a.xlsx", "Two", 0, ["k"], ["3"]), ("b.xlsx", "Two", 0, ["k", "column_1"], ["4", "y"])]
    assert show(rows) == want
    assert show(rows.filter("sheet = 'Two' and row_idx = 0")) == want[2:]
    assert show(rows.filter("sheet = 'One' and sheet = 'Two'")) == [] == show(rows.filter("sheet = 'Three'"))
    assert show(files.read_xlsx_rows(spark, str(tmp_path / "*.xlsx"))) == want[:3]
    assert show(files.read_xlsx_rows(spark, str(tmp_path / "*.xlsx"), "One")) == want[:2]


def test_the_reader_takes_the_sheet_alone():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = workbooks._Reader("/nowhere")
    left = list(reader.pushFilters([EqualTo(("sheet",), "a"), GreaterThan(("row_idx",), 3)]))
    assert [type(x) for x in left] == [GreaterThan] and reader.sheet == "a"
