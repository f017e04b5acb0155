"""The data source of workbooks."""

import json
import zipfile
from xml.sax.saxutils import escape

import pytest

from cladeworks.sources import sheets

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def letters(i):
    return chr(65 + i)


def book(path, tables, prefix="", shared=True):
    """A workbook of (name, rows) sheets; text as shared or inline strings."""
    strings, parts = [], []
    p = f"{prefix}:" if prefix else ""
    ns = NS.replace("xmlns=", f"xmlns:{prefix}=") if prefix else NS
    for _, rows in tables:
        lines = []
        for n, row in enumerate(rows):
            out = []
            for i, v in enumerate(row):
                if v is None:
                    continue
                if isinstance(v, str) and shared:
                    strings.append(v)
                    out.append(f'<{p}c r="{letters(i)}{n + 1}" t="s"><{p}v>{len(strings) - 1}</{p}v></{p}c>')
                elif isinstance(v, str):
                    out.append(f'<{p}c r="{letters(i)}{n + 1}" t="inlineStr"><{p}is><{p}t>{escape(v)}</{p}t></{p}is></{p}c>')
                else:
                    out.append(f'<{p}c r="{letters(i)}{n + 1}"><{p}v>{v}</{p}v></{p}c>')
            lines.append(f'<{p}row r="{n + 1}">{"".join(out)}</{p}row>' if out else f'<{p}row r="{n + 1}"/>')
        parts.append(f"<?xml version='1.0'?><{p}worksheet {ns}><{p}sheetData>{''.join(lines)}</{p}sheetData></{p}worksheet>")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i, part in enumerate(parts):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", part)
        z.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>{''.join(f'<sheet name={chr(34)}{escape(n)}{chr(34)} sheetId={chr(34)}{i + 1}{chr(34)} r:id={chr(34)}rId{i + 1}{chr(34)}/>' for i, (n, _) in enumerate(tables))}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(tables))) + "</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>")


HEAD = ("Seq", "Code", "Title", "Size")


def rows_of(n, base=0):
    """Codes of sectors that are merged from several (such as 31-33) are text, the others numbers."""
    return [HEAD] + [(base + i, "31-33" if i % 7 == 0 else 100 + i, f"Title {i} <&> é\nnext" if i % 5 else None, i + 0.5 if i % 3 else "n/a") for i in range(n)]


@pytest.mark.parametrize(("prefix", "shared"), [("", True), ("", False), ("x", True)])
def test_rows_of_all_tasks(spark, tmp_path, prefix, shared):
    sheets.register(spark)
    path = f"{tmp_path}/a.xlsx"
    book(path, [("First", rows_of(25)), ("Second sheet", rows_of(7, 1000)), ("Empty", [HEAD])], prefix, shared)
    df = spark.read.format("sheets").schema("no int, code string, size double, _sheet string").option("headers", json.dumps(["Seq", "Code", "Size"])).option("rows", 10).load(path)
    assert df.rdd.getNumPartitions() == 5
    want = [(r[0], str(r[1]), None if isinstance(r[3], str) else float(r[3]), s) for s, t in (("First", rows_of(25)), ("Second sheet", rows_of(7, 1000))) for r in t[1:]]
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert sum(r.code == "31-33" for r in df.collect()) == 5
    titles = spark.read.format("sheets").option("sheets", "2").load(path)
    assert titles.columns == list(HEAD) and sorted(r.Title or "" for r in titles.collect()) == sorted(r[2] or "" for r in rows_of(7)[1:])


def test_many_workbooks_and_errors(spark, tmp_path):
    sheets.register(spark)
    for n in range(3):
        book(f"{tmp_path}/b{n}.xlsx", [("S", rows_of(4, 10 * n))])
    read = spark.read.format("sheets")
    assert read.schema("Seq int").load(f"{tmp_path}/b*.xlsx").count() == 12
    assert read.schema("Seq int").load(f"{tmp_path}/b0.xlsx,{tmp_path}/b2.xlsx").agg({"Seq": "max"}).first()[0] == 23
    for options, message in (({"sheets": "None"}, "is not in the workbook"), ({"headers": '["Nothing"]'}, "are not in sheet")):
        with pytest.raises(Exception, match=message):
            spark.read.format("sheets").schema("Seq int").options(**options).load(f"{tmp_path}/b0.xlsx").count()
    with pytest.raises(Exception, match="no workbook"):
        spark.read.format("sheets").schema("Seq int").load(f"{tmp_path}/none.xlsx").count()


def test_rows_larger_than_a_read(tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "READ", 37)
    book(f"{tmp_path}/c.xlsx", [("S", rows_of(9))])
    with zipfile.ZipFile(f"{tmp_path}/c.xlsx") as z:
        assert len(list(sheets.raw_rows(z, "xl/worksheets/sheet1.xml"))) == 10


def test_address_is_tried_again(tmp_path, monkeypatch):
    book(f"{tmp_path}/d.xlsx", [("S", rows_of(3))])
    asked = []
    monkeypatch.setattr(sheets, "fetch", lambda url, tries: asked.append((url, tries)) or open(f"{tmp_path}/d.xlsx", "rb").read())
    with sheets.opened("https://host/d.xlsx", 5) as z:
        assert [n for n, _ in sheets.sheet_parts(z)] == ["S"]
    assert asked == [("https://host/d.xlsx", 5)]
