"""Workbooks and archives: several sheets, headers by name, blank rows, status from the sheet, damaged entries, references."""

import zipfile

import pytest
from pyspark.sql import functions as F

from loomspan.functions import catalogues
from loomspan.functions.text import header_key
from loomspan.sources import archives

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, sheets, shared=(), broken=()):
    """A workbook of (name, rows of cell XML)."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        for i, (_, rows) in enumerate(sheets, 1):
            body = "".join(f'<row r="{n}">{r}</row>' for n, r in rows)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}><sheetData>{body}" + ("" if i in broken else "</sheetData></worksheet>"))


def inline(*cells):
    return "".join(f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>' for r, v in cells)


@pytest.fixture
def book(tmp_path):
    path = str(tmp_path / "stash.xlsx")
    workbook(
        path,
        [
            ("In Stash", [(1, inline(("A1", "Yarn Name "), ("C1", "Brand"))), (2, inline(("A2", "Nova"), ("C2", "Drops"))), (3, inline(("A3", "  "))), (5, '<c r="A5" t="s"><v>0</v></c><c r="C5"><v>12.5</v></c>')]),
            ("Other", [(1, inline(("A1", "Brand"), ("B1", "Mood"))), (2, '<c t="inlineStr"><is><r><t>Two </t></r><r><t>runs</t></r></is></c><c t="b"><v>1</v></c>')]),
            ("Empty", []),
        ],
        ["<r><t>Shared </t></r><r><t>text</t></r>"],
    )
    return path


def test_sheets_are_partitions_and_rows_go_by_their_headers(spark, book):
    rows = archives.read_workbook(spark, book)
    assert rows.rdd.getNumPartitions() == 3
    got = {(r["sheet_name"], r["row"]): r["cells"] for r in rows.collect()}
    assert got == {("In Stash", 2): {"Yarn Name": "Nova", "Brand": "Drops"}, ("In Stash", 5): {"Yarn Name": "Shared text", "Brand": "12.5"}, ("Other", 2): {"Brand": "Two runs", "Mood": "true"}}


def test_fields_and_status_from_the_sheet(spark, book):
    rows = archives.workbook_fields(archives.read_workbook(spark, book), catalogues.HEADERS, ("in stash", "all used up"), header_key)
    got = {(r["sheet"], r["row"]): r["fields"] for r in rows.collect()}
    field = catalogues.HEADERS["brand"]
    assert got[0, 2][field] == "Drops" and got[0, 2]["status"] == "In Stash"
    assert got[1, 2] == {field: "Two runs"}


def test_damaged_workbooks_are_reported_and_others_go_on(spark, book, tmp_path):
    workbook(str(tmp_path / "torn.xlsx"), [("A", [(1, inline(("A1", "h"))), (2, inline(("A2", "v")))]), ("B", [(1, inline(("A1", "h"))), (2, inline(("A2", "w")))])], broken=(1,))
    (tmp_path / "none.xlsx").write_bytes(b"no zip at all")
    got = archives.read_workbook(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("file", "/"), -1))
    faults = {(r["file"], r["sheet"]) for r in got.where("fault IS NOT NULL").collect()}
    assert faults == {("none.xlsx", -1), ("torn.xlsx", 0)}
    assert {(r["file"], r["cells"].get("h")) for r in got.where("fault IS NULL AND file = 'torn.xlsx'").collect()} == {("torn.xlsx", "v"), ("torn.xlsx", "w")}
    (tmp_path / "void").mkdir()
    assert archives.read_workbook(spark, str(tmp_path / "void")).count() == 0


@pytest.fixture
def folder(tmp_path):
    for n in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for i in range(20):
                z.writestr(f"img/{i}.png", f"{n}{i}" * 500)
            z.writestr("other/3.png", f"{n} other")
            z.writestr("doc.md", "text")
    data = bytearray((tmp_path / "b.zip").read_bytes())
    with zipfile.ZipFile(tmp_path / "b.zip") as z:
        at = z.getinfo("img/7.png").header_offset
    data[at + 40 : at + 60] = b"\xff" * 20
    (tmp_path / "b.zip").write_bytes(data)
    (tmp_path / "c.zip").write_bytes(b"PK damaged")
    return str(tmp_path)


def test_archives_split_over_partitions_with_faults_for_each_entry(spark, folder):
    rows = archives.read_archive(spark, folder, partitionBytes=5000, mostBytes=1400)
    assert rows.rdd.getNumPartitions() > 5
    got = {(r["file"].rsplit("/", 1)[-1], r["name"]): (r["content"], r["fault"]) for r in rows.collect()}
    assert len(got) == 45 and got["c.zip", ""] == (None, "bad_archive")
    assert got["b.zip", "img/7.png"] == (None, "damaged") and bytes(got["a.zip", "img/7.png"][0]) == b"a7" * 500
    assert {k[1] for k, v in got.items() if v[1] == "too_large"} == {f"img/{i}.png" for i in range(10, 20)}


def test_references_by_path_then_base_name(spark, folder):
    entries = archives.read_archive(spark, folder)
    file = {f.rsplit("/", 1)[-1]: f for (f,) in entries.select("file").distinct().collect()}
    asked = [(file["a.zip"], "img/3.png"), (file["a.zip"], "x/3.png"), (file["a.zip"], "5.png"), (file["a.zip"], "none.png"), (file["b.zip"], "img/7.png")]
    got = archives.resolve_references(spark.createDataFrame(asked, "file string, ref string"), entries).collect()
    assert {r["ref"] if r["file"] == file["a.zip"] else "b": (r["entry"], r["missing"]) for r in got} == {
        "img/3.png": ("img/3.png", False), "x/3.png": ("other/3.png", False), "5.png": ("img/5.png", False), "none.png": (None, True), "b": (None, True),
    }
