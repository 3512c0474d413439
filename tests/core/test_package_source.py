import random
import resource
import zipfile

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import render_ooxml
from quillgrid.plans import office
from quillgrid.sources import ooxml, package_source

S, R = office.S, office.R


@pytest.fixture
def pushed(spark):
    package_source.register(spark)
    return spark


def book(rows: int, comment: str = "", prefix: str = "") -> bytes:
    rng, x = random.Random(rows), f"{prefix}:" if prefix else ""
    strings = "".join(f"<si><t>shared words {i}</t></si>" for i in range(50))
    cells = "".join(f"<{x}row r='{i}'><{x}c r='A{i}' t='s'><{x}v>{rng.randrange(60)}</{x}v></{x}c><{x}c r='B{i}' t='inlineStr'><{x}is><{x}t>inline {i} &lt;row </{x}t></{x}is></{x}c><{x}c r='C{i}'><{x}v>{i}</{x}v></{x}c></{x}row>" for i in range(1, rows + 1))
    ns = f"xmlns:{prefix}='{S}'" if prefix else f"xmlns='{S}'"
    own = {
        "xl/workbook.xml": f"<workbook xmlns='{S}' xmlns:r='{R}'><sheets><sheet name='One' sheetId='1' r:id='a'/></sheets></workbook>", "xl/_rels/workbook.xml.rels": "<Relationships><Relationship Id='a' Target='worksheets/sheet1.xml'/></Relationships>",
        "xl/sharedStrings.xml": f"<sst xmlns='{S}'>{strings}</sst>", "xl/worksheets/sheet1.xml": f"<{x}worksheet {ns}><{x}sheetData>{comment}{cells}</{x}sheetData><{x}mergeCells/></{x}worksheet>",
    }
    return render_ooxml.zipped({k: v.encode() for k, v in own.items()})


def put(folder, files: dict[str, bytes]) -> str:
    for name, data in files.items():
        (folder / name).write_bytes(data)
    return str(folder)


def plain(spark, path):
    return sorted(tuple(r) for r in ooxml.package_units(ooxml.packages(spark, path)).collect())


@pytest.mark.parametrize(("split", "comment"), [(32 << 20, ""), (300, ""), (1000, "<!-- <row r='1'> -->"), (64, "")])
def test_lines_equal_whole_packages(pushed, tmp_path, split, comment):
    path = put(tmp_path, {"a.xlsx": book(200, comment), "b.xlsx": book(40, prefix="x"), "c.xlsx": book(0)})
    assert sorted(tuple(r) for r in package_source.lines(pushed, path, splitBytes=split).collect()) == plain(pushed, path)
    if split < 500:
        assert len(package_source.Reader({"path": path, "splitbytes": str(split)}).partitions()) > 20


def test_given_documents_read_alike(pushed, tmp_path):
    made = office.made(office.lined(pushed, "/root/testdata/sf0.001").orderBy("doc_id").limit(60))
    for r in made.select("doc_id", "content").collect():
        (tmp_path / f"{r.doc_id}.{'docx' if r.doc_id % 2 == 0 else 'xlsx'}").write_bytes(r.content)
    got = package_source.lines(pushed, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == plain(pushed, str(tmp_path))


def test_broken_files_are_rows_and_options_leave_files_out(pushed, tmp_path):
    good = book(5)
    with zipfile.ZipFile(tmp_path / "bomb.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", b" " * 100_000)
    bad = render_ooxml.zipped({"word/document.xml": b"<w:document>"})
    declared = render_ooxml.zipped({"xl/sharedStrings.xml": b"<!DOCTYPE x [<!ENTITY a 'b'>]><sst/>"})
    path = put(tmp_path, {"good.xlsx": good, "torn.xlsx": good[: len(good) // 2], "text.docx": b"no package", "bad.docx": bad, "notes.pdf": b"%PDF", "declared.xlsx": declared})
    pieces = pushed.read.format("packages").option("mostBytes", 50_000).load(path)
    told = {r.path.rpartition("/")[2]: r.error for r in pieces.where("kind = 'error'").collect()}
    assert set(told) == {"torn.xlsx", "text.docx", "bad.docx", "notes.pdf", "bomb.xlsx", "declared.xlsx"}
    assert "unpack" in told["bomb.xlsx"] and "type declaration" in told["declared.xlsx"]
    assert pieces.where("kind = 'cell'").count() == 15
    only = pushed.read.format("packages").options(part="xl/sharedStrings.xml", ext="xlsx", kind="string").load(path)
    assert only.where("kind <> 'error'").count() == 50
    reader = package_source.Reader({"path": path, "ext": "docx"})
    assert sorted(p.place.rpartition("/")[2] for t in reader.partitions() for p in t.pieces) == ["bad.docx", "text.docx"]


def test_a_large_sheet_is_streamed_in_ranges(pushed, tmp_path):
    rows = "".join(f"<row r='{i}'><c r='A{i}' t='inlineStr'><is><t>{'some words of a long cell ' * 4}{i}</t></is></c></row>" for i in range(200_000))
    path = put(tmp_path, {"big.xlsx": render_ooxml.zipped({"xl/worksheets/sheet1.xml": f"<worksheet xmlns='{S}'><sheetData>{rows}</sheetData></worksheet>".encode()})})
    del rows
    reader = package_source.Reader({"path": path, "splitbytes": str(4 << 20)})
    tasks = reader.partitions()
    assert len(tasks) >= 7
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert sum(b.num_rows for b in reader.read(tasks[3])) > 10_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000
    pieces = pushed.read.format("packages").option("splitBytes", 4 << 20).load(path)
    assert pieces.agg(F.count("*"), F.countDistinct("place")).first() == (200_000, 200_000)
