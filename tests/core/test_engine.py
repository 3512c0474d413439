import io
import json
import os
import random
import signal
import sys
import threading
import time
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillgrid import background
from quillgrid.engine import Engine
from quillgrid.operators import batching, glossary, provider, render_ooxml, responses, roles
from quillgrid.plans import catalogue, office
from quillgrid.sources import files, ooxml
from quillgrid.sources import ooxml_xml as xml
from quillgrid.streaming import ingest

W, S, R = office.W, office.S, office.R
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module


def harbour_workbook() -> bytes:
    """Two sheets, the second very hidden: plain, rich, inline and computed cells, one string used twice, one out of range."""
    strings = ["<si><t>Crane number four lifts the red container</t></si>", "<si><r><t>Berth </t></r><r><rPr><i/></rPr><t>fees apply</t></r></si>", "<si><t>泊位 berth charges due today</t></si>", "<si><t>Tide table</t></si>"]
    quay = "<row r='2'><c r='B2' t='s'><v>0</v></c><c r='C2'><v>4.5</v></c><c r='D2' t='s'><v>0</v></c></row><row r='5'><c r='B5' t='s' s='1'><v>1</v></c><c r='C5' t='b'><v>1</v></c></row><row r='6'><c r='B6' t='inlineStr'><is><t>Fog signal at night</t></is></c><c r='C6' t='str'><f>B2&amp;\"!\"</f><v>computed words</v></c><c r='D6' t='s'><v>77</v></c></row><row r='9'><c r='B9' t='s'><v>2</v></c><c r='C9' t='str'><v>Pilot boat waiting</v></c></row>".replace('\\"', "&quot;")
    own = {
        "[Content_Types].xml": "<Types/>", "docProps/app.xml": "<Properties/>",
        "xl/workbook.xml": f"<workbook xmlns='{S}' xmlns:r='{R}'><sheets><sheet name='Quay' sheetId='7' r:id='q'/><sheet name='Store' sheetId='9' state='veryHidden' r:id='s'/></sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships><Relationship Id='s' Target='/xl/worksheets/store.xml'/><Relationship Id='q' Target='./worksheets/quay.xml'/></Relationships>",
        "xl/styles.xml": f"<styleSheet xmlns='{S}'><cellXfs count='3'><xf numFmtId='0'/><xf numFmtId='4'><alignment wrapText='true'/></xf><xf numFmtId='2'/></cellXfs></styleSheet>",
        "xl/sharedStrings.xml": f"<sst xmlns='{S}' count='5' uniqueCount='4'>{''.join(strings)}</sst>",
        "xl/worksheets/quay.xml": f"<worksheet xmlns='{S}'><sheetData>{quay}</sheetData><mergeCells><mergeCell ref='F1:G2'/><mergeCell ref='F4:G4'/></mergeCells><hyperlinks><hyperlink ref='B2'/></hyperlinks></worksheet>",
        "xl/worksheets/store.xml": f"<worksheet xmlns='{S}'><sheetData><row r='3'><c r='A3' t='s' s='2'><v>3</v></c></row></sheetData></worksheet>", "xl/vbaProject.bin": "compiled",
    }
    return render_ooxml.zipped({k: v.encode() for k, v in own.items()})


def word_document() -> bytes:
    body = "<w:p><w:pPr><w:tabs><w:tab w:val='left'/></w:tabs><w:numPr><w:numId w:val='3'/></w:numPr></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>灯塔</w:t></w:r><w:r><w:tab/><w:t>守望海面</w:t></w:r></w:p><w:p><w:r><w:t>码头上的工人</w:t></w:r><w:r><w:pict><w:txbxContent><w:p><w:r><w:t>框里写着潮汐</w:t></w:r></w:p></w:txbxContent></w:pict></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>吊车六号</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    return render_ooxml.zipped({"[Content_Types].xml": b"<Types/>", "word/document.xml": f"<w:document xmlns:w='{W}' xmlns:w14='urn:x' xmlns:mc='urn:mc' mc:Ignorable='w14'><w:body>{body}<w:sectPr/></w:body></w:document>".encode(), "word/header1.xml": f"<w:hdr xmlns:w='{W}'><w:p><w:r><w:t>港口日志第九页</w:t></w:r></w:p></w:hdr>".encode()})


class Clerk:
    """Answers in the wanted script and writes down what it was shown."""

    def __init__(self, notes: str, terms: list | None = None, replace: str | None = None):
        self.notes, self.terms, self.replace = notes, terms or [], replace

    def answer(self, system: str, prompt: str) -> str:
        with open(self.notes, "a", encoding="utf-8") as f:
            f.write(json.dumps([system, prompt]) + "\n")
        items = json.loads(prompt.rpartition("Items:\n")[2])
        done = [{"id": i["id"], "source_hash": i["source_hash"], "status": "replace" if self.replace else "ok", "target": self.replace or (f"Words number {i['unit_ord']}" if i["direction"] == "zh-to-en" else f"译文{i['unit_ord']}")} for i in items]
        return "<think>{hm}</think>\n```json\n" + json.dumps({"terms": self.terms, "items": done}, ensure_ascii=False) + "\n```"


def members(content: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {n: z.read(n) for n in z.namelist()}


def test_whole_run_over_packages(spark, tmp_path):
    inputs, notes = tmp_path / "in", tmp_path / "notes"
    inputs.mkdir()
    (inputs / "harbour.xlsm").write_bytes(harbour_workbook())
    (inputs / "list.docx").write_bytes(word_document())
    (inputs / "note.txt").write_text("no")
    (inputs / "scan.pdf").write_bytes(b"%PDF-1.7")
    engine = Engine(spark, str(tmp_path / "work"))
    manifest = {r.unit_count: r for r in engine.prepare(str(inputs)).collect()}
    assert manifest[7].document_direction == "en-to-zh" and manifest[7].translatable_count == 6
    assert manifest[5].document_direction == "zh-to-en" and manifest[5].english_copy_required
    assert {"unsupported file type: txt", "unsupported file type: pdf"} <= {r.error for r in engine.read("files").collect()}
    (tmp_path / "terms.json").write_text(json.dumps({"terms": [{"source": "码头", "target": "quay"}, {"source": "Zebra crossing", "target": "斑马线"}, {"source": " crane ", "target": "吊车"}]}, ensure_ascii=False))
    result = engine.run(Clerk(str(notes), [{"source": "Crane", "target": "吊车", "notes": "found"}, {"source": "anchor", "target": "锚", "context_unit_ids": ["u1", "u2"]}]), limit=2, supplied=str(tmp_path / "terms.json")).collect()
    assert len(result) == 2 and all(r.passed and r.phase == "complete" and r.contract_version == 3 for r in result), result
    assert {(r.original_units, r.output_units, r.requested_replacements) for r in result} == {(7, 7, 0), (5, 10, 5)}
    assert all(r.ok for r in engine.validate().collect())
    files = {r.doc_id: r for r in engine.read("bilingual_files").collect()}
    assert all(r.requested == r.inserted for r in files.values())
    ext = {r.doc_id: r.ext for r in engine.read("files").collect()}
    book = next(members(r.content) for i, r in files.items() if ext[i] == "xlsm")
    texts = [t for _, t in xml.shared_strings(book["xl/sharedStrings.xml"])]
    assert texts[0] == "Crane number four lifts the red container" and texts[0] + "\n译文0" in texts and texts[0] + "\n译文1" in texts
    assert b"mergeCell ref=\"F4:G4\"" in book["xl/worksheets/quay.xml"] and book["xl/vbaProject.bin"] == b"compiled"
    wraps = dict(xml.cell_formats(book["xl/styles.xml"]))
    cells = {c[1]: c for c in xml.cells(book["xl/worksheets/quay.xml"])}
    assert all(wraps[int(cells[r][3])] in ("1", "true") for r in ("B2", "D2", "B5", "B6", "C9")) and cells["B5"][3] == "1" and cells["B9"][3] == "0"
    assert cells["C9"][4].startswith("Pilot boat waiting\n译文") and cells["C6"][4] == "computed words"
    word = next(members(r.content) for i, r in files.items() if ext[i] == "docx")
    lines = [t for _, t in xml.paragraph_texts(word["word/document.xml"])]
    assert lines[0] == "灯塔\t守望海面" and lines[1].startswith("Words number") and "框里写着潮汐" in lines
    assert b"mc:Ignorable" in word["word/document.xml"] and b'w:numId w:val="0"' in word["word/document.xml"]
    english = next(members(r.content) for r in engine.read("english_files").collect())
    assert all(xml.paragraph_texts(english["word/document.xml"])[k][1].startswith("Words number") for k in (0, 1, 2))
    # supplied terms win, are sorted by folded source, and stand in a file with a byte order mark
    locked = engine.read("glossary").orderBy("ord").collect()
    assert [(r.source, r.target) for r in locked] == [("anchor", "锚"), ("crane", "吊车"), ("Zebra crossing", "斑马线"), ("码头", "quay")]
    csv = next((tmp_path / "work" / "glossary.csv").glob("part-*.csv")).read_bytes()
    assert csv.startswith("\ufeffsource,target,direction,domain,definition,context_unit_ids,confidence,notes\n".encode()) and "锚,auto,,,\"u1,u2\",medium," in csv.decode()
    # prompts carry the terms, those that occur first, and reviews the translation as well
    seen = [json.loads(x) for x in notes.read_text("utf-8").splitlines()]
    shown = [p for s, p in seen if "Glossary:" in p]
    assert sum("Glossary:" not in p for _, p in seen) == 6 and len(shown) == 12
    crane = [json.loads(p.split("Glossary:\n")[1].split("\n")[0]) for p in shown if "Crane number four" in p]
    assert crane and all(t[0]["source"] == "crane" and len(t) == 4 for t in crane)
    reviews = [json.loads(p.rpartition("Items:\n")[2]) for s, p in seen if "status is ok" in s]
    assert reviews and all(i["target"].startswith(("Words number", "译文")) for items in reviews for i in items)
    report = {r.doc_id: r.report for r in engine.read("report").collect()}
    assert all("- Result: **PASS**" in r for r in report.values()) and sum("## Pure English copy" in r for r in report.values()) == 1
    names = {r.bilingual.rsplit("/", 1)[1]: r for r in engine.read("artefacts").collect()}
    assert set(names) == {"harbour.bilingual.xlsm", "list.bilingual.docx"} and names["list.bilingual.docx"].english.endswith("/list/list.english.docx") and names["harbour.bilingual.xlsm"].english is None
    delivered = {r.path: r.bytes for r in engine.deliver(str(tmp_path / "out")).collect()}
    there = {"/" + str(p.relative_to(tmp_path / "out")): p for p in (tmp_path / "out").rglob("*") if p.is_file() and p.suffix != ".crc"}
    assert there.pop("/delivered.jsonl")
    assert set(there) == set(delivered) == {f"/harbour/harbour.{x}" for x in ("bilingual.xlsm", "glossary.csv", "qa-report.md", "qa.json")} | {f"/list/list.{x}" for x in ("bilingual.docx", "english.docx", "glossary.csv", "qa-report.md", "qa.json")}
    assert all(p.stat().st_size == delivered[n] for n, p in there.items())
    assert members(there["/harbour/harbour.bilingual.xlsm"].read_bytes()) == book and there["/list/list.glossary.csv"].read_bytes() == csv
    assert json.loads(there["/list/list.qa.json"].read_text("utf-8"))["passed"] and "**PASS**" in there["/list/list.qa-report.md"].read_text("utf-8")
    assert {r.path for r in engine.deliver(str(tmp_path / "flat"), flat=True).collect()} == {"/" + n.rsplit("/", 1)[1] for n in there}
    engine.export_units(str(tmp_path / "units.jsonl"))
    assert spark.read.json(str(tmp_path / "units.jsonl")).count() == 12
    # a second run would find nothing to ask
    assert engine.next_batches("translation").count() == 0 and engine.open_batches("review").count() == 0


def test_a_repeated_ingest_changes_nothing_and_fenced_reviews_keep_their_corrections(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "work"))
    engine.prepare_lines(spark.createDataFrame([(1, 0, "The gate is open now"), (1, 1, "A second plain line")], "doc_id bigint, idx int, text string"))

    def answer(phase, clerk):
        payloads = spark.createDataFrame(engine.open_batches(phase).collect(), engine.open_batches(phase).schema)
        content = clerk.answer("", "Items:\n" + payloads.first()["items"])
        return payloads, spark.createDataFrame([(1, 0, content)], "doc_id bigint, batch_no int, content string")

    notes = str(tmp_path / "notes")
    for phase, clerk in (("analysis", Clerk(notes)), ("translation", Clerk(notes)), ("review", Clerk(notes, replace="新的"))):
        payloads, raw = answer(phase, clerk)
        for _ in range(2):
            assert [r.accepted for r in engine.ingest(phase, payloads, raw).collect()] == [True]
        if phase == "analysis":
            engine.lock_glossary()
    assert engine.read("translations").count() == 2 and engine.read("events").count() == 6
    assert {r.target for r in engine.targets().collect()} == {"新的"}
    assert engine.finalize().first().passed and engine.read("bilingual").count() == 2


def test_a_broken_table_is_not_an_empty_one(spark, tmp_path):
    from pyspark.errors import AnalysisException

    engine = Engine(spark, str(tmp_path))
    (tmp_path / "terms").mkdir()
    assert engine.read("events", "doc_id bigint").count() == 0
    with pytest.raises(AnalysisException):
        engine.read("terms", "doc_id bigint")


def test_json_objects_of_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"phase": "review",\n "n": 3}\n')
    read = lambda name, default=None: files.read_objects(spark, str(tmp_path / name), "struct<phase:string,n:int>", default).collect()
    assert [(r.path.endswith("/a.json"), r.value.phase, r.value.n) for r in read("a.json")] == [(True, "review", 3)]
    assert [(r.path, r.value.n) for r in read("none.json", '{"n": 0}')] == [(None, 0)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read("none.json")
    for bad in ("[1]", "{", ""):
        (tmp_path / "bad.json").write_text(bad + "\n")
        with pytest.raises(Exception, match="expected a JSON object in .*bad.json"):
            read("bad.json", "{}")


def test_two_inputs_of_one_name_are_not_delivered(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "work"))
    spark.createDataFrame([(1, True, True), (2, True, True)], "doc_id int, english_required boolean, passed boolean").write.parquet(str(tmp_path / "work/qa"))
    spark.createDataFrame([(1, "/in/a/plan.docx"), (2, "/in/b/plan.docx")], "doc_id int, path string").write.parquet(str(tmp_path / "work/files"))
    with pytest.raises(ValueError, match="several inputs"):
        engine.deliver(str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_older_units_get_their_flags(spark):
    rows = [(1, "灯塔守望海面", "zh-to-en", True), (1, "Harbour notes", "keep", False), (2, "Harbour notes for crews", "en-to-zh", True)]
    units = spark.createDataFrame([(d, f"u{i}", t, t, x, k) for i, (d, t, x, k) in enumerate(rows)], "doc_id int, id string, text string, normalized_text string, direction string, translatable boolean")
    got = {r.id: (r.document_direction, r.bilingual_output, r.english_output) for r in roles.completed(units).collect()}
    assert got == {"u0": ("zh-to-en", True, True), "u1": ("zh-to-en", False, False), "u2": ("en-to-zh", True, False)}


def test_an_answer_without_an_id_rejects_its_batch(spark):
    items = spark.createDataFrame([(1, 0, "a", "h")], "doc_id int, batch_no int, id string, source_hash string")
    answers = spark.createDataFrame([(1, 0, 0, "a", "h", "x"), (1, 0, 1, None, None, "y")], "doc_id int, batch_no int, item_pos int, id string, source_hash string, target string")
    assert [tuple(r) for r in responses.id_differences(items, answers).collect()] == [(1, 0, "", "null")]
    assert responses.accepted_translations(items, answers).count() == 0
    assert [tuple(r) for r in responses.accepted_translations(items, answers.where("id IS NOT NULL")).collect()] == [(1, "a", "x")]


def test_a_glossary_file_must_hold_terms(spark, tmp_path):
    for text, ok in (('[{"source": "a", "target": "b"}]', True), ('{"terms": []}', True), ('{"other": 1}', False), ('"x"', False)):
        (tmp_path / "g.json").write_text(text)
        if ok:
            glossary.read_terms(spark, str(tmp_path / "g.json")).collect()
        else:
            with pytest.raises(Exception, match="glossary must be"):
                glossary.read_terms(spark, str(tmp_path / "g.json")).collect()


def test_relevant_terms_fill_up_to_the_cap(spark):
    terms = spark.createDataFrame([(i, f"term{i:03d}", f"Ziel{i:03d}") for i in range(100)], "ord bigint, source string, target string")
    batches = spark.createDataFrame([(1, "TERM099 and ziel050"), (2, None), (3, " ".join(f"term{i:03d}" for i in range(20, 90)))], "batch bigint, text string")
    got = {}
    for r in glossary.relevant(terms, batches).collect():
        got.setdefault(r.batch, []).append((r.source, r.matched))
    assert sorted(s for s, m in got[1] if m) == ["term050", "term099"] and sorted(s for s, m in got[1] if not m) == sorted(f"term{i:03d}" for i in [*range(50), *range(51, 59)])
    assert len(got[2]) == 60 and not any(m for _, m in got[2]) and len(got[3]) == 70 and all(m for _, m in got[3])


def test_occurrences_equal_containment(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcé水") for _ in range(n))
    texts = [(i, word(rng.randrange(0, 400))) for i in range(60)] + [(99, None)]
    spellings = sorted({word(rng.choice((1, 2, 3, 4, 5, 7, 9, 13, 20))) for _ in range(300)} | {t[5:90] for _, t in texts[:20] if t and len(t) > 90})
    own = spark.createDataFrame(list(enumerate(spellings)), "term int, spelling string")
    got = glossary.occurrences(own, spark.createDataFrame(texts, "batch int, text string")).distinct()
    want = {(b, k) for b, t in texts for k, x in enumerate(spellings) if t and x and x in t}
    assert {tuple(r) for r in got.collect()} == want and any(len(spellings[k]) > 64 for _, k in want)


@pytest.mark.parametrize("most", (0, 24))
def test_texts_are_looked_through_in_bounded_stretches(spark, monkeypatch, most):
    monkeypatch.setattr(glossary, "STRETCH", 50)
    monkeypatch.setattr(glossary, "MOST_LENGTHS", most)  # by anchors, and by whole spellings
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rng = random.Random(6)
    texts = [(None, "x ab"), *((i, "".join(rng.choice("ab水") for _ in range(rng.randrange(0, 300)))) for i in range(30))]
    spellings = sorted({t[k : k + n] for _, t in texts for k, n in ((0, 3), (45, 9), (48, 5), (90, 70))} - {""})
    parts = list(glossary._stretches([t for _, t in texts], 69))
    assert max(sum(len(x) for _, x in part) for part in parts) <= 50 + 69 and any(len(part) > 1 for part in parts)
    got = glossary.occurrences(spark.createDataFrame(list(enumerate(spellings)), "term int, spelling string"), spark.createDataFrame(texts, "batch int, text string")).distinct()
    assert {tuple(r) for r in got.collect()} == {(b, k) for b, t in texts for k, x in enumerate(spellings) if x in t}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "2m"


def test_a_large_glossary_stays_off_the_driver(spark, monkeypatch):
    for few in ((0, 0), glossary.FEW):  # joined by a shuffle, and broadcast where it is small
        monkeypatch.setattr(glossary, "FEW", few)
        terms = spark.range(200_000).selectExpr("id AS ord", "concat('term ', id, ' end') AS source", "concat('Ziel ', id, ' aus') AS target")
        batches = spark.createDataFrame([(1, "see term 77 end and ziel 199999 aus"), (2, "nothing")], "batch bigint, text string")
        got = {(r.batch, r.source) for r in glossary.relevant(terms, batches, 2).where("matched").collect()}
        assert got == {(1, "term 77 end"), (1, "term 199999 end")}


def test_skipped_rows_survive_a_refresh(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "harbour.xlsx").write_bytes(harbour_workbook())
    engine = Engine(spark, str(tmp_path / "work"))
    engine.prepare(str(tmp_path / "in"))
    for spec in ("2-5", None, " 2-5 "):
        assert engine.refresh_roles(spec).first().translatable_count == 2
    with pytest.raises(ValueError, match="leaves out the rows 2-5"):
        engine.refresh_roles("3")


def test_rows_can_be_left_out_of_fresh_excel_jobs_only(spark, tmp_path):
    plain = Engine(spark, str(tmp_path / "plain"))
    plain.prepare_lines(spark.createDataFrame([(1, 0, "The gate is open now")], "doc_id bigint, idx int, text string"))
    with pytest.raises(ValueError, match="Excel"):
        plain.refresh_roles("1")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "harbour.xlsx").write_bytes(harbour_workbook())
    engine = Engine(spark, str(tmp_path / "work"))
    engine.prepare(str(tmp_path / "in"))
    with pytest.raises(Exception, match="bad row range"):
        engine.refresh_roles("0-x")
    payloads = spark.createDataFrame(engine.open_batches("analysis").collect(), engine.open_batches("analysis").schema)
    doc = payloads.first().doc_id
    engine.ingest("analysis", payloads, spark.createDataFrame([(doc, 0, '{"terms": []}')], "doc_id string, batch_no int, content string"))
    with pytest.raises(ValueError, match="before the first answer"):
        engine.refresh_roles("2-5")


class Moody:
    """Answers for all documents but one."""

    def answer(self, system: str, prompt: str) -> str:
        items = json.loads(prompt.rpartition("Items:\n")[2])
        if any("hopeless" in i["text"] for i in items) and "source_hash" in system:
            return "no object at all"
        return json.dumps({"terms": [], "items": [{"id": i["id"], "source_hash": i["source_hash"], "status": "ok", "target": "译文"} for i in items]}, ensure_ascii=False)


def test_a_stuck_document_does_not_hold_up_the_others(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "work"))
    lines = [(1, 0, "The gate is open now"), (2, 0, "A hopeless line of words"), (3, 0, "Another plain line here")]
    engine.prepare_lines(spark.createDataFrame(lines, "doc_id bigint, idx int, text string"))
    assert {r.state for r in engine.phase_states("translation").collect()} == {"waiting"}
    qa = {r.doc_id: r.passed for r in engine.run(Moody()).collect()}
    assert qa == {1: True, 3: True}
    assert [(r.doc_id, r.lacking) for r in engine.read("unfinished").collect()] == [(2, 1)]
    assert [(r.doc_id, r.phase, r.batches) for r in engine.read("stuck").collect()] == [(2, "translation", 1)]
    states = {r.doc_id: r.state for r in engine.phase_states("translation").collect()}
    assert states == {1: "complete", 2: "open", 3: "complete"}
    assert {r.doc_id: r.passed for r in engine.run(provider.Echo("译")).collect()} == {1: True, 2: True, 3: True}  # it goes on later


def test_a_broken_package_is_rejected_alone(spark, tmp_path):
    (tmp_path / "in").mkdir()
    book = harbour_workbook()
    for name, data in (("good.xlsx", book), ("torn.xlsx", book[: len(book) // 2]), ("bad.docx", render_ooxml.zipped({"word/document.xml": b"<open>"}))):
        (tmp_path / "in" / name).write_bytes(data)
    counts = []
    for k, prepare in enumerate(("prepare", "prepare_streamed")):
        engine = Engine(spark, str(tmp_path / f"work{k}"))
        counts.append([(r.doc_id, r.unit_count, r.translatable_count) for r in getattr(engine, prepare)(str(tmp_path / "in")).collect()])
        told = {r.path.rpartition("/")[2]: r.error for r in engine.read("files").collect()}
        assert told["good.xlsx"] is None and "BadZipFile" in told["torn.xlsx"] and "ExpatError" in told["bad.docx"]
    assert counts[0] == counts[1] and len(counts[0]) == 1


class Stub(BaseHTTPRequestHandler):
    def do_GET(self):
        self._reply({"data": []})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.server.seen.append((self.path, self.headers.get("Authorization"), body))
        if len(self.server.seen) == 1:
            self.send_error(503)
            return
        items = json.loads(body["messages"][1]["content"].rpartition("Items:\n")[2])
        done = {"terms": [], "items": [{"id": i["id"], "source_hash": i["source_hash"], "status": "ok", "target": "T " + i["text"]} for i in items]}
        self._reply({"choices": [{"message": {"content": f"```json\n{json.dumps(done)}\n```"}}]})

    def _reply(self, value):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(value).encode())

    def log_message(self, *args):
        pass


def test_a_server_answers_over_http(spark, tmp_path, monkeypatch):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    server.seen = []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("STUB_KEY", "k1")
    monkeypatch.setenv("http_proxy", "http://127.0.0.1:9")
    own = provider.Http(f"http://127.0.0.1:{server.server_port}/v1/", "m", "STUB_KEY", max_tokens=512, extra={"seed": 3})
    assert own.available() and not provider.Http("http://127.0.0.1:9", "m").available()
    answer, tries, trouble = provider.ask(own, "translation", [{"id": "a", "source_hash": "h", "text": "x"}], glossary=[{"source": "s"}])
    assert json.loads(answer)["items"][0]["target"] == "T x" and (tries, trouble) == (2, "")
    path, key, body = server.seen[-1]
    assert path == "/v1/chat/completions" and key == "Bearer k1" and body["model"] == "m" and body["max_tokens"] == 512 and body["seed"] == 3
    assert "503" in body["messages"][1]["content"] and '"source": "s"' in body["messages"][1]["content"]
    engine = Engine(spark, str(tmp_path / "work"))
    engine.prepare_lines(spark.createDataFrame([(1, 0, "The gate is open now")], "doc_id bigint, idx int, text string"))
    assert engine.run(own).first().passed
    server.shutdown()
    for bad in ({"model": ""}, {"model": "m", "max_tokens": 255}):
        with pytest.raises(ValueError):
            provider.Http("http://x", **bad)


def test_jobs_run_on_their_own_and_resume(tmp_path):
    work = tmp_path / "job"
    assert background.status(work)["status"] == "not-found"
    code = "import sys, time; sys.path.insert(0, sys.argv[2]); from pathlib import Path; from quillgrid import background as b\np = Path(sys.argv[1]) / 'tries'; n = int(p.read_text()) if p.exists() else 0; p.write_text(str(n + 1)); print('try', n, flush=True); b.note_progress(sys.argv[1], {'analysis': n})\nif n == 0: time.sleep(60)\nif n == 1: sys.exit(3)\nb.note_verdict(sys.argv[1], True)"
    command = [sys.executable, "-c", code, str(work), str(Path(background.__file__).parents[1])]
    first = background.start(work, "in.docx", command)
    assert first["launch"] == "started"
    for _ in range(200):
        if background.status(work)["progress"]:
            break
        time.sleep(0.05)
    assert background.status(work)["status"] == "running" and background.start(work, "in.docx", command)["launch"] == "already-running"
    os.killpg(first["worker"], signal.SIGKILL)
    heard = []
    assert background.wait(work, heard.append, 0.05)["status"] == "interrupted"
    assert background.resume(work)["launch"] == "resumed"
    ended = background.wait(work, heard.append, 0.05)
    assert ended["status"] == "failed" and ended["exit"] == 3
    background.resume(work)
    done = background.wait(work, heard.append, 0.05)
    assert done["status"] == "completed" and done["passed"] and "try 2" in done["log"]
    for _ in range(200):  # the check of its output completes a job before its process has ended
        if background.log_tail(work, 1)[0].endswith("ends with 0"):
            break
        time.sleep(0.05)
    assert background.log_tail(work, 2) == ["try 2", background.log_tail(work, 1)[0]]
    marks = [(h["status"], str(h["progress"]), h["run"]) for h in heard]
    assert len(marks) == len(set(marks))
    assert background.start(work, "in.docx", command)["launch"] == "already-completed" and background.resume(work)["launch"] == "already-completed"
    assert background.start(work, "other.docx", [sys.executable, "-c", "pass"])["launch"] == "started"
    again = background.wait(work, every=0.05)
    assert again["status"] == "completed" and not again["passed"]


def test_stale_units_are_not_touched():
    out, done = xml.edit_story(members(word_document())["word/document.xml"], {0: ("other text", "x"), 99: ("y", "z")}, True)
    assert done == 0 and xml.paragraph_texts(out) == xml.paragraph_texts(members(word_document())["word/document.xml"])


def test_structure_tells_changes(spark):
    a, b = harbour_workbook(), members(harbour_workbook())
    b["xl/worksheets/quay.xml"] = b["xl/worksheets/quay.xml"].replace(b"<f>B2", b"<f>B3")
    df = spark.createDataFrame([(1, bytearray(a)), (2, bytearray(render_ooxml.zipped(b)))], "doc_id bigint, content binary")
    rows = {r.doc_id: r for r in ooxml.structure(ooxml.parts(df)).collect()}
    assert rows[1].merged == rows[2].merged == 2 and rows[1].formulas == rows[1].hyperlinks == 1
    assert rows[1].format_signature != rows[2].format_signature and rows[1].parts_digest == rows[2].parts_digest


class Stubborn:
    def __init__(self):
        self.n = 0

    def answer(self, system, prompt):
        self.n += 1
        return "no json" if self.n == 1 else json.dumps({"items": []}) if self.n == 2 else provider.Echo().answer(system, "Items:\n" + prompt.split("\n", 1)[1])


def test_retries_tell_what_was_wrong():
    items = [{"id": "a", "source_hash": "h", "text": "x"}]
    answer, tries, trouble = provider.ask(Stubborn(), "translation", items)
    assert json.loads(answer)["items"][0]["target"] == "T x" and (tries, trouble) == (3, "")
    assert provider.ask(type("No", (), {"answer": lambda *a: "{}"})(), "translation", items)[0] is None


def test_stream_takes_each_file_once(spark, tmp_path):
    items = spark.createDataFrame([(1, 0, "a", "h"), (1, 0, "b", "h"), (2, 0, "c", "h")], "doc_id bigint, batch_no int, id string, source_hash string")
    drop = tmp_path / "drop"
    drop.mkdir()
    good = {"items": [{"id": i, "source_hash": "h", "target": i.upper()} for i in "ab"]}
    (drop / "1.json").write_text(json.dumps({"doc_id": 1, "batch_no": 0, "content": f"```json\n{json.dumps(good)}\n```"}))
    args = (spark, str(drop), items, str(tmp_path / "out"), str(tmp_path / "ck"))
    ingest.start(*args).awaitTermination()
    (drop / "2.json").write_text(json.dumps({"doc_id": 2, "batch_no": 0, "content": json.dumps({"items": [{"id": "c", "source_hash": "stale", "target": "C"}]})}))
    ingest.start(*args).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/accepted"))
    assert {(r.id, r.target) for r in got.collect()} == {("a", "A"), ("b", "B")}
    assert {(r.doc_id, r.accepted) for r in spark.read.parquet(str(tmp_path / "out/verdicts")).collect()} == {(1, True), (2, False)}


def test_packages_of_documents_come_back_whole(spark):
    rows = office.roundtrip(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert len(rows) == 200 and all(r.structure_ok and r.wrong_texts == 0 and r.requested == r.inserted for r in rows)


def test_parts_with_entities_are_refused():
    with pytest.raises(ValueError, match="document type"):
        xml.parse(b"<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>")


def test_a_package_is_read_once_in_one_stage(spark):
    """The round trip moves no rows between tasks, and an array of a document's units is worked out once, not for each unit."""
    plan = office.roundtrip(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution()
    assert "Exchange" not in plan.executedPlan().toString() and len(plan.optimizedPlan().toString()) < 20_000


def test_checks_of_packages_move_each_document_once(spark):
    plan = office.checked_with_faults(spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert text.count("Exchange") == 1 and "Join" not in text and len(plan.optimizedPlan().toString()) < 60_000


def test_roles_in_arrays_are_those_of_rows(spark):
    lines = ["灯塔守望海面", "The tide comes in early", "Open 开放 every single 每天 day", "https://a.b/码头", "12-4", "码头上的工人", "plain words here", "每天 ok"]
    docs = [(i, [lines[(i * j + j // 2) % len(lines)] for j in range(i)]) for i in range(1, 9)]
    rows = spark.createDataFrame([(i, j, x) for i, own in docs for j, x in enumerate(own)], "doc_id bigint, idx int, text string")
    arrays = spark.createDataFrame([(i, [(x, "p", str(j)) for j, x in enumerate(own)]) for i, own in docs], "doc_id bigint, lines array<struct<text:string,part:string,place:string>>")
    names = ["id", "unit_ord", "text", "translatable", "bilingual_output", "english_output", "document_direction"]
    wanted = {tuple(r) for r in roles.with_roles(roles.units_of(rows)).select(*names).collect()}
    got = roles.in_documents(arrays, arrays.lines).collect()
    assert {(u.id, u.unit_ord, u.text, u.translatable, u.bilingual_output, u.english_output, r.document_direction) for r in got for u in r.units} == wanted
    assert len({x[-1] for x in wanted}) == 3


def test_parts_keep_what_stands_around_their_root_and_undeclared_prefixes_are_refused():
    data = f"<?xml version='1.0'?><?mso progid='x'?><!-- top --><w:document xmlns:w='{W}'><!-- in --><w:body><w:p><w:r><w:t>a &amp; b</w:t></w:r></w:p>\n<w:p/></w:body></w:document><!-- end -->".encode()
    out, done = xml.edit_story(data, {0: ("a & b", "c < d")}, True)
    text = out.decode()
    assert done == 1 and text.index("<?mso progid='x'?>") < text.index("<!-- top -->") < text.index("<w:document") < text.index("<!-- in -->") and text.endswith("<!-- end -->")
    assert [t for _, t in xml.paragraph_texts(out)] == ["a & b", "c < d", ""] and "\n<w:p/>" in text
    for bad in (b"<a><b:c/></a>", b"<a b:c='1'/>"):
        with pytest.raises(ValueError, match="declare"):
            xml.parse(bad)


def test_written_archives_hold_their_members():
    own = {"a.xml": b"x", "b/é.xml": bytes(range(256)) * 40, "c": b"", "d": b"y" * 100_000}
    for many in ({}, own):
        for data in (render_ooxml.zipped(many), render_ooxml._zipped64(many)):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == many


def test_packages_are_made_in_small_batches(spark):
    """Python gets documents by bounded batches in every query that makes packages, and structure is told in one row."""
    for name in ("q42_package_units", "q26_structure_counts"):
        for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
            spark.conf.unset(f"spark.sql.execution.arrow.{key}")
        out = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert out.count() > 0 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000" and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_texts_are_counted_once(spark):
    """A filter on counts doesn't work texts out again, and items of batches come without a join."""
    plan = catalogue.QUERIES["q05_existing_bilingual"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 3 and plan.count("regexp_extract_all(") == 1
    units = spark.createDataFrame([(1, f"u{i}", i, "x" * 4000, f"h{i}") for i in range(5)], "doc_id int, id string, unit_ord long, text string, source_hash string")
    own = batching.packed(units, more={"head": F.left("text", F.lit(2)), "source_hash": F.col("source_hash")})
    assert [tuple(r) for r in own.orderBy("unit_ord").collect()] == [(1, f"u{i}", i, i // 2, "xx", f"h{i}", i % 2) for i in range(5)]
    assert "Join" not in own._jdf.queryExecution().optimizedPlan().toString()


def test_plain_archives_are_read_without_zipfile_and_others_as_by_it(monkeypatch):
    own = {"a.xml": b"<a/>" * 300, "b/\u00e9.xml": bytes(range(256)) * 40, "c": b""}
    plain, odd = render_ooxml.zipped(own), io.BytesIO()
    with zipfile.ZipFile(odd, "w", zipfile.ZIP_DEFLATED) as z:
        z.comment = b"note"
        z.writestr("folder/", b"")
        for n, data in own.items():
            z.writestr(n, data)
    assert xml.unzipped(odd.getvalue()) == xml.unzipped(b"#!/bin/sh" + plain) == own
    at = plain.index(b"a.xml") + 5
    for torn in (plain[:-30], plain[: at + 9] + b"\xff\xff\xff" + plain[at + 12 :], b"PK", b""):
        with pytest.raises(ooxml.BROKEN):
            xml.unzipped(torn)
    with pytest.raises(ValueError, match="more than 100 bytes"):
        xml.unzipped(plain, 100)
    monkeypatch.setattr(zipfile, "ZipFile", None)
    assert ooxml.Package(plain).members == own and list(own) == list(xml.unzipped(plain))


def test_checks_read_a_source_once(spark):
    """Units tell all that the checks need of it: packages are read at places for both outputs alone."""
    plan = office.checked_with_faults(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum(x.count("at_places(") for x in plan.splitlines() if "ArrowEvalPython" in x) == 2
