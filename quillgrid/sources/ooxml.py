"""Office packages as tables: parts, paragraphs, sheets, shared strings, cells and styles."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from quillgrid.functions import text as T
from quillgrid.sources import ooxml_xml as xml


def decoded(cells: DataFrame, shared_strings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Add ``cell_text``: shared strings by position, inline and plain strings; formulas and the rest are null.

    ``by`` are columns of both, such as the package's id, within which positions count.
    """
    at = cells.withColumn("_at", F.when(F.col("t") == "s", F.expr("try_cast(v AS bigint)")))
    own = at.join(shared_strings.withColumnRenamed("idx", "_at"), [*(by or []), "_at"], "left").drop("_at")
    text = F.when(F.col("has_formula"), None).when(F.col("t") == "s", F.col("shared")).when(F.col("t").isin("inlineStr", "str"), F.col("v"))
    return own.withColumn("cell_text", text).drop("shared")


def not_wrapped(cells: DataFrame, styles: DataFrame) -> DataFrame:
    """Cells whose format doesn't wrap; an unreadable format position counts as the first format."""
    own = cells.withColumn("_s", F.coalesce(F.expr("try_cast(s AS bigint)"), F.lit(0)))
    wrapped = styles.where(F.col("wrap").isin("1", "true")).select("idx")
    return own.join(wrapped, F.col("_s") == F.col("idx"), "left_anti").drop("_s")


SUPPORTED = ("docx", "xlsx", "xlsm")
#: What reading a package or part that is torn, encrypted, malformed or too large raises.
BROKEN = (zipfile.BadZipFile, zlib.error, expat.ExpatError, KeyError, ValueError, OSError, EOFError, SyntaxError, NotImplementedError, RuntimeError)
#: Bytes that a package which is held as a whole may unpack to.
MOST_BYTES = 1 << 30
# Fixed value: parts of a Word package that hold text.
STORY = r"^word/(document|header\d+|footer\d+|footnotes|endnotes|comments)\.xml$"


def packages(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path: (doc_id, path, ext, content, sha256, error); other kinds of file carry an error,
    PDF files too, as no reader for them is here."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    out = files.select(F.sha2("path", 256).substr(1, 16).alias("doc_id"), "path", ext.alias("ext"), "content", F.sha2("content", 256).alias("sha256"))
    return out.withColumn("error", F.when(~ext.isin(*SUPPORTED), F.concat(F.lit("unsupported file type: "), ext)))


def parts(files: DataFrame) -> DataFrame:
    """(doc_id, part, bytes) of the members of zip packages; one package at a time is open in a worker."""

    def unzipped(batches):
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if not n.endswith("/")]
                    yield pd.DataFrame({"doc_id": [doc_id] * len(names), "part": names, "bytes": [z.read(n) for n in names]})

    own = files.where(F.col("error").isNull()) if "error" in files.columns else files
    kind = dict(files.dtypes)["doc_id"]
    return own.select("doc_id", "content").mapInPandas(unzipped, f"doc_id {kind}, part string, bytes binary")


def _tables(parts_df: DataFrame, wanted: str, parse, schema: str) -> DataFrame:
    """Rows that ``parse(part, bytes)`` gives for the parts that match a pattern."""

    def parsed(batches):
        for batch in batches:
            rows = [(doc_id, part, *row) for doc_id, part, data in zip(batch["doc_id"], batch["part"], batch["bytes"], strict=True) for row in parse(part, data)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "part", *(x.split()[0] for x in schema.split(", "))])

    kind = dict(parts_df.dtypes)["doc_id"]
    return parts_df.where(F.col("part").rlike(wanted)).mapInPandas(parsed, f"doc_id {kind}, part string, {schema}")


def sheets(parts_df: DataFrame) -> DataFrame:
    """(doc_id, sheet_ord, sheet, state, part): sheets of the workbook joined to their targets by relation id."""
    books = _tables(parts_df, r"^xl/workbook\.xml$", lambda _, data: xml.sheets(data), "sheet_ord int, sheet string, state string, rel string").drop("part")
    rels = _tables(parts_df, r"^xl/_rels/workbook\.xml\.rels$", lambda _, data: xml.relations(data), "rel string, target string").drop("part")
    return books.join(rels, ["doc_id", "rel"]).select("doc_id", "sheet_ord", "sheet", "state", T.resolve_part(F.lit("xl/workbook.xml"), "target").alias("part"))


def structure(parts_df: DataFrame) -> DataFrame:
    """One row of counts and digests for each package, for comparing a source with its output."""
    counted = _tables(parts_df, r"\.xml$|^word/media/|^xl/vbaProject", lambda part, data: [xml.structure(part, data)], "media int, tables int, sections int, merged int, validations int, conditional_formats int, hyperlinks int, formulas int, signature string")
    sums = [F.sum(c).alias(c) for c in ("media", "tables", "sections", "merged", "validations", "conditional_formats", "hyperlinks", "formulas")]
    signed = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("part", F.lit("="), "signature"))), "\n"), 256)
    names = parts_df.groupBy("doc_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("part")), "\n"), 256).alias("parts_digest"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet_ord", "sheet", "state"))), lambda x: F.concat(x["sheet"], F.lit("="), x["state"])), "\n")
    books = sheets(parts_df).groupBy("doc_id").agg(F.sha2(listed, 256).alias("sheets_digest"))
    return counted.groupBy("doc_id").agg(*sums, signed.alias("format_signature")).join(names, "doc_id").join(books, "doc_id", "left")


_TEXT, _SHEET, _SIGNED = re.compile("[^" + T.python_class(T.SPACES)[1:]), re.compile(r"^xl/worksheets/[^/]+\.xml$"), re.compile(r"\.xml$|^word/media/|^xl/vbaProject")
_STORY, _WHOLE = re.compile(STORY), re.compile(r"[+-]?[0-9]+")
COUNTS = ["media", "tables", "sections", "merged", "validations", "conditional_formats", "hyperlinks", "formulas"]
LINE = "struct<text:string,part:string,place:string,depth:int>"
STRUCTURE = f"struct<{','.join(f'{c}:bigint' for c in COUNTS)},format_signature:string,parts_digest:string,sheets_digest:string>"
#: What stands at a place: its text, whether its cell's format doesn't wrap, and how many paragraphs it stands in.
FOUND = "struct<text:string,flat:boolean,depth:int>"


def _whole(s: str | None) -> int | None:
    return int(s) if s is not None and _WHOLE.fullmatch(s := s.strip()) else None


def _resolved(target: str) -> str:
    """Target of a relation of the workbook, as ``text.resolve_part`` has it."""
    if target.startswith("/"):
        return target.lstrip("/")
    steps: list[str] = []
    for x in f"xl/{target}".split("/"):
        if x == ".." and steps:
            steps.pop()
        elif x not in ("", "."):
            steps.append(x)
    return "/".join(steps)


class Package:
    """A package that is unzipped once, each part of it parsed once at most."""

    def __init__(self, content: bytes):
        self.members = xml.unzipped(content, MOST_BYTES)
        self._parsed: dict[str, xml.Part] = {}
        self._cells: dict[str, list] = {}

    def _part(self, name: str) -> xml.Part:
        if name not in self._parsed:
            self._parsed[name] = xml.parse(self.members[name])
        return self._parsed[name]

    def sheets(self) -> list[tuple]:
        """(sheet_ord, sheet, state, part), joined to their targets by relation id."""
        book, rels = "xl/workbook.xml", "xl/_rels/workbook.xml.rels"
        if book not in self.members or rels not in self.members:
            return []
        targets: dict = {}
        for rel, target in xml.same_relations(self.members[rels]):
            targets.setdefault(rel, []).append(target)
        return [(i, name, state, _resolved(t)) for i, name, state, rel in xml.same_sheets(self.members[book]) for t in targets.get(rel, ())]

    def cells(self, part: str) -> list[tuple]:
        if part not in self._cells:
            self._cells[part] = xml.cells_of(self._part(part))
        return self._cells[part]

    def lines(self) -> list[tuple]:
        """(text, part, place, depth) of paragraphs and text cells that aren't blank, in reading order; hidden sheets too."""
        out = []
        for part in self.members:
            if _STORY.search(part):
                out += [(0, part, k, text, str(k), depth) for k, text, depth in xml.paragraph_rows_of(self._part(part))]
        strings = None
        for o, _, _, part in self.sheets():
            if part not in self.members or not _SHEET.search(part):
                continue
            if strings is None:
                strings = dict(xml.shared_strings_of(self._part("xl/sharedStrings.xml"))) if "xl/sharedStrings.xml" in self.members else {}
            for k, place, t, _, v, formula in self.cells(part):
                text = None if formula else strings.get(_whole(v)) if t == "s" else v if t in ("inlineStr", "str") else None
                if text is not None:
                    out.append((o, part, k, text, place, 0))
        return [(text, part, place, depth) for _, part, _, text, place, depth in sorted(out, key=lambda x: x[:3]) if _TEXT.search(text)]

    def structure(self) -> dict | None:
        """Counts and digests for comparing a source with its output."""
        one = lambda n, data: xml.structure(n, data, self._parsed[n]) if n in self._parsed else xml.same_structure(n, data)
        rows = [(n, one(n, data)) for n, data in self.members.items() if _SIGNED.search(n)]
        if not rows:
            return None
        digest = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
        listed = [f"{sheet}={state}" for _, sheet, state, _ in sorted(self.sheets())]
        return {c: sum(r[k] for _, r in rows) for k, c in enumerate(COUNTS)} | {
            "format_signature": digest(sorted(f"{n}={r[-1]}" for n, r in rows)), "parts_digest": digest(sorted(self.members)), "sheets_digest": digest(listed) if listed else None,
        }

    def found(self, wanted: list[tuple[str, str]], lines: list[tuple]) -> list[dict]:
        """What stands at places (part, place); a place that is wanted again gets the next line that has it."""
        at: dict[tuple, list] = {}
        for text, part, place, depth in reversed(lines):
            at.setdefault((part, place), []).append((text, depth))
        wraps, flat = None, {}
        for part in {p for p, _ in wanted if _SHEET.search(p) and p in self.members}:
            if wraps is None:
                wraps = {i for i, w in xml.same_formats(self.members["xl/styles.xml"]) if w in ("1", "true")} if "xl/styles.xml" in self.members else set()
            flat |= {(part, cell): (_whole(s) or 0) not in wraps for _, cell, _, s, _, _ in self.cells(part)}
        out = []
        for place in wanted:
            text, depth = own.pop() if (own := at.get(place)) else (None, None)
            out.append({"text": text, "flat": flat.get(place), "depth": depth})
        return out


def read(content: Column, wanted: Column | None = None, lines: bool = False, structure: bool = False) -> Column:
    """What a package holds, read in one pass: ``lines`` and ``structure`` if asked for, and ``found`` at ``wanted`` places;
    of one that can't be read an ``error`` alone."""
    placed = wanted is not None
    kinds = {"lines": (lines, f"array<{LINE}>"), "structure": (structure, STRUCTURE), "found": (placed, f"array<{FOUND}>"), "error": (True, "string")}
    schema = f"struct<{','.join(f'{n}:{k}' for n, (on, k) in kinds.items() if on)}>"
    kind = to_arrow_type(_parse_datatype_string(schema))
    names = ["text", "part", "place", "depth"]

    def one(data: bytes, places) -> dict:
        try:
            return whole(data, places)
        except BROKEN as e:
            return {"error": f"{type(e).__name__}: {e}"[:500]}

    def whole(data: bytes, places) -> dict:
        own = Package(data)
        out, got = {}, own.lines() if lines or placed else []
        if lines:
            out["lines"] = [dict(zip(names, x, strict=True)) for x in got]
        if structure:
            out["structure"] = own.structure()
        if placed:
            out["found"] = own.found([(p["part"], p["place"]) for p in places or ()], got)
        return out

    @xml.uncollected
    def each(data: pa.Array) -> pa.Array:
        return pa.array([None if x is None else one(x, None) for x in data.to_pylist()], type=kind)

    @xml.uncollected
    def at_places(data: pa.Array, places: pa.Array) -> pa.Array:
        return pa.array([None if x is None else one(x, p) for x, p in zip(data.to_pylist(), places.to_pylist(), strict=True)], type=kind)

    return F.arrow_udf(each, schema)(content) if not placed else F.arrow_udf(at_places, schema)(content, wanted)


def package_units(files: DataFrame) -> DataFrame:
    """Lines (doc_id, idx, text, part, place, depth) of Word and Excel packages (doc_id, content) in reading order; none of
    packages that can't be read."""
    own = files.where(F.col("error").isNull()) if "error" in files.columns else files
    return own.select("doc_id", F.posexplode(read(F.col("content"), lines=True)["lines"]).alias("idx", "l")).select("doc_id", "idx", "l.*")
