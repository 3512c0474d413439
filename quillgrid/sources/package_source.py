"""A Spark data source of Word and Excel packages: ``spark.read.format("packages").load(folder)`` after ``register(spark)``.

Each row is a piece of a package: a paragraph, cell, shared string, sheet or relation, or an error. Small files are read
several to a task, large ones part by part, and large sheets by ranges of their bytes: a task unpacks the sheet's
stream, parses the rows that start in its range and holds one of them at a time. Strings and sheets are joined to cells by
Spark (``lines``). The options ``ext``, ``part`` and ``kind``, values joined by commas, leave files, parts and their parsing
out. They are options, not pushed filters: Spark 4.1 hands the filters that one scan of a loaded table pushed to the table's other
scans too, which then lose rows. A package or part that can't be read is a row with its error; so is a
part that would unpack to more than ``mostBytes``, and one with a document type declaration.

Word parts, workbooks and styles are parsed as wholes. Options: ``splitBytes`` (default 32 MB, of unpacked sheets and of files of one
task), ``mostBytes`` (default 4 GB).
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillgrid.functions import text as T
from quillgrid.sources import ooxml
from quillgrid.sources import ooxml_xml as xml

SCHEMA = "doc_id string, path string, ext string, kind string, part string, seq bigint, place string, t string, v string, text string, formula boolean, depth int, error string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
ROWS, CHUNK, TAG = 4096, 1 << 20, 256
BOOK, RELATIONS, STRINGS, SHEET = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml", re.compile(r"^xl/worksheets/[^/]+\.xml$")
STORY = re.compile(ooxml.STORY)
_OPEN = re.compile(rb"<((?:[\w.-]+:)?)sheetData(?:\s[^>]*)?>")
_ODD = re.compile(rb"<!--|<!\[CDATA\[")


def _store(root: str):
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("/") else root.replace("file:", "file://", 1))
    head = "file:" if isinstance(store, fs.LocalFileSystem) else re.match(r"[^/]*//[^/]*", root)[0]
    return store, base, head


def _file_id(path: str) -> str:
    import hashlib

    return hashlib.sha256(path.encode()).hexdigest()[:16]


@dataclass
class Piece:
    """A file, or a part of it, or the rows of a sheet that start in a range of bytes."""

    place: str
    part: str | None = None
    begin: int = 0
    end: int | None = None
    number: int = 0


class Task(InputPartition):
    def __init__(self, pieces: list[Piece]):
        super().__init__(pieces[0].place if pieces else "")
        self.pieces = pieces


def _wanted(part: str) -> str | None:
    """Kind of rows of a part."""
    return "paragraph" if STORY.search(part) else "cell" if SHEET.search(part) else {BOOK: "sheet", RELATIONS: "relation", STRINGS: "string"}.get(part)


def _elements(stream, name: str) -> Iterator:
    """Elements of a name, one in memory at a time."""
    parser = ElementTree.XMLPullParser(events=("start", "end"))
    open_ = []
    while chunk := stream.read(CHUNK):
        if not open_ and re.search(rb"<!(DOCTYPE|ENTITY)", chunk):
            raise ValueError("a part with a document type declaration is not read")
        parser.feed(chunk)
        yield from _closed(parser, open_, name)
    parser.close()
    yield from _closed(parser, open_, name)


def _closed(parser, open_: list, name: str) -> Iterator:
    for event, e in parser.read_events():
        if event == "start":
            open_.append(e)
            continue
        open_.pop()
        if e.tag.rpartition("}")[2] == name:
            yield e
            if open_:
                open_[-1].clear()


def _rows_between(stream, begin: int, end: int | None) -> Iterator:
    """Row elements of a sheet whose tags start in [begin, end) of its bytes, one in memory at a time."""
    data, at = b"", 0  # data starts at place ``at`` of the stream
    while not (head := _OPEN.search(data)):
        if not (chunk := stream.read(CHUNK)):
            return
        data += chunk
    if re.search(rb"<!(DOCTYPE|ENTITY)", data[: head.start()]):
        raise ValueError("a part with a document type declaration is not read")
    if head[0].endswith(b"/>"):
        return
    start = re.compile(rb"<" + head[1] + rb"row[\s/>]")
    parser, open_, done = ElementTree.XMLPullParser(events=("start", "end")), [], False
    parser.feed(data[: head.end()])
    data, at = data[head.end() :], head.end()
    inside = begin <= at
    while not done:
        if not inside:
            found = start.search(data, max(0, begin - at))
            if found:
                data, at, inside = data[found.start() :], at + found.start(), True
            else:
                cut = max(0, len(data) - TAG)
                data, at = data[cut:], at + cut
        if inside:
            stop = start.search(data, max(0, end - at)) if end is not None else None
            if stop:
                parser.feed(data[: stop.start()])
                done = True
            else:  # a tag may go on in the next chunk
                cut = max(0, len(data) - TAG) if end is not None else len(data)
                parser.feed(data[:cut])
                data, at = data[cut:], at + cut
            yield from _closed(parser, open_, "row")
        if not done and not (chunk := stream.read(CHUNK)):
            if inside:
                parser.feed(data)
                yield from _closed(parser, open_, "row")
            return
        if not done:
            data += chunk


def _text(e) -> str:
    return e.text or ""


def _cells(row) -> Iterator[tuple]:
    local = lambda x: x.tag.rpartition("}")[2] if isinstance(x.tag, str) else ""
    for c in row:
        if local(c) != "c":
            continue
        first: dict = {}
        for x in c.iter():
            first.setdefault(local(x), x)
        inline, value = first.get("is"), first.get("v")
        text = "".join(_text(x) for x in inline.iter() if local(x) == "t") if inline is not None else _text(value) if value is not None else None
        yield c.get("r", ""), c.get("t") or "n", text, "f" in first


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.split, self.most = int(options.get("splitbytes", 32 << 20)), int(options.get("mostbytes", 4 << 30))
        self.only = {n: set(options[n].split(",")) for n in ("ext", "part", "kind") if n in options}

    def _may(self, name: str, value) -> bool:
        return name not in self.only or value in self.only[name]

    def _reads(self, part: str) -> bool:
        """Whether a part's rows, or its errors, are asked for."""
        kind = _wanted(part)
        return bool(kind) and self._may("part", part) and (self._may("kind", kind) or self._may("kind", "error"))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base, _ = _store(self.root)
        info = store.get_file_info(base)
        found = store.get_file_info(fs.FileSelector(base, recursive=True)) if info.type == fs.FileType.Directory else [info]
        tasks, own, size = [], [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and self._may("ext", f.extension.lower())), key=lambda f: f.path):
            if f.size > self.split // 4 and f.extension.lower() in ooxml.SUPPORTED:
                tasks += [Task([p]) for p in self._pieces(store, f.path)]
                continue
            own.append(Piece(f.path))
            size += f.size
            if size >= self.split or len(own) >= 1000:
                tasks.append(Task(own))
                own, size = [], 0
        return [*tasks, Task(own)] if own or not tasks else tasks  # a read without tasks fails

    def _pieces(self, store, path: str) -> list[Piece]:
        """A large file's parts, and ranges of its large sheets."""
        try:
            with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                out = []
                for m in z.infolist():
                    if self._reads(m.filename):
                        many = max(1, -(-m.file_size // self.split)) if SHEET.search(m.filename) and m.file_size <= self.most else 1
                        edges = [m.file_size * k // many for k in range(many)] + [None]
                        out += [Piece(path, m.filename, edges[k], edges[k + 1], k) for k in range(many)]
                return out
        except ooxml.BROKEN:
            return [Piece(path)]  # the task tells what is wrong

    def read(self, task: Task) -> Iterator[pa.RecordBatch]:
        store, _, head = _store(self.root)
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        schema = pa.schema([(x.split()[0], kinds.get(x.split()[1], pa.string())) for x in SCHEMA.split(", ")])
        held: list[tuple] = []
        for piece in task.pieces:
            path, ext = head + piece.place, piece.place.rpartition(".")[2].lower()
            for row in self._rows(store, piece, ext):
                if not (self._may("ext", ext) and self._may("kind", row[0]) and self._may("part", row[1])):
                    continue
                held.append((_file_id(path), path, ext, *row))
                if len(held) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    def _rows(self, store, piece: Piece, ext: str) -> Iterator[tuple]:
        part = piece.part
        error = lambda e: ("error", part, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500])
        if ext not in ooxml.SUPPORTED:
            yield ("error", None, None, None, None, None, None, None, None, f"unsupported file type: {ext}")
            return
        try:
            with store.open_input_file(piece.place) as f, zipfile.ZipFile(f) as z:
                for m in z.infolist() if piece.part is None else [z.getinfo(piece.part)]:
                    part, kind = m.filename, _wanted(m.filename)
                    if not self._reads(part):
                        continue
                    if m.file_size > self.most:
                        raise ValueError(f"the part would unpack to {m.file_size} bytes")
                    yield from self._part(z, part, kind, piece)
        except ooxml.BROKEN as e:
            yield error(e)

    def _part(self, z: zipfile.ZipFile, part: str, kind: str, piece: Piece) -> Iterator[tuple]:
        if kind == "cell":
            begin, end, k = piece.begin, piece.end, piece.number << 40
            if piece.end is not None or piece.begin:  # tags in comments would be taken for rows: such a sheet is one task's
                with z.open(part) as s:
                    tail, odd = b"", False
                    while not odd and (chunk := s.read(CHUNK)):
                        odd, tail = bool(_ODD.search(tail + chunk)), chunk[-16:]
                if odd:
                    if piece.begin:
                        return
                    end = None
            with z.open(part) as s:
                for row in _rows_between(s, begin, end):
                    for place, t, text, formula in _cells(row):
                        yield kind, part, k, place, t, text, None, formula, None, None
                        k += 1
        elif kind == "string":
            with z.open(part) as s:
                for i, e in enumerate(_elements(s, "si")):
                    yield kind, part, i, None, None, None, "".join(_text(x) for x in e.iter() if x.tag.rpartition("}")[2] == "t"), None, None, None
        elif kind == "paragraph":
            for i, text, depth in xml.paragraph_rows(z.read(part)):
                yield kind, part, i, str(i), None, None, text, None, depth, None
        elif kind == "sheet":
            for i, name, state, rel in xml.sheets_of(xml.parse(z.read(part))):
                yield kind, part, i, rel, state, None, name, None, None, None
        else:
            for i, (rel, target) in enumerate(xml.relations_of(xml.parse(z.read(part)))):
                yield kind, part, i, rel, None, None, target, None, None, None


class PackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackageSource)


def lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Lines (doc_id, idx, text, part, place, depth) of the packages under a path in reading order, as
    ``ooxml.package_units`` has them.

    Sheets are joined to their targets by relation, cells to shared strings by position; no package is held as a whole.
    """
    of = lambda kind: spark.read.format("packages").options(kind=kind, **options).load(path)
    rels = of("relation").select("doc_id", F.col("place").alias("rel"), F.col("text").alias("target"))
    books = of("sheet").select("doc_id", F.col("seq").alias("o"), F.col("place").alias("rel"))
    parts = books.join(rels, ["doc_id", "rel"]).select("doc_id", "o", T.resolve_part(F.lit(BOOK), "target").alias("part"))
    strings = of("string").select("doc_id", F.col("seq").alias("idx"), F.col("text").alias("shared"))
    cells = of("cell").join(parts, ["doc_id", "part"]).select("doc_id", "o", "part", "seq", "place", "t", "v", F.col("formula").alias("has_formula"))
    read = ooxml.decoded(cells, strings, ["doc_id"]).select("doc_id", "o", "part", "seq", F.col("cell_text").alias("text"), "place", F.lit(0).alias("depth"))
    told = of("paragraph").select("doc_id", F.lit(0).cast("long").alias("o"), "part", "seq", "text", "place", "depth")
    own = told.union(read).where(F.col("text").isNotNull() & T.has_text("text"))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("o", "part", "seq")) - 1
    return own.select("doc_id", idx.alias("idx"), "text", "part", "place", "depth")
