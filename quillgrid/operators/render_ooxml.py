"""Office packages with translations put in: one task renders one package."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from quillgrid.sources import ooxml_xml as xml


def zipped(members: dict[str, bytes]) -> bytes:
    """A package with its members in sorted order and fixed times, so equal input gives equal bytes.

    Members are packed by the fastest level, tiny ones not at all: most of the time of a level is spent on the last few percent.
    """
    if sum(map(len, members.values())) >= 1 << 31 or len(members) >= 1 << 16:
        return _zipped64(members)
    out, listed, at = [], [], 0
    for name in sorted(members):
        data, raw = members[name], name.encode()
        packed = data
        if len(data) > 512:
            deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
            packed = deflate.compress(data) + deflate.flush()
        # version, flags (names in UTF-8), method, time, date, checksum, sizes, length of the name, of extra fields
        head = struct.pack("<HHHHHLLLHH", 20, 0 if name.isascii() else 0x800, 8 if len(data) > 512 else 0, 0, 33, zlib.crc32(data), len(packed), len(data), len(raw), 0)
        out += (b"PK\3\4", head, raw, packed)
        listed.append(b"PK\1\2\x14\3" + head + struct.pack("<HHHLL", 0, 0, 0, 0o600 << 16, at) + raw)
        at += 30 + len(raw) + len(packed)
    listing = b"".join(listed)
    return b"".join((*out, listing, b"PK\5\6", struct.pack("<HHHHLLH", 0, 0, len(members), len(members), len(listing), at, 0)))


def _zipped64(members: dict[str, bytes]) -> bytes:
    """The same for packages beyond the limits of plain archives."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(members):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), members[name], zipfile.ZIP_DEFLATED if len(members[name]) > 512 else zipfile.ZIP_STORED, 1)
    return out.getvalue()


def render(content: bytes, edits: list[tuple[str, str, str, str]], bilingual: bool) -> tuple[bytes, int]:
    """A package with edits (part, place, current text, target), and how many were done."""
    members = xml.unzipped(content)
    by_part: dict[str, dict] = {}
    for part, place, source, target in edits:
        by_part.setdefault(part, {})[place] = (source, target)
    done, book = 0, None
    for part, wanted in sorted(by_part.items()):
        if part not in members:
            continue
        if part.startswith("xl/"):
            book = book or xml.Workbook(members)
            done += book.edit(part, wanted, bilingual)
        else:
            members[part], n = xml.edit_story(members[part], {int(k): v for k, v in wanted.items()}, bilingual)
            done += n
    return zipped(book.finished() if book else members), done


RENDERED = "struct<content:binary,requested:int,inserted:int>"


def render_column(content: Column, edits: Column, bilingual: bool) -> Column:
    """A package with an array of edits (part, place, text, target), and how many were asked for and done."""
    kind = to_arrow_type(_parse_datatype_string(RENDERED))

    @xml.uncollected
    def each(contents: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        for data, own in zip(contents.to_pylist(), wanted.to_pylist(), strict=True):
            own = [(e["part"], e["place"], e["text"], e["target"]) for e in own or ()]
            out.append(None if data is None else dict(zip(("content", "inserted"), render(data, own, bilingual), strict=True)) | {"requested": len(own)})
        return pa.array(out, type=kind)

    return F.arrow_udf(each, RENDERED)(content, edits)


def rendered(files: DataFrame, edits: DataFrame, bilingual: bool) -> DataFrame:
    """(doc_id, content, requested, inserted): packages (doc_id, content) with edits (doc_id, part, place, text, target)."""
    listed = edits.groupBy("doc_id").agg(F.collect_list(F.struct("part", "place", "text", "target")).alias("edits"))
    both = files.select("doc_id", "content").join(listed, "doc_id", "left")
    return both.select("doc_id", render_column(F.col("content"), F.col("edits"), bilingual).alias("r")).select("doc_id", "r.*").select("doc_id", "content", "requested", "inserted")
