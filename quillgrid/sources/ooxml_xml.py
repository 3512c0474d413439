"""XML of Office parts: what is read from them, and edits that keep everything else.

Parts are parsed into ElementTree elements whose tags and attributes keep prefixes as they are written.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import io
import re
import struct
import zipfile
import zlib
from collections import Counter
from copy import deepcopy
from operator import attrgetter
from xml.etree import ElementTree
from xml.parsers import expat

from quillgrid.functions.text import CJK

_CJK = re.compile("[" + "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in CJK.split()) + "]")
_SPACE, _GIVEN = "xml:space", {"xml", "xmlns"}


def uncollected(f):
    """``f`` without runs of the garbage collector, which would look through each tree many times; trees hold no cycles."""

    @functools.wraps(f)
    def wrapped(*args):
        on = gc.isenabled()
        gc.disable()
        try:
            return f(*args)
        finally:
            if on:
                gc.enable()

    return wrapped


def _has_cjk(text: str) -> bool:
    return not text.isascii() and _CJK.search(text) is not None


class Names(dict):
    """Local names by tag; comments and processing instructions have none."""

    def __missing__(self, tag):
        self[tag] = name = tag.rpartition(":")[2] if isinstance(tag, str) else ""
        return name


_LOCAL = Names()


def _name(node) -> str:
    return _LOCAL[node.tag]


_LISTED, _LOCAL_HEAD = struct.Struct("<4s4xHH4xLLLHHH8xL"), struct.Struct("<4s22xHH")


def _plain_members(content: bytes, most: int | None) -> dict[str, bytes] | None:
    """Members of an archive of the plainest kind, checked by sizes and checksums; none of any other, ``zipfile`` tells what of it."""
    end = len(content) - 22
    if end < 0 or content[end : end + 4] != b"PK\5\6":
        return None
    disks, many, same, size, at = struct.unpack_from("<LHHLL", content, end + 4)
    if disks or many != same or many == 0xFFFF or at + size != end or content[end + 20 :] != b"\0\0":
        return None
    listed, begin, whole, free = [], at, 0, 0
    for _ in range(many):
        if at + 46 > end:
            return None
        mark, flags, method, crc, packed, unpacked, n, extra, note, offset = _LISTED.unpack_from(content, at)
        raw = content[at + 46 : at + 46 + n]
        at += 46 + n + extra + note
        if mark != b"PK\1\2" or flags & ~0x800 or method not in (0, 8) or extra or note or b"\0" in raw or not (flags or raw.isascii()):
            return None
        if offset < free or offset + 30 > begin:
            return None
        mark, own, extra = _LOCAL_HEAD.unpack_from(content, offset)
        start = offset + 30 + own + extra
        free = start + packed
        if mark != b"PK\3\4" or content[offset + 6 : offset + 8] != flags.to_bytes(2, "little") or content[offset + 30 : offset + 30 + own] != raw or free > begin or not method and packed != unpacked:
            return None
        listed.append((raw, method, crc, start, free, unpacked))
        whole += unpacked
    if at != end or most is not None and whole > most:
        return None
    out = {}
    for raw, method, crc, start, stop, unpacked in listed:
        if raw.endswith(b"/"):
            continue
        data = content[start:stop]
        if method:
            inflate = zlib.decompressobj(-15)
            data = inflate.decompress(data, unpacked + 1)
            if not inflate.eof and unpacked == len(data):
                data += inflate.decompress(inflate.unconsumed_tail, 1)
        if len(data) != unpacked or zlib.crc32(data) != crc:
            return None
        out[raw.decode()] = data
    return out


def unzipped(content: bytes, most: int | None = None) -> dict[str, bytes]:
    """Members of a package that unpack to ``most`` bytes at most; folders are left out."""
    try:
        members = _plain_members(content, most)
    except (struct.error, zlib.error, UnicodeDecodeError):
        members = None
    if members is not None:
        return members
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if most is not None and sum(m.file_size for m in z.infolist()) > most:
            raise ValueError(f"the package would unpack to more than {most} bytes")
        return {n: z.read(n) for n in z.namelist() if not n.endswith("/")}


class Part:
    """A part as a tree, with the comments and processing instructions around its root."""

    def __init__(self, data: bytes):
        self.before, self.after = [], []
        builder = ElementTree.TreeBuilder(insert_comments=True, insert_pis=True)
        names: dict[str, str] = {}  # of all elements and attributes
        parser = expat.ParserCreate(intern=names)
        parser.buffer_text, parser.ordered_attributes = True, False
        aside = []

        def first(tag, attributes):
            self.before, aside[:] = list(aside), []
            parser.StartElementHandler = builder.start
            return builder.start(tag, attributes)

        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = first, builder.end, builder.data
        parser.CommentHandler = lambda text: aside.append(builder.comment(text))
        parser.ProcessingInstructionHandler = lambda target, text: aside.append(builder.pi(target, text))
        parser.Parse(data, True)
        parser.CommentHandler = parser.ProcessingInstructionHandler = None
        self.root = builder.close()
        if aside:
            inside = set(map(id, self.root.iter()))
            self.after = [x for x in aside if id(x) not in inside]
        used = {k.partition(":")[0] for k in names if ":" in k}
        lost = used - {k[6:] for k in names if k.startswith("xmlns:")} - _GIVEN
        if lost:
            raise ValueError(f"a part uses prefixes that it doesn't declare: {', '.join(sorted(lost))}")
        self._tags: Counter | None = None

    def count(self, name: str) -> int:
        if self._tags is None:
            self._tags = Counter(map(attrgetter("tag"), self.root.iter()))
        return sum(n for tag, n in self._tags.items() if _LOCAL[tag] == name)

    def bytes(self) -> bytes:
        out = ['<?xml version="1.0" encoding="UTF-8" standalone="yes"?>']
        for x in self.before:
            _write(x, out)
        _write(self.root, out)
        for x in self.after:
            _write(x, out)
        return "".join(out).encode()


def _escaped(s: str) -> str:
    if "&" in s:
        s = s.replace("&", "&amp;")
    if "<" in s:
        s = s.replace("<", "&lt;")
    if ">" in s:
        s = s.replace(">", "&gt;")
    return s.replace("\r", "&#13;") if "\r" in s else s


def _quoted(s: str) -> str:
    s = _escaped(s)
    for c, e in (('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;")):
        if c in s:
            s = s.replace(c, e)
    return s


@functools.lru_cache(4096)
def _attribute(kv: tuple[str, str]) -> str:
    return f' {kv[0]}="{_quoted(kv[1])}"'


def _write(e, out: list[str]) -> None:
    """The markup of an element without the text after it."""
    tag = e.tag
    if tag is ElementTree.Comment:
        out.append(f"<!--{e.text}-->")
        return
    if tag is ElementTree.PI:
        out.append(f"<?{e.text}?>")
        return
    text, start = e.text, f"<{tag}"
    for kv in e.items():
        start += _attribute(kv)
    if not len(e):
        out.append(f"{start}>{_escaped(text)}</{tag}>" if text else start + "/>")
        return
    out.append(f"{start}>{_escaped(text)}" if text else start + ">")
    for c in e:
        own = c.tag
        if len(c) or own.__class__ is not str:
            _write(c, out)
        else:  # most elements have none in them
            text, start = c.text, f"<{own}"
            for kv in c.items():
                start += _attribute(kv)
            out.append(f"{start}>{_escaped(text)}</{own}>" if text else start + "/>")
        if tail := c.tail:
            out.append(_escaped(tail))
    out.append(f"</{tag}>")


def _all(node, *names: str):
    """Descendant elements by local name, in document order."""
    tree = node.iter()
    next(tree)
    return (c for c in tree if _LOCAL[c.tag] in names)


def _first(node, *names: str):
    return next(_all(node, *names), None)


def _child(node, name: str):
    return next((c for c in node if _LOCAL[c.tag] == name), None)


def _text(node) -> str:
    """An element's own text, without that of elements in it."""
    if not len(node):
        return node.text or ""
    return (node.text or "") + "".join(c.tail or "" for c in node)


def _put(node, text: str) -> None:
    del node[:]
    node.text = text
    if text != text.strip():
        node.set(_SPACE, "preserve")


def _remove(parent, node) -> None:
    """Take an element out; the text after it stays."""
    if node.tail:
        k = list(parent).index(node)
        if k:
            parent[k - 1].tail = (parent[k - 1].tail or "") + node.tail
        else:
            parent.text = (parent.text or "") + node.tail
        node.tail = None
    parent.remove(node)


def parse(data: bytes) -> Part:
    """A part as a tree. Office parts have no document type, and entities of untrusted files could grow without bound."""
    if re.search(rb"<!(DOCTYPE|ENTITY)", data.replace(b"\0", b"") if b"\0" in data else data):
        raise ValueError("a part with a document type declaration is not read")
    return Part(data)


_APART, _BREAKS = {"txbxContent", "Fallback", "pPr"}, {"tab": "\t", "br": "\n", "cr": "\n"}
_OWN = {"t", "delText", "r", *_BREAKS}


class Paragraph:
    """A paragraph with its place in the tree, how many paragraphs it stands in, and which of them have its text as theirs.

    ``own`` lists (name, element, parent, whether in a hyperlink) of text, breaks and runs that aren't in a paragraph of a
    text box or in a fallback copy.
    """

    __slots__ = ("node", "parent", "depth", "outer", "own", "changed")

    def __init__(self, node, parent, depth: int, outer: list):
        self.node, self.parent, self.depth, self.outer, self.own, self.changed = node, parent, depth, outer, [], False

    def text(self) -> str:
        """Text of the paragraph's own runs; tabs and breaks count, deleted text too."""
        return "".join(_BREAKS[n] if n in _BREAKS else _text(x) for n, x, _, _ in self.own if n != "r")


def paragraphs(part: Part) -> list[Paragraph]:
    """All paragraphs in document order."""
    found: list[Paragraph] = []
    _walk(part.root, 0, [], False, found)
    return found


def _walk(e, depth: int, inside: list, linked: bool, found: list[Paragraph]) -> None:
    for c in e:
        name = _LOCAL[c.tag]
        if name == "p":
            p = Paragraph(c, e, depth, inside)
            found.append(p)
            _walk(c, depth + 1, [*inside, p], False, found)
            continue
        if name in _OWN:
            for p in inside:
                p.own.append((name, c, e, linked))
        if len(c):
            _walk(c, depth, [] if name in _APART else inside, linked or name == "hyperlink", found)


def paragraph_rows_of(part: Part):
    return [(i, p.text(), p.depth) for i, p in enumerate(paragraphs(part))]


def paragraph_rows(data: bytes):
    return paragraph_rows_of(parse(data))


def paragraph_texts(data: bytes):
    return [(i, text) for i, text, _ in paragraph_rows(data)]


def sheets_of(part: Part):
    out = []
    for i, s in enumerate(_all(part.root, "sheet")):
        rel = next((v for k, v in s.items() if k.endswith(":id")), None)
        out.append((i, s.get("name", ""), s.get("state") or "visible", rel))
    return out


def relations_of(part: Part):
    return [(r.get("Id", ""), r.get("Target", "")) for r in _all(part.root, "Relationship")]


def shared_strings_of(part: Part):
    return [(i, "".join(map(_text, _all(si, "t")))) for i, si in enumerate(_all(part.root, "si"))]


def shared_strings(data: bytes):
    return shared_strings_of(parse(data))


def _cell(c):
    """First value, inline string and formula of a cell."""
    v = inline = formula = None
    for x in c.iter():
        name = _LOCAL[x.tag]
        if name == "v" and v is None:
            v = x
        elif name == "is" and inline is None:
            inline = x
        elif name == "f" and formula is None:
            formula = x
    return v, inline, formula


def cells_of(part: Part):
    out = []
    for i, c in enumerate(_all(part.root, "c")):
        v, inline, formula = _cell(c)
        text = "".join(map(_text, _all(inline, "t"))) if inline is not None else _text(v) if v is not None else None
        out.append((i, c.get("r", ""), c.get("t") or "n", c.get("s") or "0", text, formula is not None))
    return out


def cells(data: bytes):
    return cells_of(parse(data))


def cell_formats_of(part: Part):
    formats = _first(part.root, "cellXfs")
    out = []
    for i, xf in enumerate(x for x in formats if _name(x) == "xf") if formats is not None else []:
        a = _first(xf, "alignment")
        out.append((i, a.get("wrapText", "") if a is not None else None))
    return out


def cell_formats(data: bytes):
    return cell_formats_of(parse(data))


def _sign(e, out: list[str], word: bool, sheet: bool) -> None:
    """Markup of an element's content without what the signature leaves out."""
    if e.text:
        out.append(_escaped(e.text))
    run = word and _LOCAL[e.tag] == "r"
    plain = sheet and _LOCAL[e.tag] == "c" and _cell(e)[2] is None
    for c in e:
        tag = c.tag
        name = _LOCAL[tag]
        if tag is ElementTree.PI:
            out.append(f"<?{c.text}?>")
        elif name and not (run and name in _BREAKS) and not (plain and name in ("v", "is")):
            texts = name == "t" or name == "delText"
            start, items = f"<{tag}", c.items()
            if len(items) > 1:
                items.sort()
            for kv in items:
                if not (texts and kv[0] == _SPACE):
                    start += _attribute(kv)
            if not texts and (len(c) or c.text):
                out.append(start + ">")
                _sign(c, out, word, sheet)
                out.append("</>")
            else:
                out.append(start + "></>")
        if tail := c.tail:
            out.append(_escaped(tail))


def sheets(data: bytes):
    return sheets_of(parse(data))


def relations(data: bytes):
    return relations_of(parse(data))


def structure(name: str, data: bytes, part: Part | None = None):
    """Counts of a part and a digest of its markup without text (a run's tabs and breaks too), values of cells that aren't formulas left out."""
    media = int(name.startswith("word/media/"))
    if not name.endswith(".xml"):
        return (media, 0, 0, 0, 0, 0, 0, 0, hashlib.sha256(data).hexdigest())
    part = part or parse(data)
    counts = (media, *(part.count(n) for n in ("tbl", "sectPr", "mergeCell", "dataValidation", "conditionalFormatting", "hyperlink", "f")))
    if name == "xl/sharedStrings.xml":
        return (*counts, "")
    whole = ElementTree.Element("")
    whole.append(part.root)
    out: list[str] = [f"<?{x.text}?>" for x in (*part.before, *part.after) if x.tag is ElementTree.PI]
    _sign(whole, out, name.startswith("word/"), name.startswith("xl/worksheets/"))
    return (*counts, hashlib.sha256("".join(out).encode("utf-8", "surrogatepass")).hexdigest())


def _prefix(node) -> str:
    head = node.tag.rpartition(":")[0]
    return head + ":" if head else ""


def _font(run, text: str) -> None:
    """Fonts that show the text."""
    pre = _prefix(run)
    props = _child(run, "rPr")
    if props is None:
        props = ElementTree.Element(pre + "rPr")
        run.insert(0, props)
    fonts = _child(props, "rFonts")
    if fonts is None:
        fonts = ElementTree.Element(pre + "rFonts")
        props.insert(0, fonts)
    name = "Arial Unicode MS" if _has_cjk(text) else "Cambria"
    for slot in ("ascii", "hAnsi", "eastAsia", "cs"):
        fonts.set(f"{pre}{slot}", name)


def _copy(node):
    """A deep copy without the text after it."""
    new = deepcopy(node)
    new.tail = None
    return new


def _translation_paragraph(p, text: str):
    """A paragraph with the layout of ``p``, without list number and section, and one run."""
    pre = _prefix(p)
    new = ElementTree.Element(p.tag)
    layout = _child(p, "pPr")
    layout = _copy(layout) if layout is not None else ElementTree.Element(pre + "pPr")
    for c in [c for c in layout if _name(c) in ("sectPr", "numPr")]:
        _remove(layout, c)
    number = ElementTree.Element(pre + "numPr")
    ElementTree.SubElement(number, pre + "numId").set(pre + "val", "0")
    after = [k for k, c in enumerate(layout) if _name(c) and _name(c) not in ("pStyle", "keepNext", "keepLines", "pageBreakBefore", "framePr", "widowControl")]
    layout.insert(after[0] if after else len(layout), number)
    new.append(layout)
    run = ElementTree.SubElement(new, pre + "r")
    first = _child(p, "r")
    props = _child(first, "rPr") if first is not None else None
    if props is not None:
        run.append(_copy(props))
    _put(ElementTree.SubElement(run, pre + "t"), text)
    _font(run, text)
    return new


def edit_story(data: bytes, wanted: dict[int, tuple[str, str]], bilingual: bool) -> tuple[bytes, int]:
    """A Word part with translations at paragraphs {index: (current text, target)}; stale ones stay. Also how many were done."""
    part = parse(data)
    found, done = paragraphs(part), 0
    added: dict[int, tuple] = {}  # parents and the paragraphs that come after theirs
    for i in sorted(wanted, reverse=True):
        source, target = wanted[i]
        if i >= len(found) or found[i].changed or found[i].text() != source:
            continue
        p = found[i]
        if bilingual:
            for name, run, _, _ in p.own:
                if name == "r" and _has_cjk("".join(map(_text, _all(run, "t")))):
                    _font(run, "一")
            new = _translation_paragraph(p.node, target)
            if p.depth:
                new.tail, p.node.tail = p.node.tail, None
                p.parent.insert(list(p.parent).index(p.node) + 1, new)  # runs around it are looked through for its text
            else:
                added.setdefault(id(p.parent), (p.parent, {}))[1][id(p.node)] = new
        else:
            texts = [(x, linked) for name, x, _, linked in p.own if name in ("t", "delText")]
            home = next((t for t, linked in texts if not linked), texts[0][0] if texts else None)
            if home is None:
                continue
            for t, _ in texts:
                _put(t, target if t is home else "")
            for name, x, parent, _ in p.own:
                if name in _BREAKS:
                    _remove(parent, x)
            p.own = [x for x in p.own if x[0] not in _BREAKS]
        for outer in p.outer:  # their text has this one's, or its translation, in it
            outer.changed = outer.changed or (target != "" if bilingual else p.text() != source)
        done += 1
    for parent, new in added.values():
        children = []
        for c in parent:
            children.append(c)
            if (more := new.get(id(c))) is not None:
                more.tail, c.tail = c.tail, None
                children.append(more)
        parent[:] = children
    return part.bytes(), done


def _append_text(node, addition: str) -> None:
    """Longer text in a string node: plain text grows, rich text gets a run like the first one before phonetic parts."""
    runs = [c for c in node if _name(c) == "r"]
    if not runs:
        texts = [c for c in node if _name(c) == "t"]
        last = texts[-1] if texts else ElementTree.SubElement(node, _prefix(node) + "t")
        _put(last, _text(last) + addition)
        last.set(_SPACE, "preserve")
        return
    run = ElementTree.Element(runs[0].tag)
    props = _child(runs[0], "rPr")
    if props is not None:
        run.append(_copy(props))
    t = ElementTree.SubElement(run, next(_all(runs[0], "t")).tag)
    _put(t, addition)
    t.set(_SPACE, "preserve")
    node.insert(list(node).index(runs[-1]) + 1, run)


def _replace_text(node, text: str) -> None:
    """Other text in a string node, in the first run's style; phonetic parts stay."""
    phonetic = {id(t) for x in _all(node, "rPh") for t in x}
    texts = [t for t in _all(node, "t") if id(t) not in phonetic]
    for i, t in enumerate(texts):
        _put(t, text if i == 0 else "")


class Workbook:
    """Edits of a workbook's parts, shared strings and formats copied on write."""

    def __init__(self, members: dict[str, bytes]):
        self.members, self.memo = dict(members), {}
        self.strings = parse(members["xl/sharedStrings.xml"]) if "xl/sharedStrings.xml" in members else None
        self.styles = None  # parsed when a format is asked for
        self.items = [(c, e) for e in self.strings.root.iter() for c in e if _name(c) == "si"] if self.strings else []

    def _wrapped(self, index: int) -> int:
        if "xl/styles.xml" not in self.members:
            return index
        if index not in self.memo:
            self.styles = self.styles or parse(self.members["xl/styles.xml"])
            formats = _first(self.styles.root, "cellXfs")
            own = [x for x in formats if _name(x) == "xf"]
            xf = own[index if 0 <= index < len(own) else 0]
            a = _first(xf, "alignment")
            if a is not None and a.get("wrapText") in ("1", "true"):
                self.memo[index] = index
            else:
                new = _copy(xf)
                formats.append(new)
                a = _first(new, "alignment")
                if a is None:
                    a = ElementTree.Element(_prefix(new) + "alignment")
                    new.insert(0, a)
                a.set("wrapText", "1")
                new.set("applyAlignment", "1")
                formats.set("count", str(len(own) + 1))
                self.memo[index] = len(own)
        return self.memo[index]

    def edit(self, part: str, wanted: dict[str, tuple[str, str]], bilingual: bool) -> int:
        """Cells {reference: (current text, target)} of a sheet; stale and formula cells stay. How many were done."""
        doc, done = parse(self.members[part]), 0
        for c in list(_all(doc.root, "c")):
            if c.get("r", "") not in wanted:
                continue
            v, inline, formula = _cell(c)
            if formula is not None:
                continue
            source, target = wanted[c.get("r", "")]
            change = (lambda n, t=target: _append_text(n, "\n" + t)) if bilingual else (lambda n, t=target: _replace_text(n, t))
            kind, at = c.get("t", ""), _text(v) if v is not None else ""
            if kind == "s" and at.isdigit() and int(at) < len(self.items):
                old, parent = self.items[int(at)]
                if "".join(map(_text, _all(old, "t"))) != source:
                    continue
                new = _copy(old)
                change(new)
                parent.append(new)
                self.items.append((new, parent))
                parent.set("uniqueCount", str(len(self.items)))
                _put(v, str(len(self.items) - 1))
            elif kind == "inlineStr" and inline is not None and "".join(map(_text, _all(inline, "t"))) == source:
                change(inline)
            elif kind == "str" and v is not None and at == source:
                _put(v, source + "\n" + target if bilingual else target)
            else:
                continue
            if bilingual:
                s = c.get("s", "")
                c.set("s", str(self._wrapped(int(s) if s.isdigit() else 0)))
            done += 1
        self.members[part] = doc.bytes()
        return done

    def finished(self) -> dict[str, bytes]:
        if self.strings is not None:
            self.members["xl/sharedStrings.xml"] = self.strings.bytes()
        if self.styles is not None and any(k != v for k, v in self.memo.items()):
            self.members["xl/styles.xml"] = self.styles.bytes()
        return self.members


def _often(f, most: int = 4096):
    """``f`` of parts, with its results for small ones kept: many packages have the same formats, relations and the like."""
    kept = functools.lru_cache(256)(f)
    return lambda *args: (kept if len(args[-1]) < most else f)(*args)


same_sheets, same_relations, same_formats, same_structure = (_often(f) for f in (sheets, relations, cell_formats, structure))
