"""Office files to blocks.  Files are zip archives of XML; parts are read by name and with their namespaces, so the
order of attributes and prefixes doesn't matter."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

from ..functions.chunking import Block, heading_level

ENTRY_LIMIT = 256 << 20
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_IMAGE = re.compile(r"^(?:word|ppt|xl)/media/[^/]+\.(?:png|jpe?g|bmp|tiff?)$", re.I)


class Archive:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = self.zip.namelist()

    def bytes(self, name: str) -> bytes:
        if name not in self.names:
            return b""
        if self.zip.getinfo(name).file_size > ENTRY_LIMIT:
            raise ValueError(f"{name} is too large")
        return self.zip.read(name)

    def xml(self, name: str) -> ElementTree.Element | None:
        data = self.bytes(name)
        return ElementTree.fromstring(data) if data else None

    def matching(self, pattern: str) -> list[str]:
        """Names in the order of the number in them."""
        found = [(int(m[1] or 0), n) for n in self.names if (m := re.match(pattern, n))]
        return [n for _, n in sorted(found)]

    def relations(self, part: str) -> dict[str, str]:
        root = self.xml(posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels"))
        base = posixpath.dirname(part)
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            out[r.get("Id", "")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(base, target))
        return out


# Word


def _paragraph_text(p: ElementTree.Element) -> str:
    out = []
    for e in p.iter():
        if e.tag == W + "t":
            out.append(e.text or "")
        elif e.tag == W + "tab":
            out.append("\t")
        elif e.tag in (W + "br", W + "cr"):
            out.append("\n")
    return "".join(out).strip()


def _styles(archive: Archive) -> dict[str, int]:
    """Heading level of style ids."""
    root, out = archive.xml("word/styles.xml"), {}
    for style in root.iter(W + "style") if root is not None else ():
        level = style.find(f"{W}pPr/{W}outlineLvl")
        name = style.find(W + "name")
        title = name.get(W + "val", "") if name is not None else ""
        m = re.match(r"(?:heading|标题)\s*(\d)", title, re.I)
        n = int(level.get(W + "val", "9")) + 1 if level is not None else int(m[1]) if m else 0
        if 1 <= n <= 9:
            out[style.get(W + "styleId", "")] = min(6, n)
    return out


def _level(p: ElementTree.Element, styles: dict[str, int], text: str) -> int:
    own = p.find(f"{W}pPr/{W}outlineLvl")
    if own is not None and int(own.get(W + "val", "9")) < 9:
        return min(6, int(own.get(W + "val")) + 1)
    style = p.find(f"{W}pPr/{W}pStyle")
    if style is not None:
        name = style.get(W + "val", "")
        if name in styles:
            return styles[name]
        if m := re.match(r"(?:heading|标题)\s*(\d)", name, re.I):
            return min(6, int(m[1]))
    return heading_level(text)


def _body(parent: ElementTree.Element, styles: dict[str, int]) -> list[Block]:
    out = []
    for e in parent:
        if e.tag == W + "p":
            text = _paragraph_text(e)
            if text:
                level = _level(e, styles, text)
                out.append(Block("heading", text, level) if level else Block("para", text))
        elif e.tag == W + "tbl":
            for row in e.iter(W + "tr"):
                cells = [" ".join(t for p in c.iter(W + "p") if (t := _paragraph_text(p))) for c in row.findall(W + "tc")]
                if any(cells):
                    out.append(Block("para", " | ".join(c for c in cells if c)))
        elif e.tag in (W + "sdt", W + "sdtContent", W + "ins", W + "smartTag"):
            out += _body(e, styles)
    return out


def docx_blocks(data: bytes) -> list[Block]:
    """Paragraphs and table rows in order, then headers, footers and notes."""
    archive = Archive(data)
    styles, root = _styles(archive), archive.xml("word/document.xml")
    out = _body(root.find(W + "body"), styles) if root is not None else []
    for name in archive.matching(r"word/(?:header|footer)(\d*)\.xml$") + archive.matching(r"word/(?:foot|end)notes()\.xml$"):
        part = archive.xml(name)
        out += [Block("para", t) for p in (part.iter(W + "p") if part is not None else ()) if (t := _paragraph_text(p))]
    return out


# Excel


def _shared(archive: Archive) -> list[str]:
    root = archive.xml("xl/sharedStrings.xml")
    return ["".join(t.text or "" for t in si.iter(S + "t")) for si in (root.findall(S + "si") if root is not None else ())]


def sheets(archive: Archive) -> list[tuple[str, str]]:
    """(name, part) of the sheets in the workbook's order."""
    root, related = archive.xml("xl/workbook.xml"), archive.relations("xl/workbook.xml")
    return [(s.get("name", ""), related.get(s.get(R + "id", ""), "")) for s in (root.iter(S + "sheet") if root is not None else ())]


def cell_value(cell: ElementTree.Element, shared: list[str]) -> str:
    kind, v = cell.get("t", "n"), cell.find(S + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(S + "t"))
    text = (v.text or "") if v is not None else ""
    if kind == "s":
        return shared[int(text)] if text.isdigit() and int(text) < len(shared) else ""
    return {"1": "TRUE", "0": "FALSE"}.get(text, text) if kind == "b" else text


def xlsx_blocks(data: bytes) -> list[Block]:
    """A heading for each sheet, a paragraph for each row of the cells that aren't empty."""
    archive = Archive(data)
    shared, out = _shared(archive), []
    for name, part in sheets(archive):
        out.append(Block("heading", f"工作表：{name}", 2))
        root = archive.xml(part)
        for row in root.iter(S + "row") if root is not None else ():
            cells = [v.strip() for c in row.findall(S + "c") if (v := cell_value(c, shared)).strip()]
            if cells:
                out.append(Block("para", " | ".join(cells)))
    return out


# PowerPoint


def _slide_lines(root: ElementTree.Element | None) -> list[str]:
    lines = ("".join(t.text or "" for t in p.iter(A + "t")).strip() for p in (root.iter(A + "p") if root is not None else ()))
    return [x for x in lines if x]


def pptx_blocks(data: bytes) -> list[Block]:
    """Slides in order, a paragraph for each of theirs, and their notes."""
    archive, out = Archive(data), []
    for i, name in enumerate(archive.matching(r"ppt/slides/slide(\d+)\.xml$"), 1):
        out.append(Block("heading", f"幻灯片 {i}", 2))
        out += [Block("para", t) for t in _slide_lines(archive.xml(name))]
        notes = [p for p in archive.relations(name).values() if p.startswith("ppt/notesSlides/")] or [f"ppt/notesSlides/notesSlide{i}.xml"]
        lines = [t for p in notes for t in _slide_lines(archive.xml(p))]
        if lines:
            out.append(Block("para", "备注：" + " ".join(lines)))
    return out


def embedded_images(data: bytes, least: int = 20 << 10, most: int = 12 << 20, count: int = 40) -> list[tuple[str, str, int, bytes]]:
    """(entry, sha1, bytes, data) of the pictures of a size between least and most, count of them at most."""
    archive, out = Archive(data), []
    for name in archive.names:
        if _IMAGE.match(name) and least <= archive.zip.getinfo(name).file_size <= most and len(out) < count:
            raw = archive.bytes(name)
            out.append((name, hashlib.sha1(raw).hexdigest(), len(raw), raw))
    return out


EXTRACTORS = {"docx": docx_blocks, "xlsx": xlsx_blocks, "pptx": pptx_blocks}
