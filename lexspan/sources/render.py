"""Office files as HTML previews: scalar functions over bytes, with query terms marked."""

from __future__ import annotations

import base64
import datetime
import html
import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F

from ..functions.snippets import highlight
from .office import A, R, S, W, Archive, _level, _shared, _slide_lines, _styles, cell_value, sheets

MAX_ROWS, MAX_COLUMNS, MAX_HTML = 5000, 256, 4 << 20
_MIME = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif", "bmp": "bmp", "tif": "tiff", "tiff": "tiff"}

# Number formats that a spreadsheet doesn't spell out.
# The number formats that a workbook needn't state.  Those of 27 to 36 and 50 to 58 are East Asian dates, all shown alike.
BUILTIN_FORMATS = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "yyyy/m/d", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM",
    20: "h:mm", 21: "h:mm:ss", 22: "yyyy/m/d h:mm", 37: "#,##0", 38: "#,##0", 39: "#,##0.00", 40: "#,##0.00", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss",
    **dict.fromkeys([*range(27, 37), *range(50, 59)], "yyyy/m/d"),
}


def _picture(archive: Archive, part: str) -> str:
    kind, data = _MIME.get(part.rpartition(".")[2].lower()), archive.bytes(part)
    return f'<img src="data:image/{kind};base64,{base64.b64encode(data).decode()}">' if kind and data else ""


# Word


def _run_html(r: ElementTree.Element, archive: Archive, related: dict[str, str], terms: list[str]) -> str:
    out = []
    for e in r:
        if e.tag == W + "t":
            out.append(highlight(e.text or "", terms))
        elif e.tag in (W + "br", W + "cr"):
            out.append("<br>")
        elif e.tag == W + "tab":
            out.append(" ")
        elif e.tag in (W + "drawing", W + "pict"):
            out += [_picture(archive, related.get(b.get(R + "embed", ""), "")) for b in e.iter(A + "blip")]
    text, style = "".join(out), r.find(W + "rPr")
    if style is not None and text:
        for tag, name in (("b", "strong"), ("i", "em"), ("u", "u")):
            mark = style.find(W + tag)
            if mark is not None and mark.get(W + "val", "1") not in ("0", "false", "none"):
                text = f"<{name}>{text}</{name}>"
    return text


def _list_kinds(archive: Archive) -> dict[str, str]:
    """ol or ul of numbering ids."""
    root = archive.xml("word/numbering.xml")
    if root is None:
        return {}
    kind = {}
    for a in root.findall(W + "abstractNum"):
        fmt = a.find(f"{W}lvl/{W}numFmt")
        kind[a.get(W + "abstractNumId")] = "ul" if fmt is not None and fmt.get(W + "val") == "bullet" else "ol"
    out = {}
    for n in root.findall(W + "num"):
        ref = n.find(W + "abstractNumId")
        out[n.get(W + "numId", "")] = kind.get(ref.get(W + "val") if ref is not None else "", "ul")
    return out


def docx_html(data: bytes, terms: list[str] = ()) -> str:
    archive = Archive(data)
    styles, lists, related, root = _styles(archive), _list_kinds(archive), archive.relations("word/document.xml"), archive.xml("word/document.xml")
    out: list[str] = []
    open_list = ""

    def close() -> None:
        nonlocal open_list
        if open_list:
            out.append(f"</{open_list}>")
        open_list = ""

    def body(parent: ElementTree.Element) -> None:
        nonlocal open_list
        for e in parent:
            if e.tag == W + "p":
                inner = "".join(_run_html(r, archive, related, list(terms)) for r in e.iter(W + "r"))
                plain = "".join(t.text or "" for t in e.iter(W + "t")).strip()
                number = e.find(f"{W}pPr/{W}numPr/{W}numId")
                level = _level(e, styles, plain) if plain and number is None else 0
                if number is not None:
                    kind = lists.get(number.get(W + "val", ""), "ul")
                    if kind != open_list:
                        close()
                        out.append(f"<{kind}>")
                        open_list = kind
                    out.append(f"<li>{inner}</li>")
                    continue
                close()
                if level:
                    out.append(f"<h{level}>{inner}</h{level}>")
                elif inner:
                    out.append(f"<p>{inner}</p>")
            elif e.tag == W + "tbl":
                close()
                out.append("<table>")
                for row in e.findall(W + "tr"):
                    out.append("<tr>")
                    for c in row.findall(W + "tc"):
                        span = c.find(f"{W}tcPr/{W}gridSpan")
                        out.append(f'<td colspan="{span.get(W + "val")}">' if span is not None else "<td>")
                        body(c)
                        close()
                        out.append("</td>")
                    out.append("</tr>")
                out.append("</table>")
            elif e.tag in (W + "sdt", W + "sdtContent", W + "ins"):
                body(e)

    if root is not None:
        body(root.find(W + "body"))
    close()
    return "".join(out)


# Excel


def column_index(ref: str) -> int:
    """0 for A."""
    n = 0
    for c in re.match(r"[A-Z]*", ref.upper())[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(index: int) -> str:
    out = ""
    while index >= 0:
        index, r = index // 26 - 1, index % 26
        out = chr(65 + r) + out
    return out


def format_number(value: str, code: str) -> str:
    """A cell's number as its format shows it: dates, percents, grouping and decimals."""
    try:
        n = float(value)
    except ValueError:
        return value
    bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.split(";")[0])
    if re.search(r"[yd]", bare, re.I) or re.search(r"[mhs]", bare, re.I) and not re.search(r"[0#]", bare) and bare.lower() != "standard":
        at = datetime.datetime(1970, 1, 1) + datetime.timedelta(days=n - 25569)
        day = f"{at.year}/{at.month}/{at.day}"
        return day + (f" {at.hour}:{at.minute:02d}" if re.search(r"[hs]", bare, re.I) else "")
    decimals = len(m[1]) if (m := re.search(r"\.([0#?]+)", bare)) else 0
    if "%" in bare:
        return f"{n * 100:.{decimals}f}%"
    if re.search(r"[0#]", bare):
        return f"{n:,.{decimals}f}" if "," in bare else f"{n:.{decimals}f}"
    return str(int(n)) if n == int(n) and abs(n) < 1e15 else repr(n)


def _formats(archive: Archive) -> list[str]:
    """The format code of each cell style."""
    root = archive.xml("xl/styles.xml")
    if root is None:
        return []
    own = {int(f.get("numFmtId", "0")): f.get("formatCode", "") for f in root.iter(S + "numFmt")}
    styles = root.find(S + "cellXfs")
    ids = [int(x.get("numFmtId", "0")) for x in (styles if styles is not None else ())]
    return [own.get(i, BUILTIN_FORMATS.get(i, "")) for i in ids]


def xlsx_html(data: bytes, terms: list[str] = ()) -> str:
    archive = Archive(data)
    shared, formats, out, size = _shared(archive), _formats(archive), [], 0
    for name, part in sheets(archive):
        root = archive.xml(part)
        if root is None:
            continue
        spans, covered = {}, set()
        for m in root.iter(S + "mergeCell"):
            a, _, b = m.get("ref", "").partition(":")
            if not b:
                continue
            r1, r2 = (int(re.search(r"\d+", x)[0]) for x in (a, b))
            c1, c2 = column_index(a), column_index(b)
            spans[r1, c1] = (r2 - r1 + 1, c2 - c1 + 1)
            if (r2 - r1 + 1) * (c2 - c1 + 1) <= MAX_ROWS * MAX_COLUMNS:
                covered |= {(r, c) for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)} - {(r1, c1)}
        out.append(f"<h3>{html.escape(name)}</h3><table>")
        for i, row in enumerate(root.iter(S + "row"), 1):
            if i > MAX_ROWS or size > MAX_HTML:
                out.append('<tr><td class="cut">…</td></tr>')
                break
            r = int(row.get("r", i))
            cells = {}
            for at, c in enumerate(row.findall(S + "c")):
                text = cell_value(c, shared)
                if c.get("t", "n") == "n" and text:
                    style = int(c.get("s", "0"))
                    text = format_number(text, formats[style] if style < len(formats) else "")
                cells[column_index(c.get("r", "")) if c.get("r") else at] = text
            line = ["<tr>"]
            for col in range(min(MAX_COLUMNS, max(cells, default=-1) + 1)):
                if (r, col) in covered:
                    continue
                down, across = spans.get((r, col), (1, 1))
                extra = (f' rowspan="{down}"' if down > 1 else "") + (f' colspan="{across}"' if across > 1 else "")
                line.append(f"<td{extra}>{highlight(cells.get(col, ''), list(terms))}</td>")
            line.append("</tr>")
            out.append("".join(line))
            size += len(out[-1])
        out.append("</table>")
    return "".join(out)


# PowerPoint


def pptx_html(data: bytes, terms: list[str] = ()) -> str:
    archive, out = Archive(data), []
    for i, name in enumerate(archive.matching(r"ppt/slides/slide(\d+)\.xml$"), 1):
        root, related = archive.xml(name), archive.relations(name)
        out.append(f'<section class="slide"><h3>{i}</h3>')
        out += [f"<p>{highlight(t, list(terms))}</p>" for t in _slide_lines(root)]
        out += [_picture(archive, related.get(b.get(R + "embed", ""), "")) for b in (root.iter(A + "blip") if root is not None else ())]
        notes = [t for p in related.values() if p.startswith("ppt/notesSlides/") for t in _slide_lines(archive.xml(p))]
        if notes:
            out.append(f'<aside class="notes">{highlight(" ".join(notes), list(terms))}</aside>')
        out.append("</section>")
    return "".join(out)


_BY_EXT = {".docx": docx_html, ".docm": docx_html, ".xlsx": xlsx_html, ".xlsm": xlsx_html, ".pptx": pptx_html}


def render(data: bytes, ext: str, terms: list[str] = ()) -> str:
    """A page's body; other files as marked plain text."""
    made = _BY_EXT.get(ext.lower())
    if made:
        return made(data, terms)
    from .decode import clean, decode

    return f"<pre>{highlight(clean(decode(data)[0]), list(terms))}</pre>"


def renderer(terms: list[str] = ()):
    """A column function: (content, ext) -> HTML; a broken file gives its error."""

    @F.pandas_udf("string")
    def made(content: pd.Series, ext: pd.Series) -> pd.Series:
        out = []
        for data, e in zip(content, ext):
            try:
                out.append(render(bytes(data), e, terms))
            except Exception as error:  # one bad file must not fail the page
                out.append(f'<p class="error">{html.escape(f"{type(error).__name__}: {error}")}</p>')
        return pd.Series(out)

    return made
