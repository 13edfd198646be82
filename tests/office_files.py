"""Small office files, made in memory from plain Python values."""

import io
import zipfile
from html import escape

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_A = "http://schemas.openxmlformats.org/drawingml/2006/main"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_P = "http://schemas.openxmlformats.org/package/2006/relationships"


def archive(**parts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def relations(**targets) -> str:
    return f'<Relationships xmlns="{_P}">' + "".join(f'<Relationship Target="{t}" Id="{i}"/>' for i, t in targets.items()) + "</Relationships>"


def paragraph(text: str, level: int | None = None, steps: int | None = None, style: str = "") -> str:
    """level: of a heading, from 0; steps: the list that it belongs to; style: i for slanted text."""
    about = f'<w:outlineLvl w:val="{level}"/>' if level is not None else f'<w:numPr><w:numId w:val="{steps}"/></w:numPr>' if steps is not None else ""
    return f"<w:p><w:pPr>{about}</w:pPr><w:r><w:rPr>{f'<w:{style}/>' if style else ''}</w:rPr><w:t>{escape(text)}</w:t></w:r></w:p>"


def docx(picture: bytes = b"") -> bytes:
    """A harbour's log: two steps, a heading, slanted text, a table of one row, a picture, and a page head."""
    cells = "".join(f"<w:tc>{paragraph(x)}</w:tc>" for x in ("Kai 7", "4,5 m", "Ebbe & <Flut>"))
    body = [paragraph("Leinen lösen", steps=4), paragraph("Fender einholen", steps=4), paragraph("Hafenbuch", level=1), f"<w:tbl><w:tr>{cells}</w:tr></w:tbl>", paragraph("nur bei Tag", style="i")]
    body.append('<w:p><w:r><w:drawing><a:blip r:embed="bild9"/></w:drawing></w:r></w:p>')
    names = f'xmlns:w="{_W}" xmlns:a="{_A}" xmlns:r="{_R}"'
    parts = {
        "word/header3.xml": f"<w:hdr {names}>{paragraph('Seite des Hafenamts')}</w:hdr>",
        "word/_rels/document.xml.rels": relations(bild9="media/kran.png"),
        "word/numbering.xml": f'<w:numbering {names}><w:abstractNum w:abstractNumId="6"><w:lvl><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="4"><w:abstractNumId w:val="6"/></w:num></w:numbering>',
        "word/document.xml": f"<w:document {names}><w:body>{''.join(body)}</w:body></w:document>",
    }
    if picture:
        parts["word/media/kran.png"] = picture
    return archive(**parts)


FORMATS = {"plain": 0, "share": 9, "money": 4, "day": 22}


def sheet(rows: list[list], strings: list[str], merged: str = "") -> str:
    """rows: text for the shared strings, (value, format) for numbers, True or False, or [text] for text in place."""
    out = []
    for y, row in enumerate(rows, 1):
        cells = []
        for x, v in enumerate(row):
            at = f'r="{chr(65 + x)}{y}"'
            if isinstance(v, bool):
                cells.append(f'<c {at} t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, list):
                cells.append(f'<c {at} t="inlineStr"><is><t>{v[0]}</t></is></c>')
            elif isinstance(v, tuple):
                cells.append(f'<c {at} s="{list(FORMATS).index(v[1])}"><v>{v[0]}</v></c>')
            elif v:
                strings.append(v)
                cells.append(f'<c {at} t="s"><v>{len(strings) - 1}</v></c>')
        out.append(f'<row r="{y}">{"".join(cells)}</row>')
    merge = f'<mergeCells><mergeCell ref="{merged}"/></mergeCells>' if merged else ""
    return f'<worksheet xmlns="{_S}"><sheetData>{"".join(out)}</sheetData>{merge}</worksheet>'


def xlsx() -> bytes:
    """Two sheets, tides before ships."""
    strings: list[str] = []
    tides = sheet([[False, ["Nebel"]]], strings)
    ships = sheet([["", "Schiff"], ["Möwe", (7041.5, "money"), (0.4, "share"), (36526.25, "day")]], strings, "B1:D1")
    shared = "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for s in strings)
    styles = "".join(f'<xf numFmtId="{n}"/>' for n in FORMATS.values())
    return archive(**{
        "xl/worksheets/sheet5.xml": tides,
        "xl/worksheets/sheet8.xml": ships,
        "xl/sharedStrings.xml": f'<sst xmlns="{_S}">{shared}</sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{_S}"><cellXfs>{styles}</cellXfs></styleSheet>',
        "xl/_rels/workbook.xml.rels": relations(s="worksheets/sheet8.xml", t="worksheets/sheet5.xml"),
        "xl/workbook.xml": f'<workbook xmlns="{_S}" xmlns:r="{_R}"><sheets><sheet name="Gezeiten" r:id="t"/><sheet name="Schiffe" r:id="s"/></sheets></workbook>',
    })


def pptx() -> bytes:
    """Slides 3 and 12, with notes to the first of them."""
    slide = lambda *lines: f'<p xmlns:a="{_A}">' + "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in lines) + "</p>"
    return archive(**{"ppt/slides/slide12.xml": slide("Ausfahrt"), "ppt/slides/slide3.xml": slide("Einfahrt", "bei Flut"), "ppt/slides/_rels/slide3.xml.rels": relations(n="../notesSlides/notesSlide1.xml"), "ppt/notesSlides/notesSlide1.xml": slide("Lotse rufen")})
