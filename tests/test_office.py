import pytest
from office_files import archive, docx, pptx, xlsx

from lexspan.functions.chunking import blocks_text
from lexspan.sources import office, render


def test_docx_text():
    got = office.docx_blocks(docx())
    assert [b.text for b in got] == ["Leinen lösen", "Fender einholen", "Hafenbuch", "Kai 7 | 4,5 m | Ebbe & <Flut>", "nur bei Tag", "Seite des Hafenamts"]
    assert [(b.kind, b.level) for b in got][2] == ("heading", 2)


def test_xlsx_text_resolves_strings():
    assert blocks_text(office.xlsx_blocks(xlsx())) == "## 工作表：Gezeiten\nFALSE | Nebel\n## 工作表：Schiffe\nSchiff\nMöwe | 7041.5 | 0.4 | 36526.25"


def test_pptx_text_in_slide_order():
    assert blocks_text(office.pptx_blocks(pptx())) == "## 幻灯片 1\nEinfahrt\nbei Flut\n备注：Lotse rufen\n## 幻灯片 2\nAusfahrt"


def test_images_by_size():
    assert office.embedded_images(docx(b"x" * 2048)) == []
    found = office.embedded_images(docx(b"x" * 30000))
    assert [(n, b) for n, _, b, _ in found] == [("word/media/kran.png", 30000)]


def test_bad_archives():
    with pytest.raises(Exception):
        office.docx_blocks(b"not a zip")
    assert office.docx_blocks(archive(**{"other.xml": "<a/>"})) == []


def test_docx_html():
    got = render.docx_html(docx(b"img"), ["bei"])
    assert "<h2>Hafenbuch</h2>" in got and 'nur <mark id="first-hit">bei</mark> Tag</em>' in got
    assert "Ebbe &amp; &lt;Flut&gt;" in got and "<ol><li>Leinen lösen</li><li>Fender einholen</li></ol>" in got and "data:image/png;base64," in got


def test_xlsx_html():
    got = render.xlsx_html(xlsx())
    assert '<td colspan="3">Schiff</td>' in got and "<td>7,041.50</td><td>40%</td><td>2000/1/1 6:00</td>" in got and "<h3>Schiffe</h3>" in got


def test_pptx_html_and_text():
    assert '<aside class="notes">Lotse rufen</aside>' in render.pptx_html(pptx())
    assert render.render("x>y".encode(), ".txt", ["y"]) == '<pre>x&gt;<mark id="first-hit">y</mark></pre>'


def test_columns():
    assert [render.column_index(x) for x in ("A1", "Z9", "AA1", "XFD1")] == [0, 25, 26, 16383]
    assert all(render.column_index(render.column_letters(i)) == i for i in (0, 25, 26, 701, 702, 16383))


def test_render_column(spark):
    df = spark.createDataFrame([(bytearray(xlsx()), ".xlsx"), (bytearray(b"junk"), ".docx")], "content binary, ext string")
    rows = [r[0] for r in df.select(render.renderer(["Schiff"])("content", "ext")).collect()]
    assert "<mark" in rows[0] and 'class="error"' in rows[1]


def test_formats_by_number():
    from lexspan.sources.render import BUILTIN_FORMATS, format_number

    shown = {i: format_number("46037.75", BUILTIN_FORMATS[i]) for i in (14, 20, 21, 22, 31, 36, 45, 46, 47, 50, 58)}
    assert {i for i, t in shown.items() if t == "2026/1/15"} == {14, 31, 36, 50, 58}
    assert {t for i, t in shown.items() if i in (20, 21, 22, 45, 46, 47)} == {"2026/1/15 18:00"}
    assert format_number("7.5", "General") == "7.5" and format_number("0.25", BUILTIN_FORMATS[9]) == "25%"
