"""Text functions as Spark columns, evaluated in the JVM.

Lengths and offsets count code points throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CJK ideographs: extension A, the unified block, compatibility ideographs.
CJK = r"㐀-䶿一-鿿豈-﫿"
MAX_TOKEN = 64
MAX_BIGRAMS = 4000

# Line patterns of headings, kinds of files by extension.
HEADINGS = (
    r"^(第[一二三四五六七八九十百]+[章节部分篇])\s*(.{0,60})$",
    r"^([一二三四五六七八九十]+[、.．])\s*(.{0,60})$",
    r"^(（[一二三四五六七八九十]+）|\([一二三四五六七八九十]+\))\s*(.{0,60})$",
    r"^(\d+(?:\.\d+){0,3})[、.．\s]\s*(.{0,60})$",
)
KINDS = {
    "docx": (".docx", ".docm"),
    "xlsx": (".xlsx", ".xlsm"),
    "pptx": (".pptx",),
    "legacy-doc": (".doc",),
    "legacy-xls": (".xls",),
    "pdf": (".pdf",),
    "image": (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp"),
    "text": (".md", ".markdown", ".txt", ".csv", ".json", ".log", ".yml", ".yaml", ".xml", ".ini", ".conf"),
}


def nfkc(c: Column) -> Column:
    """Compatibility composition without NULs; ASCII, where it changes nothing, skips the call."""
    plain = F.replace(c, F.lit("\x00"), F.lit(""))
    folded = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(plain, F.lit("")), F.lit(True))
    return F.when(c.isNull() | c.rlike(r"^\p{ASCII}*$"), plain).otherwise(folded)


def tokens(c: Column) -> Column:
    """Distinct lower-case runs of letters and digits, at most 64 long, in order of first use."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) <= MAX_TOKEN))


def cjk_bigrams(c: Column) -> Column:
    """All pairs of neighbouring ideographs, in order of first use."""
    runs = F.regexp_extract_all(c, F.lit(f"[{CJK}]{{2,}}"), F.lit(0))
    pairs = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    return F.array_distinct(F.flatten(pairs))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once for a row.  Spark repeats what holds nfkc wherever it is used, as it takes it for random."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def index_terms(c: Column) -> Column:
    """What a text is found by: its tokens, then bigrams that aren't tokens, 4000 of those at most."""

    def with_pairs(text: Column) -> Column:
        return _let(tokens(text), lambda words: F.array_union(words, F.slice(F.array_except(cjk_bigrams(text), words), 1, MAX_BIGRAMS)))

    return _let(nfkc(c), lambda text: F.when(text.rlike(f"[{CJK}]{{2}}"), with_pairs(text)).otherwise(tokens(text)))


def ocr_cleanup(c: Column) -> Column:
    """Blanks between ideographs go, other blanks become one, three or more line breaks two."""
    c = F.regexp_replace(nfkc(c), f"(?<=[{CJK}])[ \\t]+(?=[{CJK}])", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Byte order mark and NULs off, line ends as \\n, no blanks at line ends, at most three line breaks in a row."""
    c = F.regexp_replace(c, r"^\x{FEFF}", "")
    c = F.replace(F.regexp_replace(c, r"\r\n?", "\n"), F.lit("\x00"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{4,}", "\n\n\n")


def heading_level(c: Column) -> Column:
    """0 for prose; the number of # for Markdown headings; 2 for lines that start with an ordinal."""
    line = F.regexp_replace(c, r"^\s+|\s+$", "")
    marks = F.length(F.regexp_extract(line, r"^(#{1,6})\s+\S", 1))
    ordinal = F.lit(False)
    for pattern in HEADINGS:
        ordinal = ordinal | line.rlike(pattern)
    level = F.when(marks > 0, marks).when(ordinal, 2).otherwise(0)
    return F.when((F.length(line) == 0) | (F.length(line) > 80), 0).otherwise(level).cast("int")


def clauses(c: Column) -> Column:
    """Folded parts of a message between sentence and clause marks."""
    parts = F.split(F.lower(nfkc(c)), r"[。！？!?；;\n，,、]+")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def highlight_terms(c: Column) -> Column:
    """Parts of a query of two characters or more, longest first, 12 at most."""
    parts = F.filter(F.array_distinct(F.split(F.trim(c), r"[\s,，。;；、|/\"“”'‘’()（）]+")), lambda t: F.length(t) >= 2)
    longest = F.transform(F.array_sort(F.transform(parts, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: s["t"])
    return F.slice(longest, 1, 12)


def kind_of(ext: Column) -> Column:
    """Kind of a file by its extension; unknown ones are binary."""
    out = F.lit("binary")
    for kind, members in KINDS.items():
        out = F.when(F.lower(ext).isin(*members), kind).otherwise(out)
    return out


def contains_folded(text: Column, term: str) -> Column:
    return F.contains(F.lower(text), F.lit(term.lower()))


def source_label(c: Column) -> Column:
    return F.when(c == "ocr", "OCR").when(c == "word", "Word").when(c == "metadata", "metadata only").when(c == "none", "no text").otherwise("native text")


def human_size(c: Column) -> Column:
    shown = lambda unit, name: F.format_string(f"%.1f {name}", c.cast("double") / unit)
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1024 * 1024, shown(1024, "KB")).otherwise(shown(1024 * 1024, "MB"))


def html_escape(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def excel_date(serial: Column) -> Column:
    """The date of a spreadsheet's serial day number."""
    return F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(serial) - 25569).cast("int"))
