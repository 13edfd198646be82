"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass decides a block
by its place (menus, footers, forms, notices, comments and the like, told by
element or by whole class names, id and role), its link density, its length and
the density of stop words; short blocks stay open.  In the second pass an open
block takes the label of its nearest decided neighbours: of both if they agree,
of the nearer one if not, ties to the one before; a title takes that of what
follows.  An <article> or <main> that holds text bounds the main text, and a
neighbour across its border doesn't count.

A class name counts as a whole: `site-footer` is a footer, `has-sidebar`,
`related-work` and `entry-header` say nothing.  Names that are also used for
content (header, notice, legal, ...) need a second sign inside an article: many
links, few words or few stop words.  Where all articles lie below such names, or
nothing else is left of a page, names are passed over.  On a page without any
known stop word (other languages) length and link density decide alone.

Defined results: a null, empty or tag-only page gives "".  Unclosed tags and
comments end with the page.  White space within a block becomes one space.  On a
page with `BROKEN` tags whose quotes never close, further tags end at their first
>.  Repeated rows give repeated results; rows without an id are extracted too.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table

SHORT = 70
LONG = 200
LINKS = 0.33
STOP_LOW, STOP_HIGH = 0.04, 0.08

# Frequent function words of some languages.
STOP_WORDS = frozenset(
    """a an and are as at be been but by can for from had has have he her his i in is it its not of on or she that the their
    they this to was we were which will with would you aber als auch auf aus bei das dass dem den der des die durch ein eine einem
    einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so um und von war wie wird zu zum zur au aux avec
    ce ces dans de des du elle en est et il ils la le les leur mais ne nous ou par pas plus pour qu que qui sa se ses son sont sur un une
    vous al como con del el ella es esta este fue ha la las lo los más me muy no o para pero por que se ser si sin sobre su sus también un una y""".split()
)
_RAW = frozenset("script style noscript template iframe svg textarea title select object canvas audio video datalist".split())
_OUT = frozenset("nav footer aside form button dialog menu label fieldset head".split())
_MAIN = frozenset("article main".split())
_BLOCK = frozenset(
    """address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section
    summary table tbody td tfoot th thead tr ul""".split()
)
#: Elements without an end tag of their own to wait for: a hint on one lasts for its block.
_FLAT = frozenset("p li dd dt h1 h2 h3 h4 h5 h6 hr td th tr option col caption tbody thead tfoot colgroup optgroup".split())
# Class names and ids of boilerplate; several words in one name, or with words of _WITH, mean the same.
_SURE = frozenset(
    """ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr popup popups modal
    sidebar nav navbar navigation breadcrumb breadcrumbs comment comments commentlist disqus replies respond responses share sharing social newsletter subscribe
    subscription signup login pagination pager masthead skip skiplink toolbar""".split()
)
_MAYBE = frozenset("header footer banner notice notices alert alerts overlay menu menus related recommended recommendations copyright legal widget widgets".split())
_WITH = frozenset(
    """site main page top bottom left right primary secondary global box bar list links link item items button buttons container wrapper section area block inner
    outer slot unit post posts article articles story stories more content text form sticky side reader user thread icons media policy law info mobile desktop js""".split()
)
#: With these a name of _MAYBE is a part of an article.
_OWN = frozenset("article post story section content text block".split())
_PART = re.compile(r"[^-_]+")
#: Tags whose quotes never close, after which quotes no longer count.
BROKEN = 8
NONE, MAYBE, SURE = 0, 1, 2
_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"""(?:[^'">]|"[^"]*"|'[^']*')*+>""")
_TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_COPYRIGHT = re.compile(r"©|\(c\)\s*\d{4}|copyright|all rights reserved", re.I)
_WORD = re.compile(r"[^\W\d_]+")


@functools.lru_cache(4096)
def _name_says(name: str) -> int:
    parts = [p.rstrip("0123456789") for p in _PART.findall(name)]
    parts = [p for p in parts if p]
    if not parts or not all(p in _SURE or p in _MAYBE or p in _WITH for p in parts):
        return NONE
    if any(p in _SURE for p in parts):
        return SURE
    if any(p in _MAYBE for p in parts) and not any(p in _OWN for p in parts):
        return MAYBE
    return NONE


def _says_out(attributes: str) -> tuple[int, bool]:
    """How surely class and id mark boilerplate; and whether role or a hiding attribute does."""
    said = NONE
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            said = max([said, *map(_name_says, value.split())])
        elif name == "role" and value in _ROLE or name == "hidden" or name == "aria-hidden" and value == "true":
            return SURE, True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return SURE, True
    return said, False


class Block:
    """main: the number of the article or main element around it, 0 for none; out: whether its place rules it out; around, inside: how surely
    names do, those of main and what is around it, and those of elements inside of it."""

    __slots__ = ("text", "linked", "main", "out", "around", "inside", "title", "label")

    def __init__(self, text: str, linked: int, main: int, out: bool, around: int, inside: int, title: bool):
        self.text, self.linked, self.main, self.out, self.around, self.inside, self.title, self.label = text, linked, main, out, around, inside, title, None

    @property
    def density(self) -> float:
        return self.linked / max(1, len(self.text.replace(" ", "")))


def _tags(page: str):
    """(place, end, closing, name, attributes) of all tags, comments left out; the place after each may be moved by sending it."""
    at, last, broken = 0, page.rfind(">"), 0
    while 0 <= (start := page.find("<", at)) < last:
        m = _TAG.match(page, start)
        if m is None:
            at = start + 1
            if page.startswith(("!", "?"), at):
                close = ("-->", start + 4) if page.startswith("!--", at) else (">", at)
                end = page.find(*close)
                at = len(page) if end < 0 else end + len(close[0])
                yield start, at, "", "!", ""
            continue
        end = _QUOTED.match(page, m.end()) if broken < BROKEN else None
        if end is None:
            broken += 1
            at = page.find(">", m.end()) + 1
        else:
            at = end.end()
        moved = yield start, at, m[1], m[2].lower(), page[m.end() : at - 1]
        if moved is not None:
            at = moved
            yield start, at, "", "!", ""
    if start >= 0 and (page.startswith("!--", start + 1) or _TAG.match(page, start)):
        yield start, len(page), "", "!", ""


def blocks(page: str) -> list[Block]:
    """The page's blocks that have text."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int, int]] = [("", False, NONE, NONE, 0)]  # element, out, around, inside, main
    opened: dict[str, int] = {}
    parts: list[str] = []
    links = linked = mains = 0
    flat, title = (NONE, False), False

    def add(text: str) -> int:
        parts.append(text)
        return len("".join(text.split())) if links else 0

    at = 0
    tags = _tags(page)
    for start, end, ending, name, attributes in tags:
        if start > at:
            linked += add(page[at:start])
        at = end
        if name in _RAW:
            if not ending and not (name == "svg" and attributes.endswith("/")):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, end)
                at = close.end() if close else len(page)
                tags.send(at)
            parts.append(" ")
        elif name == "a":
            links = 0 if ending else 1
        elif name == "br":
            parts.append(" ")
        elif name in _BLOCK:
            _block(out, parts, linked, stack[-1], flat, title)
            linked, flat, title = 0, (NONE, False), False
            if name in _FLAT:
                if not ending:
                    flat, title = _says_out(attributes) if attributes else flat, name in _TITLES
            elif ending:
                if opened.get(name):
                    while stack[-1][0] != name:
                        opened[stack.pop()[0]] -= 1
                    opened[stack.pop()[0]] -= 1
            elif not attributes.endswith("/"):
                _, bad, around, inside, main = stack[-1]
                said, hidden = _says_out(attributes) if attributes else (NONE, False)
                bad = bad or name in _OUT or name == "header" and not main or hidden
                if name == "body":
                    said = NONE
                if main:
                    inside = max(inside, said)
                else:
                    around = max(around, said)
                if name in _MAIN and not bad and not main:
                    mains += 1
                    main = mains
                stack.append((name, bad, around, inside, main))
                opened[name] = opened.get(name, 0) + 1
            links = 0
    if at < len(page):
        linked += add(page[at:])
    _block(out, parts, linked, stack[-1], flat, title)
    return out


def _block(out: list[Block], parts: list[str], linked: int, within: tuple, flat: tuple, title: bool) -> None:
    text = " ".join(html.unescape("".join(parts)).split())
    parts.clear()
    if text:
        _, bad, around, inside, main = within
        out.append(Block(text, linked, main, bad or flat[1], around if main else max(around, flat[0]), max(inside, flat[0]) if main else NONE, title))


def first_pass(b: Block, bounded: bool, known: bool = True) -> bool | None:
    """True for main text, False for boilerplate, None for open.  known: the page has stop words."""
    size, density = len(b.text), b.density
    if b.out or bounded and not b.main or density > LINKS:
        return False
    if not b.main and _COPYRIGHT.search(b.text):
        return False
    if size < SHORT:
        return False if density > 0 and not b.main else None
    words = _WORD.findall(b.text.lower())
    stop = sum(w in STOP_WORDS for w in words) / max(1, len(words)) if known else STOP_HIGH
    if stop >= STOP_HIGH:
        return True if size > LONG or b.main else None
    if stop >= STOP_LOW or b.main:
        return True if b.main and size > LONG else None
    return False


def _prose(b: Block) -> bool:
    words = _WORD.findall(b.text.lower())
    return len(b.text) > LONG and b.density <= LINKS / 2 and sum(w in STOP_WORDS for w in words) >= STOP_HIGH * len(words)


def _use_names(found: list[Block]) -> None:
    """Rules out the blocks that names mark."""
    held = [b for b in found if not b.out]
    least = min((b.around for b in held if b.main), default=None)  # if every article lies below such a name, it says nothing
    if least is None and all(b.around for b in held):
        return
    for b in held:
        b.out = b.around > (least if b.main else NONE) or b.inside == SURE or b.inside == MAYBE and not _prose(b)


def main_blocks(page: str | None) -> list[str]:
    found = blocks(page) if page else []
    _use_names(found)
    bounded = any(b.main and not b.out for b in found)
    known = any(w in STOP_WORDS for b in found if not b.out for w in _WORD.findall(b.text.lower()))
    given = [first_pass(b, bounded, known) for b in found]
    near: list[list[tuple[int, bool]]] = [[] for _ in found]  # the decided neighbours of each block: how far, and their label
    for step in (1, -1):
        last, main = None, None
        for i in range(len(found))[::step]:
            if found[i].main != main:
                last, main = None, found[i].main
            if given[i] is None:
                near[i] += [(abs(i - last), given[last])] if last is not None else []
            elif not found[i].out:
                last = i
    for i, b in enumerate(found):
        b.label = given[i]
        if b.label is None and near[i]:
            b.label = near[i][-1][1] if b.title else min(near[i], key=lambda x: x[0])[1]
        elif b.label is None:  # nothing decided around: the article's own short blocks stay, others need signs of prose
            b.label = bool(b.main) or len(b.text) >= SHORT and (not known or any(w in STOP_WORDS for w in _WORD.findall(b.text.lower())))
    return [b.text for b in found if b.label]


def extract(page: str | None) -> str:
    return "\n\n".join(main_blocks(page))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_extraction": op5_html_extraction}
