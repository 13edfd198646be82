import random
import time

import pytest
from lexspan.llm import html_text

DATA = "/root/testdata/sf0.001"
PROSE = "This is the text of the article and it has many words in it. "


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


def test_article_without_its_surroundings():
    html = page(
        "<header><a href=/>Home</a></header><nav><ul><li><a href=/a>The first</a></li></ul></nav><!-- a > b -->"
        f"<div class='ad'>{PROSE * 3}</div><article><h1>Title &amp; more</h1><p>{PROSE * 4}<b>bold</b><br>line</p><p>Short.</p><p>{PROSE * 4}</article>"
        f"<aside>{PROSE * 4}</aside><section id=comments><article class=comment><p>{PROSE * 5}</p></article></section><form>{PROSE * 4}</form><div class='cookie-notice'>{PROSE * 4}</div><footer>&copy; 2020</footer>"
    )
    assert html_text.extract(html) == "\n\n".join(["Title & more", (PROSE * 4).strip() + " bold line", "Short.", (PROSE * 4).strip()])


def test_without_an_article_density_decides():
    links = "".join(f"<a href=/{i}>link number {i}</a> " for i in range(10))
    html = page(f"<div><p>{links}</p></div><div><h2>A title</h2><p>{PROSE * 5}</p><p>Between.</p><p>{PROSE * 5}</p></div><div><p>{links}</p><p>Near links</p></div>")
    assert html_text.main_blocks(html) == ["A title", (PROSE * 5).strip(), "Between.", (PROSE * 5).strip()]


def test_odd_pages():
    for x in (None, "", "<html></html>", "<script>alert('x')", "<!-- open", "<p", "<" * 50, "<a " + "'" * 3000):
        assert isinstance(html_text.extract(x), str)
    assert html_text.extract("<script>var x = '</p>'</script><style>p{}") == ""
    assert html_text.extract(f"<article><p>{PROSE * 5}") == (PROSE * 5).strip()
    assert html_text.extract(f"<article><p>&#x41;&#66;&eacute;&nbsp;&lt;b&gt; {PROSE * 5}</p></article>").startswith("ABé <b> This")
    big = "<article>" + f"<p>{PROSE * 5}</p>" * 3000 + "</article>"
    assert len(html_text.main_blocks(big)) == 3000


def test_every_page(spark):
    got = {r["page_id"]: r for r in html_text.op5_html_extraction(spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        r = got[p["page_id"]]
        assert (r["url"], r["n_chars"]) == (p["url"], len(r["text"]))
        inside = p["html"].split("<article>")[1].split("</article>")[0] if p["html"] and "<article>" in p["html"] else ""
        plain = "".join(__import__("html").unescape(__import__("re").sub(r"<[^>]*>", "", inside)).split())
        assert "".join(r["text"].split()) == plain
    odd = spark.createDataFrame([(1, None, None), (None, "u", "")], "page_id long, url string, html string")
    assert [(r["text"], r["n_chars"]) for r in html_text.extract_pages(odd).collect()] == [("", 0), ("", 0)]


ARTICLE = f"<article><h1>The title</h1><p>{PROSE * 4}</p></article>"
WANT = "The title\n\n" + (PROSE * 4).strip()


@pytest.mark.parametrize(
    "body",
    [
        f'<div class="layout has-sidebar">{ARTICLE}</div>',
        f'<div class="sidebar layout">{ARTICLE}</div>',
        f'<main class="content no-sidebar"><h1>The title</h1><p>{PROSE * 4}</p></main>',
        f'<article><header class="entry-header"><h1>The title</h1></header><p>{PROSE * 4}</p></article>',
        f'<article><h1>The title</h1><section id="related-work"><p>{PROSE * 4}</p></section></article>',
        f'<article><h1>The title</h1><section id="legal-background"><p>{PROSE * 4}</p></section></article>',
        f'<article><h1>The title</h1><div class="notice"><p>{PROSE * 4}</p></div></article>',
        f'{ARTICLE}<section class="related-posts"><article><p>{PROSE * 4}</p></article></section>',
        f'{ARTICLE}<div class="site-footer"><p>{PROSE * 4}</p></div><div id="cookie-consent">{PROSE * 4}</div>',
        f'<article><h1>The title</h1><div class="share-buttons">{PROSE}</div><div class="legal">Short.</div><p>{PROSE * 4}</p></article>',
    ],
)
def test_names_count_as_a_whole(body):
    assert html_text.extract(page(body)) == WANT


def test_elements_whose_text_stays_or_goes():
    got = html_text.extract(f"<article><p>{PROSE * 4}<math><mi>x</mi></math> is it</p><script src=x /> var secret </script><p>{PROSE * 4}</p></article>")
    assert "x is it" in got and "secret" not in got


def test_a_page_in_a_language_without_known_words():
    text = "Съешь же ещё этих мягких французских булок да выпей чаю. " * 6
    links = "".join(f"<a href=/{i}>ссылка номер {i}</a> " for i in range(10))
    assert html_text.extract(page(f"<div>{links}</div><div><p>{text}</p><p>{text}</p></div>")) == "\n\n".join([text.strip()] * 2)


@pytest.mark.parametrize(
    "body",
    ["<ul>" + "<li>short" * 110_000, "<p>x " + "<a " * 340_000, "<p>x " + "<a " * 340_000 + ">", "<p>" + '<a "x>"y' * 110_000, "<p>" + '<a "x>"y' * 110_000 + "'", "<p>" + "<a '" * 250_000 + ">", "<div>" * 100_000 + "</section>" * 90_000, "<" * 1_000_000, "<!-" * 330_000],
)
def test_pages_of_a_megabyte_take_linear_time(body):
    began = time.process_time()
    html_text.extract(body)
    assert time.process_time() - began < 2.5


def test_random_pages_against_their_parts():
    """Pages made of parts whose label is known."""
    rng = random.Random(8)
    sentence = lambda: " ".join(rng.choice("the of and tree river house window light to in a".split()) for _ in range(12)).capitalize() + "."
    for _ in range(200):
        wanted, body = [], []
        for _ in range(rng.randint(1, 8)):
            kind, text = rng.random(), " ".join(sentence() for _ in range(rng.randint(5, 9)))
            if kind < 0.5:
                wanted.append(text)
                body.append(f"<p>{text}</p>" if rng.random() < 0.5 else f"<div class='{rng.choice(['col-2 has-nav', 'entry-content', 'x'])}'>{text}</div>")
            elif kind < 0.7:
                body.append(f"<{(tag := rng.choice(['aside', 'form', 'nav']))}>{text}</{tag}>")
            elif kind < 0.9:
                body.append(f"<div class='{rng.choice(['comments', 'ad-slot', 'newsletter signup', 'cookie-banner', 'share-buttons'])}'><p>{text}</p></div>")
            else:
                body.append(f"<!-- {text} --><script>{text}</script>")
        around = f"<header><p>{sentence()}</p></header>", f"<footer><p>{sentence()}</p></footer>"
        html = page(around[0] + rng.choice(["<main{}>{}</main>", "<article{}>{}</article>"]).format(rng.choice(["", " class='page wide'"]), "".join(body)) + around[1])
        assert html_text.main_blocks(html) == wanted


def test_odd_tables(spark):
    rows = [(1, "u", ARTICLE, "x", 5), (1, "u", ARTICLE, "x", 5), (None, None, ARTICLE, None, None), (2, "v", None, "y", 1)]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_text.extract_pages(odd).collect())
    assert got == [("1", WANT, len(WANT)), ("1", WANT, len(WANT)), ("2", "", 0), ("None", WANT, len(WANT))]
    assert html_text.extract_pages(odd.limit(0)).count() == 0
