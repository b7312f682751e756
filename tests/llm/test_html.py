import itertools
import random
import re
from html import unescape

import pytest

from tallygrid.llm.html import blocks_of, classify, extract_pages, main_text, minimum_cut, op1_html, smoothness

PAGE = """<html><head><title>t</title></head><body><header><a href=/>home</a></header>
<div class="cookie-notice">We use cookies, a rather long notice with many words that go on and on and on.</div>
<article><header><h1>Title &amp; more</h1></header><p>Short.</p><p>Some <b>bold</b>&nbsp;text
  here &lt;tag&gt;.<br><p>Second<script>var t="</p>";</script></p><ul><li>one<li>two</ul>
<form><label>mail</label><input></form><section class="comments"><p>A long comment by a reader that
goes on for many words so that it looks like an article but it is none of that kind.</p></section></article>
<aside>Related</aside><!-- ad --><footer>&copy; 2020</footer></body></html>"""


def test_article_without_boilerplate():
    assert main_text(PAGE) == "Title & more\nShort.\nSome bold text here <tag>.\nSecond\none\ntwo"


@pytest.mark.parametrize("page", [None, "", " \n ", "<html></html>", "<!-- x", "<script>a", "<p", "<a href='", "&amp"])
def test_pages_without_content(page):
    assert main_text(page) in ("", "<p", "<a href='", "&")


LONG = "word " * 40


@pytest.mark.parametrize("tag", ["video-player", "svg-icon", "title-bar", "select-box", "template-x", "script-x"])
def test_custom_elements_are_no_raw_elements(tag):
    page = f"<article><p>{LONG}</p><{tag}></{tag}><p>rest {LONG}</p></article>"
    assert main_text(page) == f"{LONG.strip()}\nrest {LONG.strip()}"


@pytest.mark.parametrize("inner", ["<svg class=i/>", "<math/>", "<svg><title>t</title><path/><text>x</text></svg>", "<video src=v>",
                                   "<select><option>x<option>y</select>", "<video src='>'><p>none</p></video >"])
def test_embedded_elements_do_not_cut_the_text(inner):
    assert main_text(f"<article><p>a {inner} b</p><p>{LONG}</p></article>") == f"a b\n{LONG.strip()}"


def test_a_closed_element_after_an_open_one_does_not_hide_what_follows_its_parent():
    page = f"<article><div><video src=v><p>x</p></div><p>{LONG}</p><video>none</video><p>b</p></article>"
    assert main_text(page).endswith(f"{LONG.strip()}\nb")


@pytest.mark.parametrize("wrapper", ['body class="home has-sidebar"', 'html class="no-ad"', "div id=wrapper class=with-sidebar",
                                     "div class=social", "section class=notice", "form id=aspnetForm", "article class=no-sidebar", "main class=with-sidebar"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_wrappers_with_names_of_boilerplate(wrapper, inner):
    side = "<div class=sidebar><p>Some words beside the text</p></div>"
    page = f"<{wrapper}><{inner}><p>{LONG}</p><p>{LONG}</p></{inner}>{side}</{wrapper.split()[0]}>"
    assert main_text(page) == f"{LONG.strip()}\n{LONG.strip()}"


def test_lists_of_articles_and_teasers():
    one = f"<div class=share><article><p>{LONG}</p></article></div>"
    related = "<div class=related><article><p>A teaser of few words.</p></article></div>"
    related += f"<article class=comment><p>{LONG}</p></article>"
    assert main_text(one + one + related) == f"{LONG.strip()}\n{LONG.strip()}"


OTHER = "other " * 40


@pytest.mark.parametrize("element", ["div class=ad", "p class=advert", "p class=notice", "div class='cookie-consent box'", "section id=comments",
                                     "div role=search", "div class=share-buttons", "div class='related posts-list'"])
@pytest.mark.parametrize("times", [1, 6])
def test_adverts_notices_and_comments_go_at_any_length(element, times):
    inner = f"<{element}>{OTHER * times}</{element.split()[0]}>"
    assert main_text(f"<article><p>{LONG}</p>{inner}<p>{LONG}</p></article>") == f"{LONG.strip()}\n{LONG.strip()}"
    assert main_text(f"<div><div><p>{LONG}</p>{inner}<p>{LONG}</p></div></div>") == f"{LONG.strip()}\n{LONG.strip()}"


def test_comments_and_notices_longer_than_the_text():
    comments = f"<div class=comments><p>{OTHER * 3}</p><p>{OTHER * 3}</p></div>"
    assert main_text(f"<div class=post>{LONG}</div>{comments}") == LONG.strip()
    assert main_text(f"<div class=post>Ten short words are all that there is in here.</div>{comments}") == "Ten short words are all that there is in here."
    assert main_text(f"<div class=cookie-notice>{OTHER * 5}</div><div>{LONG}</div>") == LONG.strip()
    assert main_text(f"<div class=notice>{OTHER * 5}</div><div>{LONG}</div>") == LONG.strip()


@pytest.mark.parametrize("attribute", ['data-id="search"', "data-role='share'", 'title="class=ad"', 'data-x="id=menu"', 'aria-label="class = comments"',
                                       "class=no-comments", 'class="has-ads with-sidebar"'])
def test_only_names_are_names(attribute):
    assert main_text(f"<article><p>{LONG}</p><p {attribute}>{OTHER}</p></article>") == f"{LONG.strip()}\n{OTHER.strip()}"


@pytest.mark.parametrize("page", ["<div><p>A short note of six words.</p></div>", "A short note of six words.", "<p>A short note of six words.",
                                  "<nav><a href=/>home</a></nav><div><p>A short note of six words.</p></div><footer>end</footer>"])
def test_short_pages_keep_their_text(page):
    assert main_text(page) == "A short note of six words."


def test_pages_of_links_and_menus_have_no_text():
    assert main_text("<nav><p>one two</p></nav><ul><li><a href=x>one</a><li><a href=y>two</a></ul><footer>f</footer>") == ""


def test_teasers_inside_links():
    teaser = f"<a href=/x><div><h3>More to read</h3><p>{OTHER}</p></div></a>"
    assert main_text(f"<article><p>{LONG}</p><p>{LONG}</p>{teaser}</article>") == f"{LONG.strip()}\n{LONG.strip()}"
    assert main_text(f"<div><p>{LONG}</p></div>{teaser}<div><p>{LONG}</p></div>") == f"{LONG.strip()}\n{LONG.strip()}"
    # A link that is not closed does not swallow what follows.
    assert main_text(f"<article><p>{LONG}<a href=x>y</p><p>{LONG}</p><p><a name=z>{LONG}</p></article>").count("\n") == 2


def test_no_markup_is_left():
    assert main_text(f"<article><p title=\"a>{LONG}</p><p class='b'>{OTHER}</p></article>") == f"{LONG.strip()}\n{OTHER.strip()}"
    assert main_text(f"<article><p title='a>{LONG}</p></article>") == LONG.strip()


def test_captions_bylines_and_formulas_are_text():
    page = f"<article><p class=byline>By A. Author</p><p>{LONG}</p><p class=caption>A map</p><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> is</p></article>"
    assert main_text(page) == f"By A. Author\n{LONG.strip()}\nA map\nSo x=1 is"


def test_cut_is_minimal():
    draw = random.Random(4)
    for _ in range(40):
        n = draw.randrange(1, 8)
        gains = [draw.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, draw.uniform(0, 2)) for a in range(n) for b in range(a) if draw.random() < 0.5]

        def cost(labels, gains=gains, edges=edges):
            wrong = sum(max(g, 0) if not x else max(-g, 0) for g, x in zip(gains, labels, strict=True))
            return wrong + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(cost(x) for x in itertools.product((False, True), repeat=n))
        assert cost(minimum_cut(gains, edges)) == pytest.approx(best)


def test_smoothness_keeps_a_short_block_between_long_ones():
    long = "<p>" + "word " * 60 + "</p>"
    blocks = blocks_of(f"<div>{long}<p>Hm.</p>{long}</div>")
    assert classify(blocks[1]) < 0
    assert all(minimum_cut([classify(b) for b in blocks], smoothness(blocks)))


def test_long_page():
    page = "<article>" + "".join(f"<p>paragraph {k}</p>" for k in range(5000)) + "</article>"
    assert main_text(page).count("\n") == 4999


def test_rows(spark):
    pages = spark.createDataFrame(
        [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (3, "v", "", "y")],
        "page_id long, url string, html string, text string",
    )
    rows = extract_pages(pages).collect()
    assert sorted(r.n_chars for r in rows) == [0, 0, len(main_text(PAGE)), len(main_text(PAGE))]
    assert extract_pages(pages.limit(0)).count() == 0


def test_query_against_the_article_element(spark):
    """In these pages the main text is the article element."""
    path = "/root/testdata/sf0.001"
    wanted = {}
    for r in spark.read.parquet(f"{path}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        wanted[r.page_id] = "\n".join(x for x in parts if x)
    assert {r.page_id: r.text for r in op1_html(spark, path).collect()} == wanted
