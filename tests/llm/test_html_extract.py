import time

import pandas as pd
import pytest

from tessera.llm import html_extract
from tessera.llm.html_extract import extract

SF = "/root/testdata/sf0.01"
LONG = "The quick fox and the dog went to the river because it was the only way for them to be seen by all of us."


def test_odd_inputs():
    assert extract(None) == extract("") == extract("   ") == extract("<html><body></body></html>") == ""
    assert extract("<script>var a = '<p>" + LONG + "</p>';") == ""
    assert extract("<p>" + LONG + " <script>x</script>&amp; &eacute;&#233;&nbsp;&nbsp;more<!-- no --></p") == LONG + " & éé more"
    assert extract("<p>" + LONG + "<!-- never closed " + LONG) == LONG
    assert extract(LONG) == LONG
    assert extract("<" * 20000) is not None and extract("<a " * 20000) is not None and extract("<p>" * 20000 + LONG) == LONG
    assert extract("<div>" * 3000 + LONG + "</div>" * 3000) == LONG


def test_slashes_do_not_close_html_elements():
    assert extract(f"<script src=/js/>var leak = 1</script><p>{LONG}</p>") == LONG
    assert extract(f"<div/><p>{LONG}</p></div><script/>var leak</script>") == LONG
    assert extract(f"<p>{LONG}</p><p><a href=http://x.com/>Home</a> <a href=/b/>All of it and more and more</a></p><footer>f") == LONG
    assert extract(f"<svg/><p>{LONG}</p>") == LONG and extract(f"<svg width=5/><text>leak</text></svg><p>{LONG}</p>") == LONG


@pytest.mark.parametrize("tag", ["button", "select", "object", "svg", "template", "video", "canvas", "map"])
def test_unclosed_controls_end_at_a_block_or_with_their_parent(tag):
    assert extract(f"<{tag}>Open<p>{LONG}") == LONG
    assert extract(f"<div><{tag}>Open</div>{LONG}") == LONG
    assert extract(f"<div><{tag}><p>{LONG}</p></{tag}></div><p>{LONG}</p>") == LONG
    assert extract(f"<{tag}>Open<p>{LONG}</p><{tag}>{LONG}</{tag}>") == LONG


def test_attributes_are_told_from_their_values():
    assert extract(f'<div title="hidden gem, class=ad"><p>{LONG}</p></div>') == LONG
    assert extract(f'<div data-x="a>b" class=\'story\'><p>{LONG}</p></div>') == LONG
    assert extract(f'<p>{LONG} <b title=">">so</b> "quoted" <i ">it</i></p>') == f'{LONG} so "quoted" it'
    assert extract(f"<form><main><p>{LONG}</p></main><p>{LONG}</p></form>") == LONG
    assert extract(f"<!--> <p>{LONG}</p><![CDATA[ x ]]><p>1 < 2 </p>") == f"{LONG} 1 < 2"


def test_pages_without_names_go_by_density():
    menu = "".join(f"<div><a href=/{k}>Item {k}</a></div>" for k in range(9))
    page = f"<body><div>{menu}</div><div><h2>Head</h2><div>{LONG}</div><div>Ha.</div><div>{LONG}</div></div><div>{menu}<div>All rights</div></div></body>"
    assert extract(page) == f"Head {LONG} Ha. {LONG}"


@pytest.mark.parametrize("unit", ["<div>", "<span>x", "<span>x</p>", '<a "', "<![CDATA[x", "<b ", "<p><span>", "<a href='", "<!--", "<button>", "<table><span></div>", "<svg>x", "</p>", "<p></p>", "&", "<div class=ad>", "<main>", '="', "<x =\"'>"])
@pytest.mark.parametrize("lead", ["", "<div><table>", "<span>" * 3000])
def test_time_grows_with_length(unit, lead):
    def seconds(n):
        began = time.process_time()
        extract(lead + unit * n)
        return time.process_time() - began

    extract(unit * 100)
    assert seconds(100_000) < 2 * 10 * max(0.05, min(seconds(10_000) for _ in range(2)))


def test_inline_markup_keeps_words_whole():
    assert extract(f"<p>{LONG} in<b>sep</b>arable <i>x</i>\n\n y<br>z</p>") == f"{LONG} inseparable x y z"


@pytest.mark.parametrize(
    "junk",
    [
        "<nav><ul><li><a href=x>Home</a></li></ul></nav>",
        f"<div class='ad'>{LONG}</div>",
        f"<aside><p>{LONG}</p></aside>",
        f"<div id=sidebar><p>{LONG}</p></div>",
        f"<footer>{LONG}</footer>",
        f"<div class='cookie-notice'>{LONG}</div>",
        f"<section id='comments'><h2>Comments</h2><div class='comment'><p>{LONG}</p></div></section>",
        f"<form><label>{LONG}</label><input></form>",
        f"<div><a href=a>{LONG}</a> <a href=b>{LONG}</a></div>",
        "<style>p{}</style><title>The title of it</title>",
    ],
)
def test_junk_around_an_article_goes(junk):
    main = f"<article><h1>Short head</h1><p>{LONG}</p><p>Ha.</p><p>{LONG}</p></article>"
    want = f"Short head {LONG} Ha. {LONG}"
    assert extract(f"<html><head></head><body>{junk}{main}</body></html>") == want
    assert extract(f"<html><body>{main}{junk}") == want


def test_short_blocks_follow_their_neighbours():
    page = f"<body><div><a href=1>Menu one</a></div><div>Tiny menu note</div><div><a href=2>More</a></div><hr><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></body>"
    assert extract(page) == f"{LONG} Yes. {LONG}"


def test_pages_match_their_articles(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = html_extract.extracted(pages).toPandas().set_index("page_id")
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))).split())
        assert got.text[r.page_id] == want and got.n_chars[r.page_id] == len(want)


def test_rows(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "x"), (1, "u", f"<p>{LONG}</p>", "x"), (None, None, None, "x")]
    got = html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted([tuple(r) for r in got], key=repr) == sorted([(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0)], key=repr)
    assert html_extract.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    assert pd.DataFrame(got).shape == (3, 4)


OTHER = "I think that this is what they all want and it is not for me to say that they are in the wrong here."
DUTCH = (
    "Het schip voer gisteren langzaam langs kleine eilanden terwijl vissers hun netten binnenhaalden omdat zware wolken snel dichterbij kwamen; niemand sprak hardop want iedereen "
    "luisterde naar golven die steeds hoger tegen houten planken sloegen totdat eindelijk verderop licht scheen boven donkere rotsen waar oude torens stonden"
)
RUSSIAN = " ".join("корабль медленно плыл вдоль берега пока рыбаки тянули сети".split() * 7)


@pytest.mark.parametrize("name", ["no-sidebar", "site with-header", "page-with-header", "elementor-widget", "header-main-content", "share-price-report", "ad-free-story", "hasSidebar", "article-header", "entry-footer"])
def test_a_word_with_another_sense_does_not_drop_an_article(name):
    assert extract(f'<div class="{name}"><p>{LONG}</p></div>') == LONG
    assert extract(f'<div class="{name}"><article><p>{LONG}</p></article></div>') == LONG


@pytest.mark.parametrize(
    "start", ["div class=story-comments", "div class=post-comments", "article class=comment-body", "article class='comment odd'", "ol class=commentlist", "div id=comments", "section class=comment-list", "div class=content-ad", "div class=post-sidebar",
              "div class=sidebar-widget", "div class=share-buttons", "div class=ad", "div class='ad-slot-2'", "div class=cookieBanner", "div class=header-top", "div class=newsletter-signup", "div class=related-posts", "div class=site-footer"]
)
def test_sections_named_as_boilerplate_go(start):
    assert extract(f"<article><p>{LONG}</p></article><{start}><p>{OTHER}</p></{start.split()[0]}>") == LONG


def test_a_form_around_the_page_and_a_form_in_it():
    assert extract(f"<form id=f><p>{LONG}</p></form>") == LONG
    assert extract(f"<form id=f><nav><a href=/>Home</a></nav><div><p>{LONG}</p></div></form>") == LONG
    assert extract(f"<p>{LONG}</p><form><p>{OTHER}</p></form>") == LONG


@pytest.mark.parametrize("text", [DUTCH, RUSSIAN, RUSSIAN + " " + RUSSIAN])
def test_prose_without_listed_stop_words(text):
    assert extract(f"<nav><a href=/>Home</a> <a href=/b>More</a></nav><p>{text}</p>") == text
    assert extract(f"<nav><a href=/>Home</a></nav><div><h1>Kop</h1><p>{text}</p></div><footer>adres</footer>").endswith(text)


def test_short_prose_beside_menus_only():
    short = "Drie korte zinnen staan hier. Niemand leest ze ooit. Toch blijven ze."
    assert extract(f"<nav><a href=/>Home</a></nav><p>{short}</p><footer>adres</footer>") == short
    many = "".join(f"<p>{short}</p>" for _ in range(20000))
    began = time.time()
    assert extract(f"<nav><a href=/>Home</a></nav>{many}").count("Drie") == 20000 and time.time() - began < 20
