"""Main texts: pages by hand, odd markup, and the given pages against their article element."""

import html
import re

import pytest

from matchmart.llm import html_text as h

from .helpers import SMALL, table

BODY = "A long enough line of the article's text, with commas, words and a full stop at its end."


@pytest.mark.parametrize("page, want", [
    ("", ""),
    ("   \n ", ""),
    ("just text", "just text"),
    ("<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>T</h1><p>One  two<br>three<p>B</article><footer>f</footer>",
     "T\n\nOne two three\n\nB"),
    ("<article><p>a &amp; b &lt;i&gt; &eacute; &#233; &#x41; &copy x</p></article>", "a & b <i> é é A © x"),
    ("<article><p>in<b>li</b>ne</p><script>var t='</p>';</script><style>p{}</style><!-- <p>no --></article>", "inline"),
    ('<article><div class="ad">buy</div><p>keep</p><section id="comments"><p>first!</p></section></article>', "keep"),
    ('<div class="cookie-notice">We use cookies</div><main><p title="a > b">x</p></main>', "x"),
    ('<nav><a href=/>never closed<article><p>kept</p></article>', "kept"),
    ('<article><header><h1>Title</h1></header><p>x</p></article><header>site</header>', "Title\n\nx"),
    (f"<div><a href=/>Home</a></div><p>{BODY}</p><p>Short.</p><ul><li><a href=/>next</a></ul>",
     f"{BODY}\n\nShort."),
    ("<article><p>unfinished <b", "unfinished <b"),
    ("<p>" + "<div class=nav><div>x</div>y</div>" * 2 + "z", "z"),
    ('<article><form><input><p>name</p></form><p>x</p><aside>s</aside><div role="alert">!</div><div hidden>h</div></article>', "x"),
])
def test_by_hand(page, want):
    assert h.main_text(page) == want


def test_without_marks_the_long_stretch_between_surge_and_dive_stays():
    links = "<p><a href=/>link</a></p>" * 4
    page = f"<p>tiny</p>{links}<p>{BODY}</p><p>s</p><p>{BODY}</p>{links}<p>end</p>"
    assert h.main_text(page) == f"{BODY}\n\ns\n\n{BODY}"


CARD = "<article><h3>Other story</h3><p>A teaser.</p></article>"


@pytest.mark.parametrize("page", [
    f"<div id=content><p>{BODY}</p><p>Second.</p></div>" + "<p><a href=/>link</a></p>" * 3 + CARD,
    CARD + "<p><a href=/>link</a></p>" * 3 + f"<div id=content><p>{BODY}</p><p>Second.</p></div>",
])
def test_a_small_article_beside_a_body_in_a_div_does_not_win(page):
    assert h.main_text(page) == f"{BODY}\n\nSecond."


def test_an_article_with_most_of_the_text_decides():
    assert h.main_text(f"<p>Beside it, some words.</p><article><p>{BODY}</p><p><a href=/>link</a></p></article><p>after</p>") == (
        f"{BODY}\n\nlink")


@pytest.mark.parametrize("page, want", [
    ("<article><p>x</p></article><div class=comments><article class=comment><p>c</p></article></div>", "x"),
    ("<article><p>x</p></article><article class='comment even'><p>c</p></article>", "x"),
    ("<article class='post category-social has-sidebar'><p>x</p></article><aside><article>card</article></aside>", "x"),
    ("<article><p>x</p><ul><li class=comment><p>c</p><p>d</p></li><li>y</ul></article>", "x\n\ny"),
    ("<article><ul><li class=ad>c<li>y<li class=ad>d</ul><p>x</p></article>", "y\n\nx"),
    ("<article><div><p class=ad>c</div>t<p class=ad>d<p>x</article>", "t\n\nx"),
    ("<nav><ul><li>never closed<article><nav>n</nav><p>x</p></article>", "x"),
    ("<article><header class=entry-header><h1>T</h1></header><div class=article-header>S</div><p>x</p></article>", "T\n\nS\n\nx"),
    ("<div id=page><div class=ad>never closed<article><p>x</p></article></div>", "x"),
    ("<article><div><ul><li class=ad>c</div><p>x</p><ul><li>y</ul><li class=ad>d<p>z</article>", "x\n\ny\n\nz"),
    ("<div class='page has-sidebar'><article><p>x</p></article></div>", "x"),
    (f"<div class='no-sidebar'><p>{BODY}</p></div><div class='site-footer'>f</div><div class=sidebar-left>s</div>", BODY),
    (f"<p>{BODY}</p><p><a href=/>a linked line</a></p><p>{BODY}</p><p><a href=/>after</a></p>",
     f"{BODY}\n\na linked line\n\n{BODY}"),
])
def test_what_goes_and_what_stays(page, want):
    assert h.main_text(page) == want


def test_long_and_hostile_pages_are_linear():
    assert len(h.main_text("<article>" + "<p>word " * 100_000)) == 6 * 100_000 - 2
    assert h.main_text("<div class='a' " * 3000) is not None
    assert h.main_text("<" * 50_000) == "<" * 50_000
    assert h.main_text("&" * 50_000) == "&" * 50_000


def test_given_pages_give_their_article(spark):
    rows = {r.page_id: r.html for r in table(spark, "pages").collect()}
    got = {r.page_id: r for r in h.query(spark, SMALL).collect()}
    assert got.keys() == rows.keys()
    for i, page in rows.items():
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", b)).split())
                  for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[i].text == "\n\n".join(b for b in blocks if b)
        assert got[i].n_chars == len(got[i].text)


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, 5), (1, "u", "", 6), (None, "v", "<p>t", 7)],
                                  "page_id long, url string, html string, n_chars int")
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in h.extract(pages).collect()) == [
        (0, "v", "t", 1), (1, "", "", 0), (1, "u", "", 0)]
    assert h.extract(pages.limit(0)).count() == 0


def test_the_sums_decide_given_pages_without_their_marks(spark):
    for r in table(spark, "pages").collect():
        bare = re.sub(r"</?(article|main)\b[^>]*>", "<div>", r.html)
        assert h.main_text(bare) == h.main_text(r.html)


LINKS = "<p><a href=/>link</a></p>" * 4
NEWS = f"<article><p>{BODY}</p><p>{BODY}</p><p>{BODY}</p>"


@pytest.mark.parametrize("page, want", [
    (f"<h1>Title</h1>{LINKS}<p>{BODY}</p>", f"Title\n\n{BODY}"),                      # a headline before links
    (f"<h1><a href=/>Site</a></h1>{LINKS}<p>{BODY}</p>", BODY),                       # a linked one is no headline
    (f"{NEWS}{LINKS}<p>End.</p></article>", "\n\n".join([BODY] * 3 + ["link"] * 4 + ["End."])),
    (f"{NEWS}</article>{CARD}", "\n\n".join([BODY] * 3 + ["Other story", "A teaser."])),  # one run of marked lines
    (f"{NEWS}</article><p>between</p>{CARD}", "\n\n".join([BODY] * 3)),                # a card of its own falls short
    (f"<p>{BODY}</p>{NEWS}</article>", "\n\n".join([BODY] * 3)),                       # a quarter of its length
    (f"<p>{BODY * 4}</p><article>{f'<p>{BODY}</p>' * 6}</article>", "\n\n".join([BODY * 4] + [BODY] * 6)),
])
def test_the_mark_is_a_weight(page, want):
    assert h.main_text(page) == want
