"""Main text of pages whose classes and ids only look like those of menus or notices."""

import pytest

from strataform.llm import html_extract

BODY = "<h1>Title here</h1><p>First paragraph, which is long enough to be content, as it seems.</p>{}<p>Last paragraph, which is long as well, and has marks; it ends here.</p>"
PAGE = '<html><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies, many of them.</div>{}<div class="site-footer">All of it, by me.</div></body></html>'
KEPT = ["Title here", "First paragraph, which is long enough to be content, as it seems.", "Last paragraph, which is long as well, and has marks; it ends here."]


@pytest.mark.parametrize("wrapper", ['class="content no-sidebar"', 'class="layout-with-sidebar"', 'id="page-header-fixed"', 'class="sidebar-layout"', 'class="sidebar"'])
def test_wrappers_stay(wrapper):
    page = PAGE.format(f"<div {wrapper}>{BODY.format('')}</div>")
    assert html_extract.main_text(page).split("\n") == KEPT


@pytest.mark.parametrize("part,text", [
    ('<h2 id="related-work">Related work</h2>', "Related work"),
    ('<section id="copyright-history"><p>The history of copyright is long, and starts with printing.</p></section>', "The history of copyright is long, and starts with printing."),
    ('<p class="notice">Take notice of this paragraph, which is part of the text.</p>', "Take notice of this paragraph, which is part of the text."),
    ('<pre class="form">let form = read(input); send(form, now);</pre>', "let form = read(input); send(form, now);"),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold, for now, in this text.</p>", "Let x=2 hold, for now, in this text."),
])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_parts_of_the_article_stay(part, text, tag):
    page = PAGE.format(f"<{tag}>{BODY.format(part)}</{tag}>")
    assert html_extract.main_text(page).split("\n") == [*KEPT[:2], text, KEPT[2]]


@pytest.mark.parametrize("part", ['<div class="ad">Buy this now, it is really cheap.</div>', '<div class="share-buttons">Share it, now.</div>', '<div id="comments"><p>I think, therefore I comment on this, at length.</p></div>', '<section class="newsletter"><p>Get our letter, every week, for free.</p></section>'])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_menus_adverts_and_comments_go(part, tag):
    page = PAGE.format(f"<{tag}>{BODY.format(part)}</{tag}>")
    assert html_extract.main_text(page).split("\n") == KEPT
