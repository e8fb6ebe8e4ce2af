"""The path scores decide what the main text is."""

import math
import random
import re
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from strataform.llm import html_extract

PAGES = [r or "" for r in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()]


class Article(HTMLParser):
    """The text of the article element, block for block."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("h1", "p"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("h1", "p"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def article(page):
    parser = Article()
    parser.feed(page)
    return "\n".join(t for t in (re.sub(r"\s+", " ", b).strip() for b in parser.blocks) if t)


def bare(page):
    """The page without its article tags and class names."""
    return re.sub(r' class="[^"]*"', "", re.sub(r"(</?)article\b", r"\1div", page))


def test_whole_articles():
    assert [html_extract.main_text(p) for p in PAGES] == [article(p) for p in PAGES]


def test_paths_suffice_without_article_tags_and_classes():
    right = sum(html_extract.main_text(bare(p)) == article(p) for p in PAGES)
    assert right >= 0.9 * len(PAGES)


@pytest.mark.parametrize("kind", ["random", "negative", "constant"])
def test_other_scores_give_other_texts(monkeypatch, kind):
    rng, real = random.Random(1), html_extract.path_scores
    value = {"random": lambda s: rng.random(), "negative": lambda s: -s, "constant": lambda s: 1.0}[kind]
    monkeypatch.setattr(html_extract, "path_scores", lambda found: {p: value(s) for p, s in real(found).items()})
    assert sum(html_extract.main_text(p) == article(p) for p in PAGES) < 0.1 * len(PAGES)


def path_of(e, page_blocks=html_extract.BLOCKS):
    """The path from the root to e, spelt out; ! marks an element that is set aside."""
    tags = []
    while e.parent is not None:
        own = e.aside and not e.parent.aside or e.tag in ("nav", "footer", "aside", "form", "dialog", "menu")
        if e.tag in page_blocks or e.tag == "a" or own:
            tags.append(e.tag + "!" * own)
        e = e.parent
    return "/".join(reversed(tags))


def plain_scores(found):
    """Aggregation, smoothing and fusion by their definitions, path for path."""
    shown = []
    for number, e, t in found:
        if t.strip():
            path = path_of(e)
            if shown and shown[-1][:2] == (number, path):
                shown[-1][2].append(t)
            else:
                shown.append((number, path, [t]))
    shown = [(p, ts) for _, p, ts in shown]
    mean = lambda path, f: sum(f(t) for p, t in shown if p == path) / sum(p == path for p, _ in shown)
    lengths = [mean(p, lambda ts: sum(len(t.strip()) for t in ts)) for p, _ in shown]
    marks = [mean(p, lambda ts: sum(c in ".,;:!?\u2026\u3002\uff0c\uff1b\uff1a\uff01\uff1f" for t in ts for c in t)) for p, _ in shown]

    def smooth(values, at):
        pull = {k: math.exp(-((k - at) ** 2)) for k in range(len(values)) if abs(k - at) <= 2}
        return sum(w * values[k] for k, w in pull.items()) / sum(pull.values())

    out = {}
    for path in {p for p, _ in shown}:
        own = [smooth(lengths, k) * math.log(2 + smooth(marks, k)) for k, (p, _) in enumerate(shown) if p == path]
        parts = path.split("/")
        out[path] = sum(own) / len(own) * (0 if any(x.endswith("!") for x in parts) else 0.25 if "a" in parts else 1)
    return out


def test_scores_and_threshold_against_plain_ones():
    extra = ["<p>One, two; <a href=x>three</a>.<p>Four!<ul><li><a>x</a><li>y</ul>", "<div role=navigation>a, b</div><h2>T</h2><pre>x = 1;</pre>", "<b>no block</b>"]
    for page in [*PAGES[:60], *map(bare, PAGES[:60]), *extra]:
        found = html_extract.nodes(page)
        name = {e.path: path_of(e) for _, e, _ in found}
        assert len(set(name.values())) == len(name)
        scores, want = {name[p]: s for p, s in html_extract.path_scores(found).items()}, plain_scores(found)
        assert scores.keys() == want.keys() and all(abs(scores[p] - want[p]) < 1e-9 for p in want)
        values = list(want.values())
        mean = sum(values) / len(values)
        limit = min(1.2 * math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)), max(values))
        assert {name[p] for p in html_extract.content_of(html_extract.path_scores(found))[0]} == {p for p, v in want.items() if v >= limit - 1e-9 and v > 0}


def test_content_outside_the_core_is_kept_and_low_parts_inside():
    text = "A paragraph, with its marks; it is no short one. " * 20
    page = f"<body><div>short</div><div><h1>Head</h1><div><p>{text * 9}</p><ul><li>item<li><a href=x>item two</a> more</ul></div><div><p>{text}</p></div></div><ul><li><a href=x>menu</a></ul></body>"
    assert html_extract.main_text(page).split("\n") == ["Head", (text * 9).strip(), "item", "item two more", text.strip()]


@pytest.mark.parametrize("page", ["<div>" * 60000 + "Text, at last.", "<b>text <br>" * 40000, "<b>" * 30000 + "<p>a, b</p></i>" * 30000, '<div class="ad">x ' * 3000, "<ul><li>" * 30000 + "<a href=x>y</a>"])
def test_deep_pages_end(page):
    assert isinstance(html_extract.main_text(page), str)
