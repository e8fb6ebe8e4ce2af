"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with the path of block tags (and links) from the root
to it; a block's neighbouring nodes on one path count as one. For each path its nodes' text lengths and punctuation marks are averaged. Along the
page the paths' averages are smoothed with a Gaussian, fused into one score (length times
the logarithm of punctuation), and averaged for each path again. A path through a link
counts a quarter; one through a menu, page header, footer, sidebar, form or the like (by
tag or role) counts nothing. Paths with a score above a share of the scores' standard
deviation hold the content: the blocks that have a node on such a path are the main text.

What the scores leave open is settled by structure. The core is the smallest element that
holds most of the content paths' characters, or the article around it, or else the
smallest around it with a main heading: its other blocks, such as lists and captions,
belong to the text, apart from lists of mere links. So do the
headings in the smallest element that holds all content. If the core is the whole body,
only paragraphs, items, cells and the like are added.

Elements whose class or id has a telling first or last word (adverts, notices, comments
and so on) are taken out before. Such a word never tells of a heading, and an element with
one stays if it holds the page's main heading or nearly all its text. If the word may as
well name a part of an article (UNSURE, or a last word), the element also stays in an
article if its path's score is a content path's, and elsewhere if it is a paragraph, table
or the like on a content path.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table

#: Element names by role in the page.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = set("script style textarea title noscript iframe template xmp noembed noframes".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = set("head script style noscript template iframe textarea title button select option input object svg canvas audio video map".split())
ASIDE = set("nav footer aside form dialog menu".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist".split())
WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promoted promotion banner "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars aside footer masthead topbar toolbar header share sharing social follow related recommended recommendations newsletter "
    "subscribe subscription signup login search form comment comments commentlist disqus reply replies respond discussion feedback widget widgets "
    "pagination pager skip copyright legal disclaimer".split()
)
UNSURE = set("notice notices alert related recommended recommendations copyright legal disclaimer form header menu search login discussion feedback reply replies respond response follow banner promotion subscription notification overlay aside".split())
COMMENTS = set("comment comments commentlist disqus reply replies respond discussion".split())
NEGATED = set("no not with without has have hide hides hidden".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
TEXTS = set("p pre blockquote table li dd td".split())
BODY = set(["", "html", "body"])
PARTS = HEADINGS | set("p ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address".split())
SMOOTH = [math.exp(-k * k) for k in (-2, -1, 0, 1, 2)]
SHARE = 1.2
MOST = 0.8

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|aria-label)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_MARKS = re.compile(r"[.,;:!?…。，；：！？]")
_SPACE = re.compile(r"\s+")


class Element:
    """An open tag. path numbers the root-to-leaf path of block tags, links and elements set
    aside; paths (shared by a page's elements) gives out those numbers."""

    __slots__ = ("tag", "parent", "out", "aside", "path", "depth", "link", "title", "chars", "word", "inside", "mark", "head")

    def __init__(self, tag, parent, out, paths, word=None, inside=False, aside=False):
        self.tag, self.parent, self.out, self.chars = tag, parent, out, 0
        self.word, self.inside, self.head = word, inside, False
        self.mark = self if word else parent.mark if parent else None  # the nearest element with a word of WORDS
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or bool(parent and parent.link)
        self.title = tag == "h1" or bool(parent and parent.title)
        self.aside = aside or bool(parent and parent.aside)
        self.path = parent.path if parent else 0
        if tag in BLOCKS or tag == "a" or aside:
            self.path = paths.setdefault((self.path, tag, aside), len(paths) + 1)

    def marks(self):
        """The elements around (and this one) with a word of WORDS."""
        e = self.mark
        while e is not None:
            yield e
            e = e.parent.mark


def left_out(tag: str, attributes: str) -> bool:
    """Whether an element is not shown, or only takes input."""
    if tag in LEFT_OUT:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def set_aside(tag: str, attributes: str, inside_article: bool) -> bool:
    """Whether an element's tag or role is that of a menu, footer, sidebar or the like."""
    if tag in ASIDE or tag == "header" and not inside_article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    return any(name.lower() == "role" and value.strip("\"'").lower() in ROLES for name, value in _NAMES.findall(attributes))


def told_by(tag: str, attributes: str, inside_article: bool) -> tuple[str, bool] | None:
    """The word of a class or id that may tell that the element is left out, and whether
    it is sure to."""
    if not attributes or tag in ("html", "body", "main") or tag in HEADINGS:
        return None
    unsure = None
    for name, value in _NAMES.findall(attributes):
        if name.lower() not in ("class", "id"):
            continue
        for each in value.strip("\"'").split():
            parts = [w.lower() for w in _SPLIT.findall(each)]
            if not parts:
                continue
            if tag == "article":
                if parts[0] in ("comment", "comments", "ad", "advert", "sponsored", "related", "promo"):
                    return parts[0], True
                continue
            if parts[0] in WORDS and not (inside_article and parts[0] == "header"):
                if parts[0] not in UNSURE:
                    return parts[0], True
                unsure = unsure or (parts[0], False)
            elif parts[-1] in WORDS and not NEGATED & set(parts) and not (inside_article and parts[-1] == "header"):
                unsure = unsure or (parts[-1], False)
    return unsure


def nodes(page: str) -> list[tuple[int, Element, str]]:
    """(block number, element, decoded text) of each text node that is not left out."""
    paths: dict[tuple, int] = {}
    here = Element("", None, False, paths)
    out: list[tuple[int, Element, str]] = []
    opened: Counter = Counter()  # open elements by tag
    block, at = 0, 0

    def text(upto: int) -> None:
        if upto > at and not here.out:
            out.append((block, here, entities.unescape(page[at:upto])))

    find = _TAG.search
    while (m := find(page, at)) is not None:
        text(m.start())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if opened[tag]:
                while here.tag != tag:
                    opened[here.tag] -= 1
                    here = here.parent
                opened[tag] -= 1
                here = here.parent
            block += tag in BLOCKS
            continue
        if tag in RAW:  # its content is no markup
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        block += tag in BLOCKS
        if tag == "br" and not here.out:
            out.append((block, here, " "))
        if tag in VOID:
            continue
        closes = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}.get(tag) or ({"p"} if tag in BLOCKS else None)
        if closes and any(opened[c] for c in closes):  # an open paragraph (item, cell) ends where the next block starts
            up = here
            while up.parent is not None and up.tag not in closes and (up.tag not in BLOCKS):
                up = up.parent
            if up.parent is not None and up.tag in closes:
                while here is not up.parent:
                    opened[here.tag] -= 1
                    here = here.parent
        if not (m[3] or m[6] or "").rstrip().endswith("/") or tag in BLOCKS or tag == "a":
            attributes = m[3] or m[6] or ""
            inside = opened["article"] + opened["main"] > 0
            here = Element(tag, here, here.out or left_out(tag, attributes), paths, told_by(tag, attributes, inside), inside, set_aside(tag, attributes, inside))
            if tag in ("h1", "main") and not here.out:
                for e in here.marks():
                    e.head = True
            opened[tag] += 1
    text(len(page))
    return out


def path_scores(found: list[tuple[int, Element, str]]) -> dict[int, float]:
    """The smoothed, fused score of each path."""
    sums: dict[int, list[float]] = {}
    order = []
    last = None
    for number, e, t in found:
        size = len(t.strip())
        if not size:
            continue
        s = sums.setdefault(e.path, [0, 0, 0, weight(e)])
        s[0] += size
        s[1] += len(_MARKS.findall(t))
        if (number, e.path) != last:  # inline markup doesn't part a block's text
            s[2] += 1
            order.append(e.path)
        last = number, e.path
    length = [sums[p][0] / sums[p][2] for p in order]
    marks = [sums[p][1] / sums[p][2] for p in order]
    out: dict[int, list[float]] = {}
    for i, p in enumerate(order):
        near = [(w, j) for w, j in zip(SMOOTH, range(i - 2, i + 3)) if 0 <= j < len(order)]
        total = sum(w for w, _ in near)
        fused = sum(w * length[j] for w, j in near) / total * math.log(2 + sum(w * marks[j] for w, j in near) / total)
        out.setdefault(p, []).append(fused)
    return {p: sums[p][3] * sum(v) / len(v) for p, v in out.items()}


def weight(e: Element) -> float:
    """How much the ratios of a path count, by what it leads through."""
    return 0.0 if e.aside else 0.25 if e.link else 1.0


def own_score(found: list[tuple[int, Element, str]]) -> float:
    """The score of nodes by themselves, as one path's."""
    parts = [(len(t.strip()), len(_MARKS.findall(t)), e.link) for _, e, t in found if t.strip()]
    if not parts:
        return 0.0
    fused = sum(p[0] for p in parts) / len(parts) * math.log(2 + sum(p[1] for p in parts) / len(parts))
    return fused * (0.25 if all(p[2] for p in parts) else 1)


def content_of(scores: dict[int, float]) -> tuple[set[int], float]:
    """The paths that hold the content (none with a score of zero), and the score that makes them."""
    if not scores:
        return set(), 0.0
    mean = sum(scores.values()) / len(scores)
    limit = min(SHARE * math.sqrt(sum((s - mean) ** 2 for s in scores.values()) / len(scores)), max(scores.values()))
    return {p for p, s in scores.items() if s >= limit and s}, limit


def without_told(found: list[tuple[int, Element, str]]) -> list[tuple[int, Element, str]]:
    """The nodes without those of elements whose class or id tells that they are no content."""
    told: dict[Element, list[tuple[int, Element, str]]] = {}
    for node in found:
        for e in node[1].marks():
            told.setdefault(e, []).append(node)
    if not told:
        return found
    size = lambda some: sum(len(t.strip()) for _, _, t in some)
    total = size([n for n in found if not n[1].aside])
    stays = {e for e, inner in told.items() if e.word[0] not in COMMENTS and (e.head or size(inner) > 0.8 * total)}
    left = lambda: [n for n in found if all(e in stays for e in n[1].marks())]
    content, limit = content_of(path_scores(left()))
    for e, inner in told.items():
        if e.word[1] or e in stays:
            continue
        if e.inside and own_score(inner) >= limit or e.tag in TEXTS and any(n[1].path in content for n in inner):
            stays.add(e)
    return left()


def holders(found: list[tuple[int, Element, str]], content: set[int]) -> tuple[Element, Element] | None:
    """The smallest element with most of the content paths' characters (or the article
    around it, or the smallest around it below the body with a main heading), and the
    smallest with all of them. None without content."""
    total = 0
    touched: set[Element] = set()
    for _, e, t in found:
        size = len(t.strip())
        if size and e.path in content:
            total += size
            e.chars += size
            up = e
            while up is not None and up not in touched:
                touched.add(up)
                up = up.parent
    if not total:
        return None
    for e in sorted(touched, key=lambda e: -e.depth):
        if e.parent is not None:
            e.parent.chars += e.chars
    deepest = lambda least: outside(max((e for e in touched if e.chars >= least), key=lambda e: e.depth))
    core, whole = deepest(MOST * total), deepest(total)
    around = [e for e in ancestors(core) if e.tag in ("article", "main")]
    titled = within(set(ancestors(core)), [e for _, e, _ in found if e.title and not e.aside])
    near = next((e for e in ancestors(core) if e in titled and e.tag not in BODY), core)
    named = next((e for e in around if e.tag == "article"), around[-1] if around else near)
    return named, named if whole.depth > named.depth else whole


def ancestors(e: Element | None) -> list[Element]:
    out = []
    while e is not None:
        out.append(e)
        e = e.parent
    return out


def outside(e: Element) -> Element:
    """The smallest element around e that may hold several paragraphs, or e."""
    while e.parent is not None and (e.tag not in BLOCKS or e.tag in PARTS):
        e = e.parent
    return e


def within(tops: set[Element], found: list[Element]) -> set[Element]:
    """Those of tops that an element of found lies in, and found with what lies between."""
    seen: set[Element] = set()
    for e in found:
        path = []
        while e is not None and e not in seen and e not in tops:
            path.append(e)
            e = e.parent
        if e is not None:
            seen.update(path)
            while e is not None and e in tops and e not in seen:
                seen.add(e)
                e = e.parent
    return seen


def block_of(e: Element) -> str:
    """The tag of the block that e is in."""
    while e.parent is not None and e.tag not in BLOCKS:
        e = e.parent
    return e.tag


def main_text(page: str | None) -> str:
    """The main text; empty for pages without text (null and empty ones included)."""
    found = without_told(nodes(page or ""))
    content, _ = content_of(path_scores(found))
    tops = holders(found, content)
    if tops is None:
        return ""
    core, whole = tops
    loose = core.tag in BODY
    in_core, in_whole = (within({top}, [e for _, e, _ in found]) for top in tops)
    blocks: dict[int, list[tuple[Element, str]]] = {}
    for number, e, t in found:
        if not e.aside or e.path in content:
            blocks.setdefault(number, []).append((e, t))
    out = []
    for parts in blocks.values():
        text = _SPACE.sub(" ", "".join(t for _, t in parts)).strip()
        words = [e for e, t in parts if t.strip()]
        if not text:
            continue
        if not any(e.path in content for e in words):
            tag = block_of(words[0])
            if all(e.link for e in words) and any(e.tag == "li" for e in ancestors(words[0])):
                continue
            if not (tag in HEADINGS and words[0] in in_whole or words[0] in in_core and (not loose or tag in PARTS)):
                continue
        out.append(text)
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def extracted(pages: pd.Series) -> pd.Series:
    return pages.map(main_text, na_action=None)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages, which needs page_id, url and
    html (other columns are ignored). A null html is empty and gives an empty text;
    damaged markup is read as far as it goes; all rows are returned."""
    out = pages.select("page_id", "url", extracted(F.coalesce("html", F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
