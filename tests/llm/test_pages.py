import base64
import gzip
import hashlib
import io

import pytest

from strataform.llm import html_extract, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site name</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies, and many of them, on this site.</div><div class="ad">Buy now, it is cheap.</div>
ARTICLE<aside>Side story, with some length to it, really.</aside><section id="comments"><p>I think, therefore I comment.</p></section>
<form><label>Name</label><input></form><footer>&copy; me &middot; all</footer></body></html>"""


def test_article_only():
    article = "<article><h1>A &amp; B</h1><p>First  paragraph,\n with <b>bold</b> text.<p>Ti.</p><div><p>Third one, &eacute;t&#233;; longer than the others, it seems.</p></div></article>"
    want = "A & B\nFirst paragraph, with bold text.\nTi.\nThird one, été; longer than the others, it seems."
    assert html_extract.main_text(PAGE.replace("ARTICLE", article)) == want
    plain = article.replace("article>", "div>")
    assert html_extract.main_text(PAGE.replace("ARTICLE", plain)) == want
    broken = "<article><h1>Head</h1><p><b>One, two.<br><p>Three, four.</p></article>"
    assert html_extract.main_text(PAGE.replace("ARTICLE", broken)) == "Head\nOne, two.\nThree, four."
    cut = PAGE[: PAGE.index("ARTICLE")] + article[:60] + "<di"
    assert html_extract.main_text(cut).startswith("A & B\nFirst")


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- x", "<script>1", "</p></p>", "<a title=\"x>y", "<nav>only menu</nav>"])
def test_odd_pages_do_not_crash(page):
    assert isinstance(html_extract.main_text(page), str)


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<p>Hello, é.</p>", 9), (1, "u", "<p>Hello, é.</p>", 9), (None, None, None, 9), (3, "u", "<p>" + "word, " * 90000 + "</p>", 9)], "page_id long, url string, html string, text long")
    rows = sorted(((r.page_id or 0, r.text, r.n_chars) for r in html_extract.extract(pages).collect()))
    assert rows[0] == (0, "", 0) and rows[1] == rows[2] == (1, "Hello, é.", 9) and rows[3][2] == 6 * 90000 - 1
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_round_trip(spark):
    rows = [(k, f"http://x/{k % 7} a\r\n%41", t, "clash") for k, t in enumerate([None, "", "<p>a</p>", "é" * 70000, "x", "<p>a</p>", "é" * 70000, "\r\n\r\n"])] + [(2, None, "<p>a</p>", "c"), (None, "u", "x", "c"), (None, "u", "alone", "c"), (44, "http://x/\u00a0", "z", "c"), (45, "\u2003", "y", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=repr)
    want = []
    for k, url, t, _ in rows:
        data = (t or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (t or "") and r[0] is not None]
        first = min(same, default=None)
        again = first is not None and k != first
        want.append((k, url, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_reader_frames_and_verifies():
    whole = b"".join(warc.record(k, "http://x", bytes([97 + k]) * (k * 70000)) for k in range(4))
    back = list(warc.records(io.BytesIO(whole), keep_payload=True))
    assert [r.payload for r in back] == [bytes([97 + k]) * (k * 70000) for k in range(4)]
    one = gzip.decompress(warc.record(1, None, b"payload"))
    for bad in (one.replace(b"payload", b"Payload"), one[:-2], one + b"x", one.replace(b"WARC/1.1", b"warc")):
        with pytest.raises(warc.DamagedArchive):
            list(warc.records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(warc.DamagedArchive):
        list(warc.records(io.BytesIO(whole[:-9])))


def test_archives_roll(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>" * 400) for k in range(40)], "page_id long, url string, html string")
    files = warc.write_archives(pages, str(tmp_path / "w"), most=400)
    assert files.count() > 4 and sum(r.n_records for r in files.collect()) == 40
    assert sorted(r.page_id for r in warc.read_archives(files).collect()) == list(range(40))
