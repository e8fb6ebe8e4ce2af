import io
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataform.llm import html_extract, packing, simhash, suffix_dedup, token_output, warc

letters = st.binary(max_size=120) | st.lists(st.sampled_from(b"ab\0"), max_size=120).map(bytes)


@settings(max_examples=150, deadline=None)
@given(letters.filter(bool))
def test_suffix_order(text):
    assert suffix_dedup.suffix_array(text, len(text) + 1).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(letters.filter(bool), min_size=1, max_size=5), st.integers(1, 12))
def test_windows(parts, match):
    seen = Counter(p[i : i + match] for p in parts for i in range(len(p) - match + 1))
    for p, marks in zip(parts, suffix_dedup.repeated_windows(parts, match)):
        assert marks.tolist() == [seen[p[i : i + match]] > 1 for i in range(len(p) - match + 1)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**62), 2**62), st.none() | st.text(max_size=40), st.binary(max_size=300), st.none() | st.integers(0, 99)), max_size=5))
def test_records(rows):
    stream = io.BytesIO(b"".join(warc.record(*r) for r in rows))
    back = list(warc.records(stream, keep_payload=True))
    assert [(warc.page_id(r.headers["warc-record-id"]), r.payload_bytes, warc.page_id(r.headers.get("warc-refers-to"))) for r in back] == [(i, len(p), f) for i, _, p, f in rows]
    assert all(r.payload == p for r, (_, _, p, f) in zip(back, rows) if f is None)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/apdivulcomentrscl=\"'&;! \n-é", max_size=200))
def test_pages_never_fail(page):
    text = html_extract.main_text(page)
    assert text == text.strip() and "\n\n" not in text


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 130), max_size=60))
def test_packing_keeps_every_id(sizes):
    bins = packing.SumOfSquares(50)
    for k, n in enumerate(sizes):
        bins.add(k, np.arange(n, dtype="<u2"))
    windows = bins.taken() + bins.close()
    parts = sorted((k, start, ids.tolist()) for w in windows for k, start, ids, _ in w)
    got = {}
    for k, start, ids in parts:
        assert start == len(got.setdefault(k, []))
        got[k] += ids
    assert got == {k: list(range(n)) for k, n in enumerate(sizes)}
    assert all(sum(len(p[2]) for p in w) <= 50 for w in windows) and sum(sum(len(p[2]) for p in w) < 50 for w in windows) <= 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=30), st.integers(0, 40))
def test_least_room(rooms, wanted):
    tree = token_output.Capacities(40)
    for r in rooms:
        tree.change(r, 1)
    assert tree.least(wanted) == min((r for r in rooms if r >= wanted), default=-1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=6), st.lists(st.tuples(st.integers(0, 5), st.sets(st.integers(0, 63), max_size=4)), max_size=200))
def test_links_connect_what_is_close(centres, changes):
    prints = np.unique(np.array([centres[c % len(centres)] ^ sum(1 << b for b in bits) for c, bits in changes] + centres, np.uint64))
    star = simhash.spanning(simhash.vp_links(prints, prints))
    root = dict(zip(star[:, 0].tolist(), star[:, 1].tolist()))
    names = prints.tolist()
    label = {p: p for p in names}
    changed = True
    while changed:
        changed = False
        for p in names:
            low = min(label[q] for q in names if (p ^ q).bit_count() <= 3)
            for q in names:
                if (p ^ q).bit_count() <= 3 and label[q] != low:
                    label[q], changed = low, True
    assert {p: root.get(p, p) for p in names} == label
