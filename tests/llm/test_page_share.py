"""Main text of pages in which one element holds most of it."""

from strataform.llm import html_extract


def test_one_long_paragraph_does_not_lose_the_others():
    long, one, two = ("Words, and more of them. " * n for n in (360, 40, 40))
    page = f"<html><body><div><h1>Head</h1><div><p>{long}</p></div><div><p>{one}</p></div><div><p>{two}</p></div></div></body></html>"
    assert html_extract.main_text(page).split("\n") == ["Head", long.strip(), one.strip(), two.strip()]


def test_one_long_listing_does_not_lose_the_others():
    lines, text = "let a = b; c, d. " * 500, "A paragraph, with its marks; it is no short one. " * 20
    page = f"<html><body><div><div><p>{text}</p></div><div><pre>{lines}</pre></div><div><p>{text}</p></div></div></body></html>"
    assert html_extract.main_text(page).split("\n") == [text.strip(), lines.strip(), text.strip()]
