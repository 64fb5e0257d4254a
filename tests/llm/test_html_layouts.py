"""Articles in layouts written by hand, none of them made by the training generator: every block, headings counted."""

import pytest

from socialspark.llm import html_extract

TITLE = "River towns rebuild after the spring floods"
PARAGRAPHS = [
    "The council met on Tuesday evening to decide how the old bridge should be repaired before winter comes, and most members agreed that stone is better than steel.",
    "Residents who lost their homes in March will move into new houses near the school, said the mayor, who has asked for help from the capital twice already.",
    "Work begins in June. It will take two years and cost less than was first expected, because much of the timber was saved.",
]
H1 = f"<h1>{TITLE}</h1>"
PS = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
BR = "<br><br>".join(PARAGRAPHS)
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/contact">Contact</a></li></ul></nav>'
FOOT = "<footer><p>Copyright 2024 Valley Press. All rights reserved.</p></footer>"
SIDE = '<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/a">Market prices rise</a></li><li><a href="/b">School wins cup</a></li></ul></aside>'


def page(body, attrs=""):
    return f"<!DOCTYPE html><html><head><title>{TITLE} - Valley Press</title></head><body{attrs}>{NAV}{body}{SIDE}{FOOT}</body></html>"


LAYOUTS = {
    "article": page(f"<article>{H1}{PS}</article>"),
    "main": page(f"<main>{H1}{PS}</main>"),
    "section": page(f"<section>{H1}{PS}</section>"),
    "section with a name": page(f'<section class="story-body">{H1}{PS}</section>'),
    "nameless div": page(f"<div>{H1}{PS}</div>"),
    "nested nameless divs": page(f"<div><div><div>{H1}{PS}</div></div></div>"),
    "machine-made names": page(f'<div class="css-1q2w3e"><div class="sc-bdVaJa kXfQzP">{H1}{PS}</div></div>'),
    "line breaks": page(f'<div class="content">{H1}{BR}</div>'),
    "line breaks without a name": page(f"<div>{H1}{BR}</div>"),
    "states on the article": page(f'<div class="post comments-open social-share">{H1}{PS}</div>'),
    "states on the body": page(f'<div class="content">{H1}{PS}</div>', ' class="has-sidebar cookie-bar"'),
    "states on both": page(f'<article class="hentry has-post-thumbnail comments-closed">{H1}{PS}</article>', ' class="single nav-open footer-fixed"'),
    "linked paragraphs": page(f"<article>{H1}{''.join(f'<p><a href=/x>{p}</a></p>' for p in PARAGRAPHS)}</article>"),
    "no container": page(f"{H1}{PS}"),
    "bare page": f"<body>{H1}{PS}</body>",
    "paragraphs alone": PS,
    "unclosed paragraphs": page(f"<div id=story>{H1}{''.join(f'<p>{p}' for p in PARAGRAPHS)}</div>"),
    "table layout": f"<html><body><table><tr><td>{NAV}</td></tr><tr><td>{H1}{PS}</td></tr><tr><td>{FOOT}</td></tr></table></body></html>",
    "role attribute": page(f'<div role="main">{H1}{PS}</div>'),
    "header inside the article": page(f"<article><header>{H1}</header>{PS}</article>"),
    "text in divs": page(f"<div>{H1}{''.join(f'<div>{p}</div>' for p in PARAGRAPHS)}</div>"),
    "quote and list": page(f"<article>{H1}<p>{PARAGRAPHS[0]}</p><blockquote>{PARAGRAPHS[1]}</blockquote><ul><li>{PARAGRAPHS[2]}</li></ul></article>"),
    "two sections": page(f"<div class=page><section>{H1}<p>{PARAGRAPHS[0]}</p></section><section><p>{PARAGRAPHS[1]}</p><p>{PARAGRAPHS[2]}</p></section></div>"),
    "text alone": " ".join(PARAGRAPHS),
}


@pytest.fixture(scope="module")
def texts():
    return dict(zip(LAYOUTS, html_extract.main_text(list(LAYOUTS.values()), html_extract.trained()), strict=True))


@pytest.mark.parametrize("name", LAYOUTS)
def test_every_block_of_the_article(texts, name):
    wanted = [*([TITLE] if H1 in LAYOUTS[name] else []), *PARAGRAPHS]
    assert [w for w in wanted if w not in texts[name]] == []


@pytest.mark.parametrize("name", [n for n in LAYOUTS if NAV in LAYOUTS[n]])
def test_nothing_around_the_article(texts, name):
    assert [w for w in ("Contact", "All rights reserved", "Market prices rise") if w in texts[name]] == []


def test_a_page_without_text_stays_empty():
    assert html_extract.main_text(["", "<html><body></body></html>", f"<body>{NAV}</body>"], html_extract.trained()) == ["", "", ""]
