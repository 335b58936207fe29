"""The extraction of main text against pages written with their text, and how its verdicts come about."""

import os
import random

import pyarrow.parquet as pq
import pytest

from vicinal.llm import html_text

SF = "/root/testdata/sf0.01"
WORDS = "river stone winter market garden letter morning silver window bridge".split()


def prose(draw, low, high):
    return " ".join(draw.choices(WORDS, k=draw.randint(low, high))).capitalize() + "."


def links(draw, n, words=2):
    return "".join(f"<li><a href='/{k}'>{' '.join(draw.choices(WORDS, k=draw.randint(1, words)))}</a></li>" for k in range(n))


def clutter(draw):
    """Parts of a page that are no main text."""
    kinds = [
        lambda: f"<nav><ul>{links(draw, 5)}</ul></nav>",
        lambda: f"<ul class='top-links'>{links(draw, 4)}</ul>",
        lambda: f"<div class='{draw.choice(['ad', 'ad-banner', 'sponsored', 'adBox'])}'>{prose(draw, 4, 30)}</div>",
        lambda: f"<div id='cookie-notice'><p>{prose(draw, 5, 40)}</p><button>OK</button></div>",
        lambda: f"<aside><h3>{prose(draw, 1, 3)}</h3><p>{prose(draw, 10, 60)}</p></aside>",
        lambda: f"<div class='sidebar left'><p>{prose(draw, 3, 50)}</p><ul>{links(draw, 3)}</ul></div>",
        lambda: f"<form><label>Name</label><input name=n><div>{prose(draw, 1, 4)}</div><div>Send</div></form>",
        lambda: f"<script>var a = '<p>{prose(draw, 2, 5)}</p>';</script><style>p {{}}</style><!-- {prose(draw, 2, 4)} -->",
    ]
    return draw.choice(kinds)()


def page(draw):
    """A page and its main text."""
    title, paragraphs = prose(draw, 1, 9), [prose(draw, *draw.choice([(1, 4), (8, 20), (30, 90), (200, 400)])) for _ in range(draw.randint(1, 6))]
    body, text = [], []
    for p in paragraphs:
        kind = draw.randrange(5)
        if kind == 0:
            p += " See <a href='/x'>" + draw.choice(WORDS) + "</a> &amp; more words after it."
        body.append({1: f"<p>{p}<br>{p}</p>", 2: f"<div><div><p>{p}</div></div>", 3: f"<blockquote>{p}</blockquote>"}.get(kind, f"<p>{p}</p>"))
        plain = p.replace("<a href='/x'>", "").replace("</a>", "").replace("&amp;", "&")
        text.append(f"{plain} {plain}" if kind == 1 else plain)
    inside = f"<h1>{title}</h1>{''.join(body)}"
    wrap = draw.randrange(6)
    middle = {0: f"<article>{inside}</article>", 1: f"<main><article>{inside}</article></main>", 2: f"<div class='post'>{inside}</div>", 3: f"<div role='main'>{inside}</div>", 4: f"<form action='/'><article>{inside}</article></form>"}.get(wrap, inside)
    before, after = ("".join(clutter(draw) for _ in range(draw.randint(0, 3))) for _ in range(2))
    after += draw.choice(["", f"<section class='comments'><h2>Comments</h2><p>{prose(draw, 3, 90)}</p></section>", f"<footer>&copy; {prose(draw, 1, 12)}</footer>"])
    return f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{before}{middle}{after}</body></html>", "\n".join([title, *text])


def test_pages_give_their_main_text():
    draw = random.Random(11)
    wrong = [(p, want, got) for p, want in (page(draw) for _ in range(400)) if (got := html_text.main_text(p)) != want]
    assert not wrong, wrong[0]


def test_articles_without_article_elements():
    long = " ".join(["word"] * 1000)
    assert html_text.main_text(f"<body><h1>Title</h1><p>{long}</p></body>") == f"Title\n{long}"
    assert html_text.main_text("<div class='post'><p>Short one.</p><p>Another short.</p></div>") == "Short one.\nAnother short."
    related = "<article><h1>T</h1><p>One two three.</p><section class='related-work'><h2>Related work</h2><p>A b.</p><p>" + "c " * 60 + "</p></section></article>"
    assert html_text.main_text(related).split("\n")[:4] == ["T", "One two three.", "Related work", "A b."]
    assert html_text.main_text(f"<div id='content-header'><h1>The title</h1></div><p>{long}</p>") == f"The title\n{long}"
    assert html_text.main_text("<div class='comment'>word word</div><ul><li><a href=x>Home</a></ul>") == ""


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_densities_decide_most_blocks():
    tree, decided, blocks = html_text.default_tree(), 0, 0
    for html in pq.read_table(f"{SF}/pages.parquet")["html"].to_pylist():
        for x in html_text.block_features(html_text.text_blocks(html or "")):
            blocks += 1
            decided += tree.classify(x) == tree.classify((*x[:6], 0.0, 0.0))
    assert html_text.FEATURES[tree.feature] == "links" and decided > 0.8 * blocks > 0


def test_table_of_pages(spark):
    rows = [(1, "u", "<article><p>a</p></article>", "t"), (1, "u", "<article><p>a</p></article>", "t"), (2, None, None, None), (None, "v", "", "x"), (3, "w", "<p>" + "é " * 200_000 + "</p>", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in html_text.extract_pages(frame).collect()), key=str)
    assert [g for g in got if g[0] != 3] == [(0, "v", "", 0), (1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0)]
    assert next(g for g in got if g[0] == 3)[3] == 399_999
    assert html_text.extract_pages(frame.where("false")).count() == 0
