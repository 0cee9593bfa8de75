"""The block labeller on layouts it has not seen, and on edge pages."""

from __future__ import annotations

import time

import numpy as np
import pytest

from skytally.llm import html_text as H


def test_states_depend_on_what_came_before_only():
    rng = np.random.default_rng(0)
    h = H.HIDDEN
    x, mask = rng.normal(size=(4, 2, 3)), np.ones((4, 2))
    wx, wh, b = rng.normal(size=(3, 4 * h)), rng.normal(size=(h, 4 * h)), rng.normal(size=4 * h)
    once = H._lstm(x, wx, wh, b, mask)
    assert once.shape == (4, 2, h)
    y = x.copy()
    y[3] += 1
    again = H._lstm(y, wx, wh, b, mask)
    assert np.allclose(again[:3], once[:3]) and not np.allclose(again[3], once[3])


def test_unseen_layouts():
    model = H.fit()
    pages = [H.blocks(p) for p in H.layouts(120, seed=987)]
    right = total = 0
    for page, p in zip(pages, H.predict(model, pages), strict=True):
        right += sum((q >= 0.5) == bool(b.marked) for b, q in zip(page, p, strict=True))
        total += len(page)
    assert right / total > 0.98


ARTICLE = "".join(f"<p>Sentence number {i} of the story, with a comma, says something about rivers &amp; hills.</p>" for i in range(6))
PAGE = f"<html><head><title>T</title><script>var p = '<p>no</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav><article><h1>Head  line</h1>{ARTICLE}</article><footer><p>Copyright 2024 All rights reserved</p></footer></body></html>"


def test_article_without_its_surroundings():
    text = H.main_texts(H.fit(), [PAGE])[0]
    parts = text.split("\n\n")
    assert parts[0] == "Head line" and len(parts) == 7
    assert parts[1] == "Sentence number 0 of the story, with a comma, says something about rivers & hills."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- never closed", "<script>var x", "</div></p>", "<a><b><i>", "<div " * 3000])
def test_broken_pages_do_not_fail(page):
    assert isinstance(H.main_texts(H.fit(), [page])[0], str)


def text_of(html: str) -> list[str]:
    return [b.text for b in H.blocks(html)]


def test_tags_with_stray_quotes_leave_no_markup():
    assert text_of('<p title="it"s">two</p><p a=\'x>three</p>') == ["two", "three"]
    assert text_of('<p data-x="a > b">one</p><p title = "c > d">two</p>') == ["one", "two"]
    assert text_of("5 < 6 and a <b and c") == ["5 < 6 and a <b and c"]
    assert text_of("<!-- a > b --><!DOCTYPE html><p>x<?php y ?>z</p>") == ["xz"]


def test_references_are_decoded_in_each_piece_of_text():
    assert text_of("<p>R&<b>amp;</b>D &lt;b&gt; caf&eacute;</p>") == ["R&amp;D <b> café"]


def test_all_tokens_of_attributes_and_links_at_any_depth_count():
    long = " ".join(f"plain{chr(97 + i)}" for i in range(20))
    a, b = (H.blocks(f'<div class="{long}{more}">x</div>')[0].path for more in ("", " sidebar"))
    assert a | 1 << H.PATH_BUCKETS["sidebar"] == b
    assert H.blocks("<a><b><i><em><u>deep</u></em></i></b></a>")[0].linked == 4


@pytest.mark.parametrize("piece", ["a<b ", "<b x='", "<div>", "<div>x", "</p>", "<svg/>", "<!--", "<b></p>", '<p a="', "<td><b>"])
def test_hostile_pages_take_linear_time(piece):
    began = time.time()
    H.blocks(piece * 200_000)
    assert time.time() - began < 20


def test_a_long_page_in_pieces_equals_the_whole():
    model = H.fit()
    page = H.blocks(PAGE.replace(ARTICLE, ARTICLE * 300))
    assert len(page) > 1500
    x = H.vectors(page)
    assert np.allclose(np.concatenate([H.vectors(page, a, a + 500, sum(len(b.text) for b in page[:a]), sum(len(b.text) for b in page)) for a in range(0, len(page), 500)]), x)
    whole = H.predict(model, [page])[0]
    step, H.STEP = H.STEP, 400
    try:
        assert np.allclose(H._long(model, page), whole, atol=1e-4)
    finally:
        H.STEP = step


#: Pages of other hands and times than the layouts of the training, and their main texts.
BY_HAND = [
    (
        """<HTML><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD CLASS=menu><A HREF=1.htm>Index</A><BR><A HREF=2.htm>Guestbook</A></TD>
        <TD><H2>My trip to the lake</H2><P>We left early in the morning, and the road was empty until the second bridge.
        <P>The lake itself was frozen &amp; quiet. Nobody else had come this far, so we stayed for the whole afternoon.</TD></TR></TABLE>
        <div class=footer>Best viewed at 800x600. Copyright 1998.</div></BODY></HTML>""",
        "My trip to the lake\n\nWe left early in the morning, and the road was empty until the second bridge.\n\nThe lake itself was frozen & quiet. Nobody else had come this far, so we stayed for the whole afternoon.",
    ),
    (
        """<!doctype html><body><header class="site-header"><a href="/">The Daily</a><nav><a href="/w">World</a> <a href="/s">Sport</a></nav></header>
        <div class="cookie-banner"><p>We use cookies to improve your experience.</p><button>Accept</button></div>
        <main><article><h1>Council votes for a new library</h1><p>The council voted on Tuesday to build a <a href="/lib">new library</a> beside the station, after years of debate.</p>
        <div class="ad">Sponsored: buy two, get one free</div><p>Work is to begin in spring, and the doors should open two years later, the mayor said.</p></article></main>
        <section class="comments"><h3>2 comments</h3><p>About time!</p><p>Who pays for it?</p></section><footer><p>All rights reserved. Imprint</p></footer></body>""",
        "Council votes for a new library\n\nThe council voted on Tuesday to build a new library beside the station, after years of debate.\n\nWork is to begin in spring, and the doors should open two years later, the mayor said.",
    ),
    (
        """<body><div id="wrapper"><div id="sidebar"><h4>Archives</h4><ul><li><a href="/1">May</a></li><li><a href="/2">June</a></li></ul></div>
        <div class="post"><h2>How to sharpen a chisel</h2><p>Start with a coarse stone, and keep the bevel flat on its surface at all times.</p>
        <p>Then move to a finer stone, and finish on leather. A sharp edge takes hair off the arm without any pressure.</p></div>
        <div class="share"><a href="#">Share</a> <a href="#">Tweet</a></div></div></body>""",
        "How to sharpen a chisel\n\nStart with a coarse stone, and keep the bevel flat on its surface at all times.\n\nThen move to a finer stone, and finish on leather. A sharp edge takes hair off the arm without any pressure.",
    ),
]


@pytest.mark.parametrize("page,want", BY_HAND)
def test_pages_written_by_hand(page, want):
    assert H.main_texts(H.fit(), [page])[0] == want


def test_columns_and_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (3, "v", "<p>" + "long words here. " * 50_000 + "</p>", "x")]
    out = H.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")).collect()
    assert len(out) == 4 and all(r["_in_main_text"] == "x" for r in out)
    assert [r.main_text for r in out if r.page_id is None] == [""]
    assert len({r.main_text for r in out if r.page_id == 1}) == 1
    assert H.extract(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_raw_elements_never_end_themselves():
    assert text_of("<p>a</p><script src=https://x.org/lib/>var tracker=1;</script><p>b</p>") == ["a", "b"]
    assert text_of("<style media=all/>p{color:red}</style><p>b</p>") == ["b"]
    assert text_of("<script/>var x;</script ><p>b</p><style></style x=y>c") == ["b", "c"]
    assert text_of("<p>a<svg viewBox=/0/><p>no</p></svg>b<svg/>c</p>") == ["abc"]
    assert text_of("<object data=x><p>instead</p></object>") == ["instead"]


def test_comments_end_where_the_standard_says():
    assert text_of("<p>a</p><!--><p>b</p>") == ["a", "b"]
    assert text_of("<p>a</p><!---><p>b</p>") == ["a", "b"]
    assert text_of("<!-- x --!><p>b</p><!-- y -- > <p>c</p> --><p>d</p>") == ["b", "d"]


def test_a_slash_in_an_unquoted_value_is_part_of_it():
    (block,) = H.blocks("<p><a href=/x/>text</a> more</p>")
    assert (block.text, block.linked) == ("text more", 4)
    (block,) = H.blocks("<p><a href=/x/>one</a> and <a href='/y'/>two</a> more</p>")
    assert block.linked == 6


def test_no_byte_of_scripts_gets_out_and_no_paragraph_is_lost():
    import random

    rng = random.Random(17)
    opens = ["<script>", "<script src=/a/b/>", "<script async/>", '<script src="x">', "<SCRIPT type=text/x>", "<style media=all/>", "<style>", "<!--", "<noscript>", "<template id=a/>"]
    for _ in range(400):
        page, kept = [], []
        for i in range(rng.randint(1, 12)):
            if rng.random() < 0.5:
                kept.append(f"kept{i}")
                page.append(rng.choice(("<p>{}</p>", "<div class=/x/>{}</div>", "<li>{}", "<p title='a>b'>{}</p>", "<h2 id=a/>{}</h2>")).format(kept[-1]))
            else:
                start = rng.choice(opens)
                name = start[1:].split()[0].rstrip(">/").lower()
                inside = "".join(rng.choice(("SECRET", " = '<p>SECRET</p>';", "</div>", "<b>", "a < b", "--", "/>", "</ script>")) for _ in range(rng.randint(0, 5)))
                end = rng.choice(("-->", "--!>")) if start == "<!--" else rng.choice((f"</{name}>", f"</{name} >", f"</{name.upper()}\n x>"))
                page.append(start + (inside.replace(">", "") if start == "<!--" else inside) + end)
        assert "".join(text_of("".join(page))) == "".join(kept), page
