"""Marks of a page are evidence; windows over the lines' scores decide."""

import pytest

from trackloom.llm import htmltext

text = htmltext.main_text
PARA = ["First long paragraph of the article, which goes on for a good while to fill the window.", "Second paragraph, about as long as the first one, with some more words in it to be safe.", "Third and last paragraph of this article, which again is of the usual length of such."]
BODY = "".join(f"<p>{p}</p>" for p in PARA)
ALL = "\n".join(PARA)


@pytest.mark.parametrize("mark", ["notice", "alert", "related", "newsletter", "disclaimer"])
def test_furniture_longer_than_the_article_goes(mark):
    junk = "<p>" + "We inform you of many things. " * 20 + "</p>"
    assert text(f"<div class={mark}>{junk}</div><div>{BODY}</div>") == ALL
    assert text(f"<article>{BODY}<div class={mark}>{junk}</div></article>") == ALL


def test_headers_and_forms_longer_than_the_article_go():
    junk = "<p>" + "Enter your name and address here. " * 15 + "</p>"
    assert text(f"<form>{junk}</form><div>{BODY}</div>") == ALL
    assert text(f"<header>{junk}</header><div>{BODY}</div>") == ALL


def test_a_teaser_is_not_the_article():
    assert text(f'<div><h2>Headline</h2>{BODY}</div><article class="card"><p>Read this as well.</p></article>') == "Headline\n" + ALL
    cards = "".join(f"<article><h3>Card {i}</h3><p>{PARA[i % 3]}</p></article>" for i in range(6))
    assert text(f"<div><p>{PARA[0]}</p></div>{cards}").count("Card") == 6  # articles together outweigh what is beside them


def test_a_marked_article_is_kept_whole_and_alone():
    page = f"<p>{PARA[0]}</p><article><h1>T</h1><p>a</p><p>b</p><p>c</p><ul><li><a href=x>only a link</a></li></ul>{BODY}<p>d</p></article><p>Beside.</p>"
    assert text(page) == "\n".join(["T", "a", "b", "c", "only a link", ALL, "d"])


def test_a_wrapper_with_nearly_all_text_stays():
    assert text(f"<div class=promo>{BODY * 3}</div><p>Published by the editors, all rights are with them.</p>").startswith(ALL)


def test_windows_decide_on_every_page():
    """Without surges nothing is text, marked or not."""
    assert text("<article></article><ul><li><a href=x>one</a></li></ul>") == ""
    assert text("<ul>" + "<li><a href=x>one link</a></li>" * 9 + "</ul>") == ""


def test_repeated_pages_are_rows_of_their_own(spark):
    d = spark.createDataFrame([(1, "u", BODY)] * 3 + [(None, None, None)] * 2, "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.text) for r in htmltext.extract(d).collect())
    assert got == [(0, ""), (0, "")] + [(1, ALL)] * 3


def test_nested_marks_are_linear():
    import time

    began = time.time()
    text("<div class=promo>x" * 40_000)
    assert time.time() - began < 20
