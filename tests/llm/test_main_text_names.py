"""op9: names and attributes that mislead, broken pages in linear time."""

import time

import pytest

from quiltspark.llm import htmltext

FIRST = "The first paragraph of this article is long enough to say something, and it holds no links at all."
LAST = "A last paragraph, which is about as long as the first one was, and as plain as that one."


def page(part):
    return f"<body><nav><a href=a>Home</a></nav><article><h1>A title</h1><p>{FIRST}</p>{part}<p>{LAST}</p></article><footer>f</footer></body>"


@pytest.mark.parametrize("part", [
    "<div title='a hidden thing'><p>{}</p></div>", "<p class='x hidden md'>{}</p>", "<p data-x='class=menu aria-hidden=true'>{}</p>",
    "<section id='related-work'><p>{}</p></section>", "<section class='job-search'><p>{}</p></section>", "<p style='display: block'>{}</p>",
])
def test_text_in_parts_with_misleading_names_stays(part):
    text = "Here the body of the text goes on for a while, in plain words that nobody should lose."
    assert htmltext.main_text(page(part.format(text))) == f"A title {FIRST} {text} {LAST}"


@pytest.mark.parametrize("part", [
    "<div hidden><p>{}</p></div>", "<p HIDDEN=''>{}</p>", "<p style='color:red;Display : none'>{}</p>", "<p aria-hidden=TRUE>{}</p>",
    "<div class='ad-slot'><p>{}</p></div>", "<div class='notice'><p>{}</p></div>", "<div id=user-comments><p>{}</p></div>",
    "<section class='related-articles'><p>{}</p></section>", "<div class='share js-share'><p>{}</p></div>",
    "<section id='related-work'><ul><li><a href=x>{}</a></li><li><a href=y>Another one</a></li></ul></section>",
])
def test_hidden_and_named_parts_go(part):
    text = "Here is what a reader of the article should not see, however long and plain it is."
    assert htmltext.main_text(page(part.format(text))) == f"A title {FIRST} {LAST}"


@pytest.mark.parametrize("html", [
    "<a " * 200_000, "<a '" * 200_000, "<!" * 200_000, "<div>" * 150_000, "<article>" * 60_000, "<div class=ad>" * 50_000 + "<article>x</article>" * 10_000,
    "<div>" * 20_000 + "<li></li>" * 50_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<b>" * 50_000 + "<hr>" * 50_000, "<a href='x" * 200_000 + "<p>y</p>" * 50_000,
    "<article>" + "<section class=xy-ad>" * 20_000 + "x", "<p>some words</p>" * 300_000,
])
def test_broken_and_deep_pages_take_linear_time(html):
    began = time.process_time()
    htmltext.main_text(html)
    assert time.process_time() - began < 20


def test_open_quotes_lose_little():
    html = f"<body><article><p>{FIRST}</p><p title=\"open>{LAST}</p></article></body>"
    assert htmltext.main_text(html) == f"{FIRST} {LAST}"
    assert htmltext.main_text("1 < 2 <b>and</b> 3 > 2 <a") == "1 < 2 and 3 > 2 <a"
