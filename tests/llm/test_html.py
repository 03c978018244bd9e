"""Main text of pages: time, broken markup, and article text that class names and tags must not take away."""

import time

import pytest

from nearfd.llm.htmltext import main_text, tokens

MEG = 1_000_000


@pytest.mark.parametrize("unit,tail", [
    ("<a '\"", ""), ("<a \"x", ""), ("<a ", ""), ("<div>", ""), ("<a '\">x", ""), ("<a b=\"c='>", ""), ("<p><span>", ""), ("</p>", ""),
    ("<p><table><div>", ""), ("<article><b>x", ""), ("<", ""), ("<!", ""), ("<!--", ""), ("<svg></svg", ""), ("<script></script ", ">"),
    ("<li><div class=ad>x", ""), ("<a '\"", ">"), ("<a \"x", ">"), ("<comments class=comments>", "")])
def test_time_is_linear_in_the_page(unit, tail):
    page = "<body><p>Words before.</p>" + unit * (MEG // len(unit)) + tail
    t = time.process_time()
    text = main_text(page)
    assert time.process_time() - t < 5
    assert "<a" not in text


KEPT = [
    "<header><h1>Title</h1></header>", "<h2 id=\"search\">Search algorithms</h2>", "<h2 id='related-work'>Related work</h2>",
    "<section id=share-prices><p>Share prices fell.</p></section>", "<p class=side-effects>Side effects are rare.</p>",
    "<p class=legal>Legal text of the article.</p>", "<div class='search-results-explained'>How results are ranked.</div>",
    "<p>A <label>label</label> in a sentence.</p>", "<p>Let <math><mi>x</mi></math> be a number.</p>", "<p class=notice-period>Four weeks.</p>",
    "<div id=menu-of-the-day>Soup and bread.</div>", "<h3 class=header>Heading</h3>"]
GONE = ["<div class=ad>Buy</div>", "<div class='share-buttons'>Share</div>", "<div id=comments>I like it</div>", "<nav>Home</nav>",
        "<div class='related-posts'>More</div>", "<div class=notice>We use cookies</div>", "<aside>Beside</aside>", "<form><label>Name</label></form>",
        "<p class=advert>Cheap</p>", "<script>var a = '<p>';</script>", "<div class=newsletter>Mail</div>"]


@pytest.mark.parametrize("tag", ["article", "main"])
def test_text_inside_the_article_stays(tag):
    body = "<p>The first paragraph of the article says some words.</p>"
    plain = main_text(f"<body><{tag}>{body}</{tag}></body>")
    for x in KEPT:
        got = main_text(f"<body><{tag}>{body}{x}</{tag}></body>")
        words = " ".join(" ".join(x.replace(">", "> ").replace("<", " <").split()).split())
        import re
        want = " ".join(re.sub(r"<[^>]*>", "", words).split())
        assert got.split() == plain.split() + want.split(), x
    for x in GONE:
        assert main_text(f"<body><{tag}>{body}{x}</{tag}></body>") == plain, x


def test_headings_of_pages_without_article():
    page = "<body><div class=post><h2 id=search>Search</h2><p class=legal>Words about law.</p><p>More words of it.</p></div><div class=search>Find</div></body>"
    assert main_text(page) == "Search\nWords about law.\nMore words of it."


def test_tokens_of_broken_markup():
    names = lambda page: [(page[a:b], n) for a, b, _, n, _ in tokens(page) if n or b > a]
    assert names("x <a href='>'>y</a> 1 < 2 <b") == [("x ", "a"), ("y", "a"), (" 1 < 2 ", "")]
    assert names("<a title=\"x>y</a>") == [("", "a"), ("y", "a")]
    assert names("<!-- <p> -->a<!doctype html>b<?x?>c<!--") == [("a", ""), ("b", ""), ("c", "")]
    assert main_text("<p>a<script>if (a < b) '</p>'</script>b</p>") == "ab"
    assert main_text("Text <a <a <a") == "Text" and main_text("<p>Fish & chips &amp; <b>3 < 4</b>") == "Fish & chips & 3 < 4"
