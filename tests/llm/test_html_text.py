"""Main text of pages: hand cases, pages made from known parts, and the table operator."""

import random
import time

import pytest

from logtriage.llm.html_text import extract, extract_pages

WORDS = "river stone, market, the of and policy share comment law notice café &amp; 3 &lt; 4".split()
JUNK = (
    "<nav><ul><li><a href='/a'>Home</a></li></ul></nav>",
    "<div class='ad'>Buy, now, here, at once.</div>",
    "<aside><p>Also read this, and that.</p></aside>",
    "<div id='cookie-notice'><p>We use cookies, many of them.</p></div>",
    "<section class='comments'><p>First, I say!</p><p>Second, you say.</p></section>",
    "<form><label>Mail</label><input name='m'></form>",
    "<script>var a='</p>';</script><style>p{}</style>",
    "<ul class='social-share'><li>Post</li></ul>",
    "<div class='sidebar-widget'>Weather, today.</div>",
)


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><p>A, b.</p><section class="share-price"><p>The share price fell.</p></section></article>', "A, b.\n\nThe share price fell."),
        ('<article><h2 id="comment-on-law">Law</h2><p id="social-policy">Social policy.</p></article>', "Law\n\nSocial policy."),
        ('<article><h2 id="comments">On comments</h2><p>One.</p></article>', "On comments\n\nOne."),
        ('<article><div class="article-header"><h1>Headline</h1></div><p>Body.</p></article>', "Headline\n\nBody."),
        ('<p>Intro</p><form id="aspnet"><article><p>Real, text.</p><form>no</form></article></form>', "Real, text."),
        ("<div>x<table><tr><td>cell, one</td><td>two</td></tr></table></div>", "x\n\ncell, one\n\ntwo"),
        ("<article><p>x</p><div class='comment-list'><p>hi, there, you</p></div><p class='adBox2'>z</p></article>", "x"),
        ("<div class='ad'>Buy</div><main><p>x</p></main><footer>f</footer>", "x"),
    ],
)
def test_names_do_not_cut_article_text(page, text):
    assert extract(page) == text


@pytest.mark.parametrize("seed", range(40))
def test_pages_made_from_known_parts(seed):
    rng = random.Random(seed)
    plain = {"&amp;": "&", "&lt;": "<"}
    blocks, body = [], []
    for _ in range(rng.randint(1, 12)):
        if rng.random() < 0.3:
            body.append(rng.choice(JUNK))
        words = rng.choices(WORDS, k=rng.randint(1, 60))
        blocks.append(" ".join(plain.get(w, w) for w in words))
        marked = [f"<b>{w}</b>" if rng.random() < 0.1 else w for w in words]
        tag = rng.choice(["p", "p", "h2", "blockquote", "div"])
        name = rng.choice(["", " class='share-price'", " id='law-notice-board'", " class='policy'"])
        body.append(f"<{tag}{name}>{rng.choice([' ', chr(10), '  '])}" + rng.choice([" ", "\n\t "]).join(marked) + f"</{tag}>")
    around = lambda: "".join(rng.sample(JUNK, rng.randint(0, 4)))
    wrap = rng.choice(["{}", "<div class='page-wrapper'>{}</div>", "<div><div class='content'>{}</div></div>", "<form>{}</form>"])
    page = f"<html><head><title>T</title></head><body>{around()}{wrap.format('<article>' + ''.join(body) + '</article>')}{around()}</body></html>"
    assert extract(page) == "\n\n".join(blocks)


@pytest.mark.parametrize("unit", ["<div>a, b", "<b>a ", "<div><p>a", "<b>x</i></p></q>", "<ul><li>x"])
def test_deep_pages_cost_in_proportion(unit):
    def seconds(n):
        begin = time.process_time()
        assert extract(unit * n)
        return time.process_time() - begin

    seconds(1000)
    # ten times the depth; a hundred times the work if every element climbed to the top
    assert seconds(20_000) < 40 * max(seconds(2_000), 0.02)


def test_table(spark):
    rows = [(1, "u", "<p>a, b</p>", "x", 9), (1, "u", "<p>a, b</p>", "x", 9), (None, None, None, None, None), (2, None, "", "y", 1), (3, "v", "<p>" + "é, " * 200_000 + "</p>", "z", 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = extract_pages(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((r.page_id or 0, r.url or "", r.text[:4], r.n_chars) for r in got.collect())
    assert found == [(0, "", "", 0), (1, "u", "a, b", 4), (1, "u", "a, b", 4), (2, "", "", 0), (3, "v", "é, é", 599_999)]
    assert extract_pages(pages.limit(0)).count() == 0
