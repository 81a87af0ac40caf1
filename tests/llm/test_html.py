import html
import itertools
import os
import random
import re

import pyarrow.parquet as pq
import pytest

from graphlens.llm import op10_html as op

DATA = "/root/testdata/sf0.001"
PAGE = """<!DOCTYPE html><html><head><title>Site &amp; title</title><meta charset=utf-8><style>p{}</style>
<script>var a = "</p><p>not text</p>";</script></head><body class="blog">
<header class="site-header"><a href=/>Home</a><h2>My site</h2></header>
<nav><ul><li><a href="/a">First</a></li><li><a href="/b">Second</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site to give you the best possible experience of our pages.</p></div>
<div id="ad-1" class="ad"><p>Buy our wonderful product now, it is the very best that money can buy today.</p></div>
<!-- a comment <p>hidden</p> -->
<main><article><h1>The &lt;main&gt; title</h1>
<p>First paragraph   with <b>bold</b>, <a href="/x">a link</a> and&nbsp;more words in it.<br>Second line &#233;.</p>
<ul><li>One point of the list</li><li>Another point of it</li></ul>
<p>Unclosed paragraph
<p>Short.</p><table><tr><td>Cell one</td><td>Cell two</td></tr></table>
<form><label>Your mail</label><input name=q><textarea>type here</textarea><button>Send</button></form>
<blockquote>Quoted words of somebody, as they were said.</blockquote></article></main>
<aside><h3>Related</h3><p>Some other story that you may like to read on this site today.</p></aside>
<section class="comments"><p>Great article, I liked reading it very much, thank you for it.</p></section>
<footer>&copy; 2024 The company. All rights reserved by us.</footer></body></html>"""


def test_a_page():
    assert op.extract(PAGE).split("\n\n") == [
        "The <main> title",
        "First paragraph with bold, a link and more words in it. Second line é.",
        "One point of the list",
        "Another point of it",
        "Unclosed paragraph",
        "Short.",
        "Cell one",
        "Cell two",
        "Quoted words of somebody, as they were said.",
    ]


def test_comments_as_articles():
    page = "<body><article class='post'><h1>A title of it</h1><p>The text of the article itself, in a sentence.</p></article><section id='comments'><article class='comment-body'><p>" + "A long comment of a reader goes on and on. " * 8 + "</p></article></section></body>"
    assert op.extract(page) == "A title of it\n\nThe text of the article itself, in a sentence."


def unnamed(page):
    return re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


def test_names_do_not_decide():
    assert unnamed(PAGE) != PAGE and op.extract(unnamed(PAGE)) == op.extract(PAGE)
    page = "<body><article><h1>A title of it</h1><p>The text of the article itself, in a sentence.</p><p>And one more of them, so that it is longer than what readers say.</p>{}</article>{}</body>"
    want = "A title of it\n\nThe text of the article itself, in a sentence.\n\nAnd one more of them, so that it is longer than what readers say."
    comment = "<article><p>I liked it very much, thank you.</p></article>"
    assert op.extract(page.format("", "")) == want
    assert op.extract(page.format(comment, "")) == want  # an article in an article
    assert op.extract(page.format("", f"<section>{comment * 3}</section>")) == want  # articles without a heading
    assert op.extract(page.format("", "<p>&copy; 2024 The company and all its many friends.</p>")) == want
    for name in ("legal", "notice", "post-header"):
        kept = f"<div class='{name}'>What the law says of this is told in a sentence here.</div>"
        assert op.extract(page.format(kept, "")) == f"{want}\n\nWhat the law says of this is told in a sentence here."


def test_the_cut_decides_where_evidence_is_weak():
    """Blocks whose own cost says otherwise go with their container."""
    page = "<body><div>" + "<p>A paragraph of text that has a good many words, and so on it goes.</p>" * 4 + "<p>Two words</p>" + "<p>A paragraph of text that has a good many words, and so on it goes.</p>" * 4 + "</div></body>"
    parts = op.blocks(page)
    scores = op.scored(parts)
    assert scores[4] < 0 and all(op.min_cut(scores, op.neighbours(parts)))
    assert not op.min_cut(scores, [])[4]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pages_without_names_keep_their_text():
    pages = pq.read_table(f"{DATA}/pages.parquet").column("html").to_pylist()
    assert all(op.extract(unnamed(p or "")) == op.extract(p) for p in pages)


def test_main_text_of_the_test_pages():
    """The article of each page, taken by plain regular expressions."""
    pages = pq.read_table(f"{DATA}/pages.parquet").column("html").to_pylist() if os.path.isdir(DATA) else []
    for page in pages:
        body = re.search("<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert op.extract(page) == "\n\n".join(x for x in parts if x)


def cost(scores, edges, side):
    return sum(max(0, x) if not s else max(0, -x) for x, s in zip(scores, side, strict=True)) + sum(c for u, v, c in edges if side[u] != side[v])


def test_minimum_cut_by_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(1, 9)
        scores = [rng.randint(-10, 10) for _ in range(n)]
        edges = [(*rng.sample(range(n), 2), rng.randint(0, 8)) for _ in range(rng.randint(0, 12))] if n > 1 else []
        best = min(cost(scores, edges, side) for side in itertools.product([False, True], repeat=n))
        assert cost(scores, edges, op.min_cut(scores, edges)) == best


def test_odd_html():
    assert op.extract(None) == op.extract("") == op.extract("   ") == ""
    assert op.extract("plain words without any markup at all, but a sentence.") == "plain words without any markup at all, but a sentence."
    assert op.extract("<article><p>a < b and c > d is a sentence of this text.</p></article>") == "a < b and c > d is a sentence of this text."
    assert op.extract("<article><p>cut off <b in the middle of") in ("cut off", "cut off <b in the middle of")
    assert "x" not in op.extract("<article><script>x</article><p>x</p>")


TEXT = "A sentence of the article that has enough words to be its text."


def test_head_without_end_tag():
    head = '<html><head><meta charset=utf-8><title>T</title><script>var a = "<body><p>no";</script>'
    for rest in (f"<body><article><p>{TEXT}</article>", f"<article><p>{TEXT}</p></article>", f"</head><body><article><p>{TEXT}</p></article></body>", f"\n{TEXT}"):
        assert op.extract(head + rest) == TEXT


def test_hidden_is_an_attribute():
    for attrs in ('title="the hidden cost"', 'class="overflow hidden md:block"', "data-x='a hidden b'", 'data-css="display:none"', 'class="hidden"'):
        assert op.extract(f"<article><p {attrs}>{TEXT}</p></article>") == TEXT
    for attrs in ("hidden", "HIDDEN=''", 'class="x" hidden', 'style="color:red; display : none"', "style=display:none"):
        assert op.extract(f"<article><p {attrs}>Not shown.</p><p>{TEXT}</p></article>") == TEXT


def test_hidden_elements_end_with_their_parents_and_peers():
    for page in (
        f"<article><p hidden>Not shown.<p>{TEXT}</article>",
        f"<article><p hidden>Not <b>shown</b>.<div>{TEXT}</div></article>",
        f"<article><ul><li hidden>Not shown.<ul><li>Nor this.<li>Nor this.</ul>Nor this.<li>{TEXT}</ul></article>",
        f"<article><ul><li hidden>Not shown.</ul><p>{TEXT}</p></article>",
        f"<article><section><div hidden>Not shown.</section><p>{TEXT}</p></article>",
        f"<article><dl><dt hidden>Not shown.<dd>{TEXT}</dl></article>",
        f"<article><table><tr hidden><td>Not<td>shown.<tr><td>{TEXT}</table></article>",
        f"<article><div hidden><p>Not<p>shown.<div>Nor</div> this.</div><p>{TEXT}</p></article>",
        f"<article><span hidden>Not <span>shown</span> at all.</span><p>{TEXT}</p></article>",
        f"<article><p><span hidden>Not shown.<p>{TEXT}</article>",
        f"<article><div hidden>Not <script>'</div>'</script> shown.</div><p>{TEXT}</p></article>",
    ):
        assert op.extract(page) == TEXT, page


def test_long_pages_are_linear():
    for page in ("<div>" * 50_000, "<" * 200_000, "<p>word " * 50_000, '<a href="' * 20_000, "<!--" * 50_000, "&amp;" * 100_000):
        op.extract(page)


def test_table(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 2), (3, "v", "<p></p>", 3), (4, "w", "<article>" + "<p>Many words stand here.</p>" * 5000 + "</article>", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    got = op.extracted(pages).collect()
    assert len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert sorted(len(r.text) for r in got)[:2] == [0, 0]
    assert next(r for r in got if r.page_id == 4).text.count("\n\n") == 4999
    assert op.extracted(pages.limit(0)).collect() == []
