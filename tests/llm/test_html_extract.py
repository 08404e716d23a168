import html
import re

import pytest

from glucolake.llm.html_extract import extract, main_text

LONG = "The first thing to say, and it needs saying, is that this sentence is long enough to be a paragraph of its own."


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_everything_around_the_article_goes():
    got = extract(page(
        '<div id="cookie-notice">We use cookies, and more cookies, for all of you who read this page.</div><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>'
        f'<div class="sidebar"><p>{LONG}</p></div><div class="ad-slot"><p>{LONG}</p></div>'
        f"<article><h1>Title</h1><p>{LONG}</p><p>Short.</p><aside>{LONG}</aside><form><p>{LONG}</p></form><div class='related'><ul><li><a>{LONG}</a></li></ul></div>"
        f'<ul><li>One item</li><li>Another</li></ul><p>End &amp; <b>bold</b>&nbsp;text<br>line.</p></article><section id="comments"><p>{LONG}</p><p>{LONG}</p></section><footer>{LONG}</footer>'
    ))
    assert got == f"Title\n\n{LONG}\n\nShort.\n\nOne item\n\nAnother\n\nEnd & bold text line."


def test_container_without_article_element():
    got = extract(page(f"<div id=top><a href=/>Home</a> <a href=/a>About us and others</a></div><div id=wrap><div class=c1><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><p>Short one.</p></div><div class=links><a>{LONG}</a></div></div>"))
    assert got == f"Head\n\n{LONG}\n\n{LONG}\n\nShort one."


@pytest.mark.parametrize("broken,want", [
    (None, ""), ("", ""), ("   ", ""), ("<html><body></body>", ""), ("plain text only", "plain text only"), ("<p>a<p>b", "a\n\nb"),
    ("<article><p>one<b>two<br><p>three</article>", "onetwo\n\nthree"), ("<article><p>x &lt;tag&gt; &#233; &am</p></arti", "x <tag> é &am"),
    ("<article><p>1 < 2 and 3 > 2</p><!-- no end", "1 < 2 and 3 > 2"), ('<article><p title="a>b">q</p><script>var t="</p>";</script><p>r</p></article>', "q\n\nr"),
    ("<article><p>a</p><style>x", "a"), ('<article><p class="x>y</p><p>z</p></article>', "y\n\nz"),
])
def test_broken_pages(broken, want):
    assert extract(broken) == want


def test_very_long_pages_take_linear_time():
    assert len(extract(page("<article>" + f"<p>{LONG}</p>" * 20000 + "</article>"))) == 20000 * (len(LONG) + 2) - 2
    assert extract("<div>" * 3000 + "deep") == "deep"
    assert extract("<" * 50000) == "<" * 50000


def test_driver_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]]["text"] == "\n\n".join(p for p in parts if p)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


@pytest.mark.parametrize("names", ["article", "article|main", "article|main|section"])
def test_driver_pages_by_score_alone(spark, names):
    """The same text where no element tells which part is the article."""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        assert extract(re.sub(rf"(</?)(?:{names})\b", r"\1div", r["html"])) == extract(r["html"])


@pytest.mark.parametrize("body,want", [
    ('<p>a <span class="ad">Buy <span>now</span> cheap pills</span> b</p>', "a b"),
    ('<p>a <span class="ad">Buy <span>now <span>or</span></span> never</span> b <span>c</span></p>', "a b c"),
    ('<p>a <span class="ad">no end</p><p>b</p>', "a no end\n\nb"),
    ('<p>a <span class="ad"><div>Buy <span>x</span></div> more</span> b</p><p>c</p>', "a\n\nb\n\nc"),
    ('<p>a <small style="display:none">x</small><span>y</span> <ins hidden class="c">z</ins></p>', "a y"),
])
def test_inline_parts_are_left_out_to_their_own_end(body, want):
    assert extract(f"<article>{body}</article>") == want


def test_many_inline_parts_without_an_end_take_linear_time():
    assert extract("<article><p>" + '<span class="ad">x ' * 20000 + "</article>").count("x") == 20000


def test_points_reach_every_element_around():
    """A container ten levels above its paragraphs still gets their points."""
    deep = lambda x: "<div>" * 9 + f"<p>{x}</p>" + "</div>" * 9
    got = extract(page(f"<div id=a><div><ul><li><a href=/>one link, or two</a></li></ul></div></div><div id=b>{deep(LONG)}</div>"))
    assert got == LONG


def test_table_edges(spark):
    df = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>x", 2), (1, "u", "<p>x", 2)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, main_text(df).collect()), key=str) == [(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0)]
    assert main_text(df.where("false")).count() == 0


def test_deep_nesting_takes_time_in_proportion():
    depth = 100_000
    assert extract("<div>" * depth + f"<p>{LONG}</p>" + "</div>" * depth) == LONG
    assert extract("<ul><li>" * depth + LONG) == LONG


PROSE = [f"Paragraph {k} of the article says one thing, and then another, at some length so that it counts." for k in range(6)]


@pytest.mark.parametrize("before,after", [
    ("<body><div class='post has-comments'>", "</div>"), ("<body><div class='entry related-enabled'>", "</div>"), ("<body class='has-ads'><div>", "</div>"),
    ("<body><article class='hentry comments-open'>", "</article>"), ("<body><form action='/page'><div class='content'>", "</div></form>"), ("<body><div class='site no-ads'><div>", "</div></div>"),
    ("<body><div class='menu-open'><div class='comments-closed'>", "</div></div>"),
])
def test_article_stays_in_spite_of_its_class(before, after):
    page = f"<html>{before}{''.join(f'<p>{p}</p>' for p in PROSE)}{after}<div class='comments'><p>A comment that is long enough to be a paragraph.</p></div><footer>Imprint</footer></body></html>"
    assert extract(page) == "\n\n".join(PROSE)


def test_comments_go_though_they_are_most_of_the_text():
    for name in ("comments", "post-comments", "comment-body"):
        page = f"<body><div class='content'><p>{PROSE[0]}</p><p>{PROSE[1]}</p></div><div class='{name}'>{''.join(f'<p>{p} I agree.</p>' for p in PROSE * 3)}</div></body>"
        assert extract(page) == "\n\n".join(PROSE[:2])
    assert extract(f"<body><div style='display:none'><p>{PROSE[0]}</p></div></body>") == ""


def test_links_without_an_end():
    """A named place is no link, and a link without an end tag ends at the next one or at a block."""
    prose = "".join(f"<p>{p}</p>" for p in PROSE)
    for start in ("<a name='top'>", "<a id=top>", "<a href='#x'>", "<a name='a'><a name='b'>"):
        assert extract(f"<body>{start}<div class=c>{prose}</div></body>") == "\n\n".join(PROSE)
        assert extract(f"<body><div>{start}{prose}</div><div>{start}{prose}</div></body>").count(PROSE[2]) == 2
        listed = extract(f"<article>{prose}<p>See {start}this<ul><li>point one</li><li>point two</li></ul></article>")
        assert listed.endswith("point one\n\npoint two")
    assert extract(f"<body><div>{prose}</div><div><a href=/x><h3>A card, and another</h3><p>{PROSE[0]}</p></a></div></body>") == "\n\n".join(PROSE)


def test_siblings_of_an_article_that_belong_to_it():
    article = f"<article>{''.join(f'<p>{p}</p>' for p in PROSE[:3])}</article>"
    assert extract(f"<body><div>{article}<p>{PROSE[3]}</p><p>{PROSE[4]}</p><p>Short line.</p></div></body>") == "\n\n".join(PROSE[:5])
    second = f"<article>{''.join(f'<p>{p}</p>' for p in PROSE[3:])}</article>"
    assert extract(f"<body><div>{article}{second}<div><a href=/a>{PROSE[0]}</a></div></div></body>") == "\n\n".join(PROSE)


@pytest.mark.parametrize("line", ["<b>Ann</b> 3 May 2024", "Bob, 2 hours ago", "<span>carla_9</span> <time>2023-11-02</time>", "<a href=/u/1>Dan</a> 14:05"])
def test_reader_comments_by_their_shape(line):
    """Without a telling class: boxes of a line with name and date and some text."""
    post = f"<div class='post'>{''.join(f'<p>{p}</p>' for p in PROSE)}</div>"
    boxes = "".join(f"<div class='c'><div>{line}</div><p>I read this with pleasure, and will come back, number {k}.</p></div>" for k in range(3))
    assert extract(f"<body><div id=w>{post}<div class='c-list'>{boxes}</div></div></body>") == "\n\n".join(PROSE)
    parts = "".join(f"<div><h3>{k} May 2024</h3><p>{p}</p></div>" for k, p in enumerate(PROSE, 1))
    assert all(p in extract(f"<body><div id=w><div>{parts}</div></div></body>") for p in PROSE)
