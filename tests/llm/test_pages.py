import html
import re

import pytest

from stockroom.llm import pages
from stockroom.llm.queries import op9_html_extraction

SHELL = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>no</article>";</script><style>p{{}}</style>
<body class="has-sidebar"><header><h2>Site</h2></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap{n}"><div class="post-{n} content"><h1>Title {n}</h1>{body}<div class="ad-box">Buy</div>
<form><label>Mail</label><input></form><section id="comments"><p>First! A very long comment that says a lot {n}</p></section></div>
<aside>Side</aside></div><footer>Foot</footer>"""


def page(n, body):
    return SHELL.format(n=n, body=body)


def test_layout_with_classes(spark):
    rows = [(i, f"http://a.example/{i}", page(i, f"<p>One &amp; two<p>Th<b>re</b>e<br>four&nbsp;five {i}<ul><li>x<li>y</ul>")) for i in range(6)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} One & two Three four five {i} x y" for i in range(6)}


def test_marked_wrappers_keep_the_article():
    text = "<p>" + "the story goes on and on " * 20
    side = "<div class='sidebar'>Side</div><div class='related'><article>Teaser</article></div><section class='comments'>" + "<p>me too " * 100 + "</section>"
    for before, after in (("<div class='content-sidebar-wrap'><article>", "</article>"), ("<div id='layout-with-sidebar'><main>", "</main>"),
                          ("<div class='post has-banner'>", ""), ("<div class='page-header-wrap'><div class='entry'>", "</div>"),
                          ("<div class='has-menu'><div class='content'>", "</div>")):
        source = f"<body><nav>Home</nav>{before}<h1>A</h1>{text}<div class=ad>Buy</div>{after}</div>{side}"
        best = max(pages.read_page(source)[0].items(), key=lambda x: x[1])[0]
        assert pages.read_page(source, best)[1] == " ".join(["A"] + ["the story goes on and on"] * 20), before
    plain = f"<body><div id='layout-with-sidebar'><div>{text}</div></div><div class='promo'>Buy now</div>"
    best = max(pages.read_page(plain)[0].items(), key=lambda x: x[1])[0]
    assert pages.read_page(plain, best)[1] == " ".join(["the story goes on and on"] * 20)


ARTICLE = "<h1>A</h1>" + "<p>the story goes on and on " * 20


@pytest.mark.parametrize("source", [
    f"<body><form id='aspnetForm'><input type=hidden><nav>Home</nav><article>{ARTICLE}</article><footer>End</footer></form>",
    f"<body><form method=post><div class='content'>{ARTICLE}</div><div class='sidebar'>Side</div></form>",
    f"<body><form><main>{ARTICLE}</main></form><form><label>Search</label><input></form>",
    f"<body><div role='form'><article>{ARTICLE}</article></div><div role=search>Find</div>",
    f"<body><nav>Home</nav><dialog open><article>{ARTICLE}</article></dialog>",
    f"<body><section role=dialog><div class='entry'>{ARTICLE}</div></section><dialog>Closed box</dialog>",
    f"<body><dialog open><p>Cookies?</p></dialog><article>{ARTICLE}</article>",
    f"<body><article>{ARTICLE}<form><label>Your mail</label><button>Go</button></form></article>",
    f"<body><form class='page'><form><div>{ARTICLE}</div></form></form><form class='login'>Name</form>",
    f"<body><form><div class='post'>{ARTICLE}</div><section class='comments'><form>{'<p>me too ' * 100}</form></section></form>",
    f"<body role=form><header>Top</header><form><article>{ARTICLE}<aside>Ad</aside></article></form>",
])
def test_forms_and_dialogs_that_hold_the_page(source):
    best = max(pages.read_page(source)[0].items(), key=lambda x: x[1])[0]
    assert pages.read_page(source, best)[1] == " ".join(["A"] + ["the story goes on and on"] * 20)


def test_article_with_own_header():
    source = "<body><article><header><h1>A</h1></header><p>b<div class=comments>c</div><!-- d --><p hidden>e</p>f < g</article><p>h"
    best = max(pages.read_page(source)[0].items(), key=lambda x: x[1])[0]
    assert pages.read_page(source, best)[1] == "A b f < g"


def test_edge_rows(spark):
    long = "<article>" + "<p>word &lt;" * 60_000
    rows = [(1, None, None, "a"), (1, "http://x/1", "", "b"), (None, "not a url", "plain text", "c"), (2, "http://x/2", long, "d"),
            (3, "http://x/3", "<div>" * 30_000 + "deep", "e"), (3, "http://x/3", "<div>" * 30_000 + "deep", "f"), (4, "", "<p", "g"),
            (5, "http://x/5", '<a href="x>y<p>z', "h"), (6, "http://x/6", "<script>never closed", "i")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = sorted(((r.page_id or 0, r.text) for r in pages.extract(df).collect()))
    assert got == sorted([(1, ""), (1, ""), (0, "plain text"), (2, " ".join(["word <"] * 60_000)), (3, "deep"), (3, "deep"), (4, "<p"),
                          (5, "y z"), (6, "")])
    assert pages.extract(df.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    """The pages of the test data have their text in one article."""
    rows = {r.page_id: r for r in op9_html_extraction(spark, sf_dir).collect()}
    table = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(rows) == len(table)
    for r in table:
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.sub(r"</?(?:h1|p|br)>", " ", inside)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", blocks)).split())
        assert rows[r.page_id].text == want and rows[r.page_id].n_chars == len(want)
