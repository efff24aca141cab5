import html
import re
import time

import duckdb

from rallyframe.llm import main_text

PAGES = "/root/testdata/sf0.01"
BODY = "<p>The first paragraph tells <b>what</b> happened, at some length and with a <a href='/x'>link</a> inside of it.</p><p>Short.</p><p>A third one says that R&amp;D costs &lt;5 &euro; and more&nbsp;words   follow\n here.</p>"
TEXT = "The first paragraph tells what happened, at some length and with a link inside of it. Short. A third one says that R&D costs <5 € and more words follow here."


def by_article(page):
    """What lies in <article>, for pages of the test tables."""
    inner = re.sub(r"</?(?:p|h1|br)>", " ", re.search("<article>(.*?)</article>", page, re.S).group(1))
    return " ".join(html.unescape(re.sub("<[^>]*>", "", inner)).split())


def test_pages_of_the_tables(spark):
    rows = main_text.query(spark, PAGES).collect()
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{PAGES}/pages.parquet'").fetchall())
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == by_article(pages[r.page_id]) and r.n_chars == len(r.text)


def test_held_out_pages_without_their_mark(spark):
    """The scan finds the region where the page doesn't name it, in markup that the weights weren't counted on."""
    pages = spark.read.parquet(f"{PAGES}/pages.parquet")
    weights = main_text.fitted(pages.where("page_id % 2 = 0"))
    for page_id, page in duckdb.sql(f"SELECT page_id, html FROM '{PAGES}/pages.parquet' WHERE page_id % 2 = 1").fetchall():
        bare = page.replace("<article>", '<div class="story"><div>').replace("</article>", "</div></div>").replace("<nav>", '<div id="topMenu">').replace("</nav>", "</div>").replace("<footer>", '<section class="site-footer">').replace("</footer>", "</section>")
        assert main_text.extract(bare, weights) == by_article(page), page_id


def test_markup_of_other_kinds(spark):
    weights = main_text.fitted(spark.read.parquet(f"{PAGES}/pages.parquet"))
    junk = "Sign up for our letter of the week, we never send more than one mail and you can leave at any time you like."
    pages = {
        "notice and sidebar": f'<body class="has-sidebar"><div id="cookie-notice"><p>{junk}</p></div><main><article>{BODY}</article><aside><p>{junk}</p></aside></main><div class="sidebar"><p>{junk}</p></div></body>',
        "comments": f'<header><h2>Site</h2></header><div class="post">{BODY}</div><section id="comments"><article class="comment"><p>{junk}</p></article><p>{junk}</p></section><footer>{junk}</footer>',
        "form and advert inside": f'<main>{BODY[: BODY.index("<p>Short")]}<div class="ad-slot"><p>{junk}</p></div><form><label>{junk}</label></form>{BODY[BODY.index("<p>Short") :]}</main>',
        "hidden": f'<div>{BODY}<div style="display: none"><p>{junk}</p></div><p hidden>{junk}</p><div role="complementary">{junk}</div></div>',
        "scripts": f"<script>var a = '<p>{junk}</p>';</script><style>p {{}}</style><div>{BODY}</div><noscript><p>{junk}</p></noscript>",
        "upper case, unclosed": f"<DIV><!-- <p>{junk}</p> -->{BODY}<SCRIPT>{junk}",
        "list of links": "<ul>" + "".join(f"<li><a href='/{k}'>Another story {k}</a></li>" for k in range(12)) + f"</ul><div>{BODY}</div>",
        "menu around the page": f'<div class="menu-open"><ul class="menu"><li>Home</li></ul><article>{BODY}</article></div>',
    }
    for name, page in pages.items():
        assert main_text.extract(page, weights) == TEXT, name
    own = f"<article><header><h1>What a title</h1></header>{BODY}<footer>{junk}</footer></article>"
    assert main_text.extract(own, weights) == f"What a title {TEXT}"


def test_prior_weights_alone():
    weights = main_text.log_odds({})
    assert main_text.extract(f"<nav><a href=/>Home</a></nav><div>{BODY}</div><div class=footer>All rights reserved by those who hold them.</div>", weights) == TEXT


def test_odd_pages_take_linear_time():
    weights = main_text.log_odds({})
    cases = ["", "<", "<p", "<!-- a", "<script>a", "<a " * 200_000, "<a title='" * 50_001, "<div>" * 50_000 + "</p>" * 50_000, "</x>" * 200_000, "<li><p>" * 50_000, "<b>" * 50_000 + "<p>" * 20_000, "&" * 300_000, "<div class=ad>" * 20_000, "<article><h1>" * 20_000]
    began = time.time()
    assert [main_text.extract(c, weights).strip("&< ") for c in cases] == [""] * len(cases)
    assert time.time() - began < 20
    assert main_text.extract("<p>a < b, a<b>b</b>c<br>d and <i>more</i> words</p>", weights) == "a < b, abc d and more words"
    assert main_text.extract(None, weights) == ""


def test_cases(spark):
    rows = [(1, "u", f"<div>{BODY}</div>", 0), (1, "u", f"<div>{BODY}</div>", 0), (None, None, f"<article>{BODY}</article>", 1), (2, "v", None, 2), (3, None, "", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = sorted(map(tuple, main_text.extracted(df, main_text.fitted(df)).collect()), key=str)
    assert got == sorted([(1, "u", TEXT), (1, "u", TEXT), (None, None, TEXT), (2, "v", ""), (3, None, "")], key=str)
    assert main_text.extracted(df.limit(0), main_text.fitted(df.limit(0))).count() == 0
