"""Main text of pages: layouts that the labelled table doesn't hold, odd markup, and the given pages."""

import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolytics.llm import htmltext, queries
from repolytics.llm.labelled_blocks import LABELLED

SCHEMA = "page_id long, url string, html string"


def some(n):
    return " ".join(["lorem"] * n)


def extracted(page):
    blocks, score = htmltext.judged(page, htmltext.learned())
    return [b.text for b, s in zip(blocks, score, strict=True) if s >= 0.5]


LAYOUTS = {
    "elements": (
        f"<body><header><h1>Site</h1><nav><a href=1>a</a> <a href=2>b</a></nav></header><main><article><h1>Title here</h1><p>{some(30)}.<p>Short.<ul><li>x one<li>y two</ul></article>"
        f"<section class='comments'><h2>Comments</h2><article><p>{some(50)}.</p></article></section></main><aside><p>{some(30)}.</p></aside><footer><p>&copy; x</p></footer>",
        ["Title here", f"{some(30)}.", "Short.", "x one", "y two"],
    ),
    "names": (
        f"<div id=top><a href=a>Home</a> | <a href=b>About us</a></div><div id=nav><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div><div id=content><h1>T</h1><p>{some(25)}.</p><p>Yes.</p></div><div id=footer>{some(9)}</div>",
        ["T", f"{some(25)}.", "Yes."],
    ),
    "no names": (
        f"<div><a href=a>Home</a></div><div><a href=b>About us</a></div><div><h1>A title of this</h1><p>{some(25)}.</p><p>{some(40)}.</p><p>Yes.</p><p>{some(33)} <a href=x>{some(3)}</a>.</p></div><div><a href=i>Imprint</a> <a href=i>Contact</a></div><div>(c) 2020 Corp</div>",
        ["A title of this", f"{some(25)}.", f"{some(40)}.", "Yes.", f"{some(36)}."],
    ),
    "inside the article": (
        f'<article><header><h1>My title</h1></header><p>{some(22)}.</p><div class="ad-slot"><p>{some(12)}.</p></div><div class="newsletter-signup"><form><label>Mail</label><input><button>Go</button></form></div><p>{some(7)}.</p><footer>in <a href=x>x</a></footer></article><div class="cookie-banner"><p>{some(30)}.</p><button>OK</button></div>',
        ["My title", f"{some(22)}.", f"{some(7)}."],
    ),
    "table": (f"<table><tr><td><a href=1>n1</a><br><a href=2>n2</a></td><td><p>{some(60)}.</p><p>{some(4)}.</p><p>{some(44)}.</p></td></tr></table>", [f"{some(60)}.", f"{some(4)}.", f"{some(44)}."]),
    "wrapped paragraphs": (
        f'<div class="site-header"><p>x y</p></div><div class="article-body"><div class="p1"><p>{some(20)}.</p></div><div class="p2"><p>{some(2)}.</p></div><figure><img><figcaption>{some(5)}</figcaption></figure><blockquote>{some(9)}</blockquote></div><div id="disqus_thread"><p>{some(80)}.</p></div>',
        [f"{some(20)}.", f"{some(2)}.", some(5), some(9)],
    ),
    "layout in names": (
        f'<body class="has-sidebar single-post"><div class="content-wrapper with-sidebar"><div class="main"><h2>Head line</h2><p>{some(30)}.</p><p>{some(10)}.</p></div><div class="sidebar"><h3>Popular</h3><ul><li><a href=1>{some(5)}</a></ul><p>{some(30)}.</p></div></div>',
        ["Head line", f"{some(30)}.", f"{some(10)}."],
    ),
    "wrapped, no names": (
        f"<div><a href=1>One</a> <a href=2>Two</a></div><div><div class=x1><p>{some(14)}.</p></div><div class=x2><p>{some(3)}.</p></div><div class=x3><p>{some(35)}.</p></div><div class=x4><p>{some(8)}.</p></div></div><div><a href=9>Imprint</a></div>",
        [f"{some(14)}.", f"{some(3)}.", f"{some(35)}.", f"{some(8)}."],
    ),
    "hidden": (f"<main><p>{some(9)}.</p><p style='display: none'>{some(20)}.</p><div hidden>{some(9)}</div><p>End.</p></main>", [f"{some(9)}.", "End."]),
    "text alone": (some(50), [some(50)]),
    "a word": ("<p>hello", ["hello"]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, expected = LAYOUTS[name]
    assert extracted(page) == expected


ODD = {
    None: "",
    "": "",
    " \n ": "",
    "<": "<",
    "a < b & c": "a < b & c",
    "<p>a&nbsp;&nbsp;b\t\nc</p>": "a b c",
    "<p>&lt;p&gt; &amp;amp; &#233;&#xe9; &eacute &am &copy</p>": "<p> &amp; éé é &am ©",
    "<p>one<br>two<b>th</b>ree</p>": "one twothree",
    "<p>x<!-- <p>no --> y<!-- open <p>z": "x y",
    "<p>x<script>var t='</p>'</script>y<style>p{}</style></p>": "x y",
    "<article>a<p>b<div>c</div></span>d": "a\nb\nc\nd",
    "<p title='a>b' class=\"x>y\">t</p>": "t",
    "<p>ok</p><p title=\"open>lost</p><p>more": "ok\nlost\nmore",
    "<p>ok</p><a href": "ok",
    "<P>UP<BR/>per</P><INPUT value='<p>x'>": "UP per",
    "<article data-id='comment-5' data-class=ad><p>kept</article>": "kept",
    "<p>日本語のテキスト。</p>": "日本語のテキスト。",
}


def test_odd_pages(spark):
    rows = [(i, None if i % 2 else f"u{i}", p) for i, p in enumerate(ODD)] + [(1, "u", "<p>same"), (1, "u", "<p>same")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit("mine")).withColumn("n_chars", F.lit(1))
    got = htmltext.extraction_report(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    expected = [(i, u, (t := ODD.get(p, "same")), len(t)) for i, u, p in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert htmltext.extraction_report(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("part", ["<", "<a ", "<p title=\"", "<p title='x", "<div>", "<h1>x", "</p>", "<!--", "<script>", "<td>a", "&", "&#", "<ul><li>x", "x <b>y ", "<a href=1>x", "= ' \" "])
def test_time_grows_with_the_page(part):
    began = time.perf_counter()
    htmltext.judged("<p>" + part * 100_000 + "</p>", htmltext.learned())
    assert time.perf_counter() - began < 15


def test_query_finds_the_articles(spark, sf_dir):
    """In the given pages the main text is the article, and nothing else."""
    rows = queries.op11_htmltext(spark, sf_dir).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages) > 10

    def article(page):
        inner = page[page.index("<article>") + 9 : page.rindex("</article>")]
        parts = re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", re.sub("</?b>", "", inner)))
        return "\n".join(t for p in parts if (t := " ".join(html.unescape(p).split())))

    for r in rows:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_blocks_say_why(spark):
    df = spark.createDataFrame([(1, "u", LAYOUTS["names"][0]), (2, "u", None)], SCHEMA)
    rows = htmltext.page_blocks(df).orderBy("place").collect()
    assert [r.text for r in rows if r.main] == LAYOUTS["names"][1]
    assert rows[0].text == "Home | About us" and (rows[0].words, rows[0].linked) == (4, 3) and not rows[0].main


def test_the_tree_splits_as_an_exhaustive_search():
    rng = np.random.default_rng(4)
    rows, labels = rng.integers(0, 4, (40, 3)).astype(float), rng.integers(0, 2, 40).astype(float)
    tree = htmltext.fit_tree(rows, labels, most_depth=1)

    def impurity(y):
        return len(y) * y.mean() * (1 - y.mean()) if len(y) else 0.0

    costs = {(f, t): impurity(labels[rows[:, f] <= t]) + impurity(labels[rows[:, f] > t]) for f in range(3) for t in (0.5, 1.5, 2.5) if 2 <= (rows[:, f] <= t).sum() <= 38}
    assert costs[int(tree.feature[0]), float(tree.threshold[0])] == pytest.approx(min(costs.values()))
    low = rows[:, int(tree.feature[0])] <= tree.threshold[0]
    assert np.allclose(tree.predict(rows), np.where(low, labels[low].mean(), labels[~low].mean()))


def test_pages_left_out_of_the_table_are_told_apart():
    pages = LABELLED.strip().split("\n\n")
    right = total = 0
    for i in range(0, len(pages), 3):
        tree = htmltext.fit_tree(*htmltext.labelled_rows("\n\n".join(pages[:i] + pages[i + 3 :])))
        rows, labels = htmltext.labelled_rows("\n\n".join(pages[i : i + 3]))
        right += int(((tree.predict(rows) >= 0.5) == labels).sum())
        total += len(labels)
    assert right / total > 0.85
