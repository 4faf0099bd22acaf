"""Main text of pages: hand-labelled layouts, broken mark-up, and a plain version for the tables' own template."""

import html
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from assayer.llm.pages import extract, main_text, path_scores
from assayer.llm.queries import op12_tag_path_text

LONG = "This is a sentence of the article, which has words, commas and a full stop. It goes on for a while; then it ends."
MORE = "A second paragraph follows, since one alone is rarely an article. It too has its commas, and its end."
AWAY = "Not part of it, though it is long, has commas and full stops. Readers skip it, as they should. It is here in every page."


def article(*blocks: str) -> str:
    return "\n".join(blocks)


LAYOUTS = {
    "article": (f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{LONG}<p>{MORE}</article><footer>{AWAY}</footer>", article("Title", LONG, MORE)),
    "site header": (f"<header><h1>Site</h1><p>{AWAY}</p></header><main><h2>T</h2><p>{LONG}</p></main>", article("T", LONG)),
    "header of the article": (f"<article><header><h1>T</h1></header><p>{LONG}</p><footer>{AWAY}</footer></article>", article("T", LONG)),
    "plain divs": (f"<div id=menu><a href=/1>One</a> <a href=/2>Two</a></div><div><h1>T</h1><div>{LONG}</div><div>{MORE}</div><div>Short.</div></div><div class='side-bar sidebar'>{AWAY}</div>", article("T", LONG, MORE, "Short.")),
    "unmarked menu": (f"<div><ul><li><a href=/1>One</a><li><a href=/2>Two</a><li><a href=/3>Three</a></ul></div><div><p>{LONG}</p><p>{MORE}</p></div>", article(LONG, MORE)),
    "table layout": (f"<table><tr><td><a href=/1>One</a><br><a href=/2>Two</a></td><td><p>{LONG}</p><p>{MORE}</p></td></tr></table>", article(LONG, MORE)),
    "comments": (f"<article><p>{LONG}</p><section id='comments'><article class=comment><p>{AWAY}</p></article></section></article>", LONG),
    "comment list": (f"<main><p>{LONG}</p><ol class='commentList'><li><p>{AWAY}</p></li></ol></main>", LONG),
    "notice": (f"<div class='cookie-notice'><p>{AWAY}</p></div><article><p>{LONG}</p></article><div role=dialog>{AWAY}</div>", LONG),
    "advert within": (f"<article><p>{LONG}</p><div class='ad'><p>{AWAY}</p></div><p>{MORE}</p></article>", article(LONG, MORE)),
    "advert in a line": (f"<article><p>{LONG} <span class=advert>Buy now!</span> {MORE}</p></article>", f"{LONG} {MORE}"),
    "form": (f"<article><p>{LONG}</p><form><p>{AWAY}</p><input value=x><button>Go</button></form></article>", LONG),
    "menu in the article": (f"<article><p>{LONG}</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul></article>", LONG),
    "list in the article": (f"<article><p>{LONG}</p><ul><li>One <a href=1>x</a> and more</li><li>Two</li><li><a href=3>Three</a></li></ul></article>", article(LONG, "One x and more", "Two", "Three")),
    "scripts": (f"<article><script>if (a</b) '<p>x</p>'</script><style>p{{}}</style><p>{LONG}</p><noscript>{AWAY}</noscript></article>", LONG),
    "unseen": (f"<article><p hidden>{AWAY}</p><div style='display: none'>{AWAY}</div><p>{LONG}</p><p aria-hidden=true>x</p></article>", LONG),
    "wide class names": (f"<body class='has-sidebar'><div class='content with-ads'><p>{LONG}</p><p>{MORE}</p></div></body>", article(LONG, MORE)),
    "similar names": (f"<div class='shadow loading adapter'><p>{LONG}</p></div>", LONG),
    "references": ("<article><p>a &lt;b&gt; &amp;amp; &#233;&#x4e2d;&nbsp;&hellip; &unknown; &copy 1</p></article>", "a <b> &amp; é中 … &unknown; © 1"),
    "white space": (f"<article><p>\n\t{LONG}\r\n  <b>bold</b><i>er</i> x<br>y </p></article>", f"{LONG} bolder x y"),
    "cut off": (f"<html><body><article><p>{LONG}</p><p>The end is miss", article(LONG, "The end is miss")),
    "cut in a tag": (f"<article><p>{LONG}</p><p>More<a href='x", article(LONG, "More")),
    "unclosed comment": (f"<article><p>{LONG}</p><!-- never closed <p>{AWAY}</p>", LONG),
    "quoted bracket": (f"<article><p title='a > b'>{LONG}</p></article>", LONG),
    "less-than": ("<article><p>1 < 2 and 3 <4, x<y too</p></article>", "1 < 2 and 3 <4, x"),
    "stray ends": (f"</div></b></article><article></p><p>{LONG}</b></span></p></article>", LONG),
    "only marked": (f"<nav>{AWAY}</nav><footer>{AWAY}</footer>", ""),
    "no tags": ("just words &amp; more\n words", "just words & more words"),
    "empty": ("", ""),
    "blank": (" \n ", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert extract(page) == want


def plain_version(page: str) -> str:
    """The template's article by patterns: its blocks end at each p and h1 tag."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", "", b.replace("<br>", " "))).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_query_equals_plain_version(spark):
    rows = duckdb.sql("SELECT page_id, url, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    want = {i: (u, plain_version(h)) for i, u, h in rows}
    got = op12_tag_path_text(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows) and {r["page_id"]: (r["url"], r["text"]) for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_nulls_repeats_clashing_columns_and_empty_table(spark):
    rows = [(1, None, None, "t"), (1, None, None, "t"), (None, "u", f"<p>{LONG}</p>", None), (2, "u", "", "row")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("row", F.lit(1))
    got = main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, None, "", 0), (1, None, "", 0), (None, "u", LONG, len(LONG)), (2, "u", "", 0)], key=str)
    assert main_text(pages.limit(0)).collect() == []
    assert main_text(pages, keep=("row", "html")).columns == ["row", "html", "text", "n_chars"]


@pytest.mark.parametrize("piece", ["<", "<a ", '<p "', "<!--", "<div>", "<b>", "<p>x", "<li>x", "</p>", "<div>x", "&amp;", "<div></b>", "<table><td><b></div>"])
def test_long_pages_take_linear_time(piece):
    began = time.perf_counter()
    extract(piece * 20_000)
    assert time.perf_counter() - began < 10


def test_a_long_page_is_read_whole():
    blocks = [f"Paragraph {i}, and its text." for i in range(20_000)]
    assert extract("<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>") == "\n".join(blocks)


def test_scores_fuse_text_and_punctuation_of_paths():
    assert path_scores([], [], [], []) == []
    # path 1: 30 characters and 3 marks in 2 blocks; path 2: all linked
    fused = (30 / 2) * (1 + 3 / 2)
    got = path_scores([1, 2, 1], [10, 4, 20], [1, 0, 2], [0, 4, 0])
    assert got == [0.75 * fused, 0.5 * fused, 0.75 * fused]
