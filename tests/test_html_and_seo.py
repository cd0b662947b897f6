import html as stdlib_html
import random
import re
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitescope.functions import html as H
from sitescope.functions.seo import alt_coverage, is_indexable, seo_grade
from sitescope.operators import seo_scan

RICH = """<!DOCTYPE html><html><head><title>
  Harbour Bakery &mdash; Fresh &amp; warm </title>
<meta name='description' content="Bread baked each morning, delivered before eight o'clock, all week.">
<META CONTENT="Index, Follow" NAME="robots">
<meta name="robots" content="noindex">
<link rel="stylesheet" href="/s.css"><link href=' https://bakery.example/?a=1&amp;b=2 ' rel="alternate canonical">
<meta property="OG:title" content="x"><meta name="twitter:card" content="summary">
<script type="application/ld+json">{"@type":"Bakery","x":"<h1>no</h1><img src=x>"}</script>
<style>h1{color:red}</style></head><body><!-- <h1>hidden</h1> <a href="/hidden">x</a> -->
<h1 class="a">Hello</h1><h2>One</h2><H2>Two</H2><h20>not</h20><header>x</header>
<img src="a.png" alt="loaf > bun"><img src=b.png><img alt='  ' src="c.png"/>
<a href="/about">About</a><a title="a > b" href='https://WWW.bakery.example/c'>C</a>
<a href="https://other.example/">O</a><a href="//cdn.example/x">D</a><a href="mailto:x@y.example">M</a>
<a name="no-href">N</a><a href="rel/page">R</a><p>two&nbsp;words<b>joined</b>up</p></body></html>"""

BROKEN = [
    "",
    "<html><head><title>never closed",
    "<<>><div class=</div><a href=>>",
    "plain &&& text \x00 here",
    "<html>" * 500,
    "<a " + "x=y " * 20000 + ">",
    '<img alt="' + "z" * 50000,
    "<!-- open",
    "<script>var a = 1",
    "<p class=it's>don't</p><img src='a' alt=''>",
]


def signals(spark, page, url="https://bakery.example/"):
    frame = spark.createDataFrame([(url, page)], "url string, html string")
    return seo_scan.with_score(seo_scan.seo_signals(frame)).first().asDict()


def test_rich_page(spark):
    s = signals(spark, RICH)
    assert s["title"] == "Harbour Bakery — Fresh & warm"
    assert s["meta_description"].startswith("Bread baked") and "o'clock" in s["meta_description"]
    assert s["meta_robots"] == "Index, Follow"  # only the first robots tag counts
    assert s["canonical"] == "https://bakery.example/?a=1&b=2"
    assert (s["h1_count"], s["h2_count"]) == (1, 2)
    assert s["has_open_graph"] and s["has_twitter_card"] and s["has_structured_data"] and s["has_ssl"]
    assert (s["images_total"], s["images_missing_alt"]) == (3, 2)
    assert (s["internal_links"], s["external_links"]) == (3, 1)
    assert s["is_indexable"] and s["grade"] == "A"
    # 18 + 15 + 12 + 10 + 10 + 8 + 8 + 9 + 6/3 + 4
    assert s["score"] == 96.0


@pytest.mark.parametrize("page", BROKEN)
def test_broken_pages_never_fail(spark, page):
    s = signals(spark, page)
    assert s["images_total"] >= 0 and 0 <= s["score"] <= 100


def test_empty_http_page_scores_sixteen(spark):
    s = signals(spark, None, "http://x.example/")
    assert (s["score"], s["grade"], s["word_count"]) == (16.0, "F", 0)


def test_noindex_and_partial_points(spark):
    page = '<head><title>Short</title><meta name="robots" content="NOINDEX"><meta name="description" content="tiny"></head><h1>a</h1><h1>b</h1>'
    s = signals(spark, page, "http://x.example/")
    assert not s["is_indexable"]
    assert s["score"] == 9 + 7.5 + 6 + 6


def test_json_ld_inside_comment_does_not_count(spark):
    assert not signals(spark, '<!-- <script type="application/ld+json">{}</script> -->')["has_structured_data"]
    assert signals(spark, "<script type=application/ld+json>{}</script>")["has_structured_data"]


def test_blank_title_is_kept_by_records_only(spark):
    frame = spark.createDataFrame([("<title>  </title>",), ("<p>none</p>",)], "h string")
    got = [r.t for r in frame.select(H.raw_title(F.col("h")).alias("t")).collect()]
    assert got == ["", None]
    assert signals(spark, "<title>  </title>")["title"] is None


def test_grades_and_coverage(spark):
    scores = [(0.0, "F"), (39.99, "F"), (40.0, "D"), (60.0, "C"), (75.0, "B"), (90.0, "A"), (100.0, "A"), (100.5, None), (-1.0, None), (None, None)]
    frame = spark.createDataFrame(scores, "s double, g string")
    assert all(r.g == r.x for r in frame.select("g", seo_grade(F.col("s")).alias("x")).collect())
    frame = spark.createDataFrame([(0, 0, 1.0), (4, 1, 0.75)], "t int, m int, want double")
    assert all(r.want == r.got for r in frame.select("want", alt_coverage(F.col("t"), F.col("m")).alias("got")).collect())
    frame = spark.createDataFrame([(None, True), ("all", True), ("x, NoIndex", False)], "r string, want boolean")
    assert all(r.want == r.got for r in frame.select("want", is_indexable(F.col("r")).alias("got")).collect())


def test_entities_agree_with_standard_library(spark):
    pieces = ["&amp;", "&lt;", "&#233;", "&#x20AC;", "&eacute;", "&nope;", "&", ";", "amp;", "&amp", "x", " ", "&#0;", "&#xD800;", "&hellip;", "&#146;", "&#150", "&#129;", "&check;"]
    pieces += ["&NewLine;", "&copy x", "&notit;", "&#00000065;", "&#x0000041;", "&#99999999999999999999;", "&#x110000;", "&#1;", "&#xfdd0;", "&#xFFFF", "&#", "&#x", "&#xg", "#65;", "&acE;"]
    rng = random.Random(4)
    texts = [*pieces, *("".join(rng.choices(pieces, k=rng.randint(2, 9))) for _ in range(400))]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for row in frame.select("t", H.decode_entities(F.col("t")).alias("d")).collect():
        assert row.d == stdlib_html.unescape(row.t), row.t


def test_names_without_semicolon_stay_in_titles_and_attributes(spark):
    """A title cut off inside a reference, and a query whose parameters look like references."""
    page = "<title>Fish &amp; chips &#38 the&&&amp</title><link rel=canonical href='https://x.example/?a=1&copy=2&amp;b=3'>"
    s = signals(spark, page, "http://x.example/")
    assert (s["title"], s["canonical"]) == ("Fish & chips & the&&&amp", "https://x.example/?a=1&copy=2&b=3")
    frame = spark.createDataFrame([("<title>en.&&&amp</title>",)], "t string")
    assert frame.select(H.raw_title(F.col("t"))).first()[0] == "en.&&&amp"


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def test_word_counts_of_whole_pages_agree_with_a_parser(spark, sf_dir):
    from sitescope.sources import bindings as B

    pages = B.crawled_pages(spark, sf_dir).filter("html is not null").select("page_id", "url", "html")
    got = {r.page_id: r.word_count for r in seo_scan.seo_signals(pages).select("page_id", "word_count").collect()}
    for row in pages.collect():
        parser = _Text()
        parser.feed(row.html)
        assert got[row.page_id] == len(" ".join(parser.parts).split()), row.page_id


def test_homepage_pick_and_vitals(spark):
    data = [
        (1, 20, 5, "https://a.example/x", "other", "<p>x</p>"),
        (1, 10, 9, "https://a.example/", "home", None),
        (1, 20, 7, "https://b.example/", "home", "<title>Home page two</title>"),
        (2, 30, 2, "https://c.example/z", "other", None),
        (2, 30, 1, "https://c.example/y", "other", None),
        (3, 40, 4, "https://d.example/b", "blog", "<p>b</p>"),
        (3, 40, 3, "https://d.example/a", "home", None),
    ]
    pages = spark.createDataFrame(data, "company_id long, domain_id long, page_id long, url string, page_type string, html string")
    picked = {r.company_id: r.page_id for r in seo_scan.homepage_keys(pages).collect()}
    assert picked == {1: 7, 2: 1, 3: 4}
    vitals = spark.createDataFrame([("https://b.example/", 1200, 0.1, 90)], "url string, lcp_ms int, cls double, inp_ms int")
    got = {r.company_id: (r.url, r.cwv_lcp_ms, r.cwv_cls) for r in seo_scan.seo_scan(pages, vitals).collect()}
    assert got == {
        1: ("https://b.example/", 1200, 0.1),
        2: ("https://c.example/y", None, None),
        3: ("https://d.example/b", None, None),
    }
    assert {r.cwv_lcp_ms for r in seo_scan.seo_scan(pages).collect()} == {None}
