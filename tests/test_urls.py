from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from sitescope.functions import urls as U

BASES = [
    "https://acme.example/",
    "https://acme.example",
    "http://www.acme.example/a/b/c.html?x=1#f",
    "https://acme.example/a/b/",
    "https://acme.example:8080/dir/page;v=1?q",
]
HREFS = [
    "about",
    "/about-us",
    "./x",
    "../x",
    "../../../x/y",
    "a/./b/../c",
    "a//b///c",
    "/a/../b/./c/..",
    "/a/b/.",
    "..",
    ".",
    "?q=1",
    "?a=/x/../y",
    "//cdn.example/lib.js",
    "https://other.example/p?q#f",
    "http://acme.example/plain",
    "ftp://files.example/x",
    "data:text/plain,hi",
    "page#frag",
    "/p?x=1#y",
    "sub/dir/",
    "x;p=1/y",
]


def test_resolve_agrees_with_urljoin(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    frame = spark.createDataFrame(pairs, "base string, href string")
    got = frame.select("base", "href", U.resolve_url(F.col("base"), F.col("href")).alias("u")).collect()
    wrong = [
        (r.base, r.href, r.u, urldefrag(urljoin(r.base, r.href))[0])
        for r in got
        if r.u != urldefrag(urljoin(r.base, r.href))[0]
    ]
    assert wrong == []


@pytest.mark.parametrize(
    ("url", "kind"),
    [
        ("https://a.example/", "home"),
        ("https://a.example", "home"),
        ("https://a.example/?q=contact", "home"),
        ("https://a.example/about-us", "about"),
        ("https://a.example/CONTACT", "contact"),
        ("https://a.example/careers/engineer", "careers"),
        ("https://a.example/jobs", "careers"),
        ("https://a.example/blog/post-1", "blog"),
        ("https://a.example/privacy-policy", "privacy"),
        ("https://a.example/legal/terms", "terms"),
        ("https://a.example/photos", "terms"),
        ("https://a.example/products/x;about", "other"),
        ("https://a.example/about/careers", "careers"),
    ],
)
def test_page_types(spark, url, kind):
    frame = spark.createDataFrame([(url,)], "u string")
    assert frame.select(U.page_type_of(F.col("u")).alias("k")).first().k == kind


def test_url_and_hostname_normalisation(spark):
    urls = {
        " HTTPS://WWW.Acme.Example/Path/ ": "https://www.acme.example/Path",
        "http://acme.example//": "http://acme.example",
        "https://acme.example/a/;p?q=1#F": "https://acme.example/a;p?q=1#F",
        "ftp://acme.example/": None,
        "https:///nohost": None,
        "not a url": None,
    }
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    got = {r.u: r.n for r in frame.select("u", U.normalize_url(F.col("u")).alias("n")).collect()}
    assert got == urls
    hosts = {
        "  WWW.Acme.Example\n": "acme.example",
        "acme": None,
        "a b.example": None,
        "acme.example/x": None,
        "": None,
        "www.www.example": "www.example",
    }
    frame = spark.createDataFrame([(u,) for u in hosts], "u string")
    got = {r.u: r.n for r in frame.select("u", U.normalize_hostname(F.col("u")).alias("n")).collect()}
    assert got == hosts
    odd = spark.createDataFrame([("http://u:p@WWW.x.example:81/a b?c",)], "u string")
    row = odd.select(
        U.host_of(F.col("u")).alias("h"), U.host_of(F.lit("http://www.x.example/")).alias("w")
    ).first()
    assert (row.h, row.w) == ("u:p@www.x.example:81", "x.example")
