from urllib.robotparser import RobotFileParser

from sitescope.operators import frontier, robots
from sitescope.operators.skew import rank_within

FILES = {
    "plain": "User-agent: *\nDisallow: /private\nCrawl-delay: 2\n",
    "empty-rule": "User-agent: *\nDisallow:\n",
    "all": "User-agent: *\nDisallow: /\n",
    "order": "User-agent: *\nAllow: /a/b\nDisallow: /a\nAllow: /a/c\n",
    "named": "User-agent: *\nDisallow: /\n\nUser-agent: SiteScope\nUser-agent: other\nDisallow: /x # why\nCrawl-delay: 0\n",
    "other-only": "User-agent: other\nDisallow: /\n",
    "two-defaults": "User-agent: *\nDisallow: /one\n\nUser-agent: *\nDisallow: /two\n",
    "dropped-agents": "User-agent: sitescope\n\nDisallow: /x\n\nUser-agent: *\nDisallow: /y\n",
    "no-blank": "User-agent: a\nDisallow: /x\nUser-agent: sitescope\nDisallow: /y\nSitemap: s\nDisallow: /z\n",
    "rules-first": "Disallow: /x\nUser-agent: *\nCrawl-delay: soon\nCrawl-delay: 5\nDisallow: /q?x=1\n",
    "escaped": "user-agent : *\r\ndisallow : /caf%C3%A9\r\nDisallow: /a+b\r\n",
    "token": "User-agent: scope\nDisallow: /t\n",
    "blank": "",
    "empty-query": "User-agent: *\nDisallow: /search?\nDisallow: /*?\n",
    "empty-params": "User-agent: *\nDisallow: /s;\nDisallow: /t/a;;\n",
    "bad-escape": "User-agent: *\nDisallow: /bad%20b\nDisallow: /e%3F\nDisallow: /h%23\n",
    "breaks": "User-agent: *\x0bDisallow: /v\x85Disallow: /w\u2028Disallow: /y\x1eAllow: /z",
    "only-sign": "User-agent: *\nAllow: /a\nDisallow: ?\n",
    "other-host": "User-agent: *\nDisallow: http://else.example/a\nDisallow: /b\n",
}
PATHS = ["", "/", "/private/data", "/privat", "/a", "/a/b/c", "/a/c", "/x", "/x/y", "/y", "/z", "/one", "/two", "/q?x=1&y", "/caf%C3%A9/x", "/a+b", "/t", "/p#/x", "/search/abc", "/*x", "/sb", "/t/a", "/t/a;;b", "/bad%20b%zz", "/e", "/h/x", "/v", "/w", "/b?", "/s;p?q"]


def policies(spark):
    return robots.robots_policies(spark.createDataFrame(list(FILES.items()), "host string, txt string"))


def test_gate_and_delay_agree_with_standard_parser(spark):
    urls = [(h, f"https://{h}{p}") for h in [*FILES, "absent"] for p in PATHS]
    frame = spark.createDataFrame(urls, "host string, url string")
    parsers = {}
    for name, text in FILES.items():
        parsers[name] = RobotFileParser()
        parsers[name].parse(text.splitlines())
    agent = robots.USER_AGENT
    for r in robots.robots_gate(frame, policies(spark)).collect():
        want = parsers[r.host].can_fetch(agent, r.url) if r.host in parsers else True
        assert r.allowed == want, (r.host, r.url)
    delays = {r.host: r.crawl_delay for r in policies(spark).collect()}
    for name, parser in parsers.items():
        assert delays.get(name) == parser.crawl_delay(agent), name


def test_polite_schedule(spark):
    queue = [("plain", i) for i in range(100)] + [("named", i) for i in range(100, 103)] + [("absent", 500)]
    frame = spark.createDataFrame(queue, "host string, page_id long")
    got = robots.polite_schedule(frame, policies(spark)).collect()
    starts = {(r.host, r.page_id): (r.delay_seconds, r.start_seconds) for r in got}
    assert len(got) == len(queue)
    assert starts["plain", 42] == (2.0, 84.0)
    assert starts["named", 102] == (1.0, 2.0)  # a zero delay counts as none
    assert starts["absent", 500] == (1.0, 0.0)


def test_rank_within_ranges(spark):
    data = [(k, i * i) for i in range(300) for k in ("a", None) if (i + (k is None)) % 3]
    frame = spark.createDataFrame(data, "k string, pos long")
    got = {(r.k, r.pos): r.rank for r in rank_within(frame, ["k"], "pos").collect()}
    for key in ("a", None):
        ordered = sorted(p for k, p in data if k == key)
        assert [got[key, p] for p in ordered] == list(range(1, len(ordered) + 1))


HOME = """<a href="/team">Team</a><a href="/contact">C</a><a href="/about-us#team">A</a><a href="/about-us">A2</a>
<a href="https://else.example/careers">E</a><a href=" jobs/open ">J</a><a href="/news">N</a><a href="/privacy">P</a>
<a href="/terms">T</a><a href="mailto:a@b.example">M</a><a href="#x">X</a><a href="">-</a><a href="/contact?x">C2</a>"""


def test_links_are_distinct_and_in_order(spark):
    frame = spark.createDataFrame([(1, "https://s.example/d/p", HOME)], "page_id long, url string, html string")
    got = [r.url for r in frontier.extract_links(frame).orderBy("pos").collect()]
    assert got == [
        "https://s.example/team",
        "https://s.example/contact",
        "https://s.example/about-us",
        "https://else.example/careers",
        "https://s.example/d/jobs/open",
        "https://s.example/news",
        "https://s.example/privacy",
        "https://s.example/terms",
        "https://s.example/contact?x",
    ]


def test_frontier(spark):
    homes = spark.createDataFrame([("s.example", HOME), ("e.example", None)], "host string, html string")
    everything = frontier.link_frontier(homes).orderBy("host", "pos").collect()
    assert [(r.host, r.page_type) for r in everything] == [
        ("e.example", "home"),
        ("s.example", "home"),
        ("s.example", "contact"),
        ("s.example", "about"),
        ("s.example", "careers"),
        ("s.example", "blog"),
        ("s.example", "privacy"),
        ("s.example", "terms"),
    ]
    text = "User-agent: *\nDisallow: /contact\n"
    gate = robots.robots_policies(spark.createDataFrame([("s.example", text)], "host string, txt string"))
    kept = frontier.link_frontier(homes, gate, max_pages=3).filter("host = 's.example'").orderBy("pos").collect()
    assert [r.page_type for r in kept] == ["home", "about", "careers"]  # a forbidden page takes no place
    closed = robots.robots_policies(spark.createDataFrame([("s.example", "User-agent: *\nDisallow: /\nAllow: /about-us\n")], "host string, txt string"))
    assert frontier.link_frontier(homes, closed).filter("host = 's.example'").count() == 0
