import random

from sitescope.operators.depth import crawl_depth, depth_summary, page_depths, site_links
from sitescope.operators.taxonomy import hierarchy, totals, within


def tree(spark, pairs):
    return spark.createDataFrame(pairs, "industry_id string, parent_id string")


def ancestors(pairs):
    above = {n: p for n, p in pairs}
    out = set()
    for node in above:
        at, depth = node, 0
        while at in above:
            out.add((at, node, depth))
            at, depth = above[at], depth + 1
    return out


def test_random_forest_and_long_chain(spark):
    rng = random.Random(4)
    pairs = [(f"n{i}", f"n{rng.randint(0, i - 1)}" if i % 9 else None) for i in range(1, 200)] + [("n0", "absent")]
    pairs += [(f"c{i}", f"c{i + 1}") for i in range(70)]
    found = hierarchy(tree(spark, pairs))
    got = [tuple(r) for r in found.closure.collect()]
    assert set(got) == ancestors(pairs) and len(got) == len(set(got))
    assert found.cycles.collect() == []


def test_cycles_are_reported_and_are_roots(spark):
    """A cycle of three, a node of itself, and chains that hang below them."""
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("s", "s"), ("t", "s"), ("x", None), ("y", "x"), (None, "x")]
    found = hierarchy(tree(spark, pairs))
    assert {r.node for r in found.cycles.collect()} == {"a", "b", "c", "s"}
    cut = [(n, None if n in "abcs" else p) for n, p in pairs if n]
    assert {tuple(r) for r in found.closure.collect()} == ancestors(cut)


def test_searches_include_children(spark):
    pairs = [("retail", None), ("apparel", "retail"), ("shoes", "apparel"), ("food", None)]
    closure = hierarchy(tree(spark, pairs)).closure
    rows = spark.createDataFrame([(1, "retail"), (2, "shoes"), (3, "food"), (4, None), (5, "apparel"), (6, "unknown")], "company_id long, industry_id string")
    ids = lambda wanted: sorted(r.company_id for r in within(rows, closure, wanted).collect())
    assert ids(["retail"]) == [1, 2, 5] and ids(["apparel", "retail", "food"]) == [1, 2, 3, 5] and ids(["none"]) == []
    assert {tuple(r) for r in totals(rows, closure).collect()} == {("retail", 1, 3), ("apparel", 1, 2), ("shoes", 1, 1), ("food", 1, 1)}
    assert hierarchy(tree(spark, pairs).limit(0)).closure.collect() == []


def walk(links, homes):
    seen, level, depth = {}, set(homes), 0
    while level:
        seen |= dict.fromkeys(level, depth)
        level = {(h, t) for h, u, t in links if (h, u) in level} - set(seen)
        depth += 1
    return seen


def test_depths_of_random_sites(spark):
    rng = random.Random(7)
    links = {(f"h{rng.randint(0, 3)}", f"u{rng.randint(0, 30)}", f"u{rng.randint(0, 30)}") for _ in range(160)}
    links |= {("h0", "u0", f"hub{i}") for i in range(200)} | {("h9", "u0", "u1"), ("h9", "u1", "u0")}
    homes = [(f"h{i}", "u0") for i in range(5)] + [("h9", "u0")]
    found = crawl_depth(spark.createDataFrame(sorted(links), "host string, url string, target string"), spark.createDataFrame(homes * 2, "host string, url string"))
    got = [((r.host, r.url), r.depth) for r in found.collect()]
    assert dict(got) == walk(links, homes) and len(got) == len(dict(got))


def test_chain_of_200_pages(spark):
    links = [("h", f"p{i}", f"p{i + 1}") for i in range(199)] + [("h", f"p{i}", f"p{i - 1}") for i in range(1, 199)]
    frame = spark.createDataFrame(links, "host string, url string, target string").coalesce(1)
    found = crawl_depth(frame, spark.createDataFrame([("h", "p0")], "host string, url string"))
    assert {(r.url, r.depth) for r in found.collect()} == {(f"p{i}", i) for i in range(200)}
    assert crawl_depth(frame, spark.createDataFrame([("h", "p0")], "host string, url string"), most=3).count() == 4


def test_pages_and_their_links(spark):
    page = lambda path, *hrefs: ("a.example", f"http://www.a.example{path}", "".join(f'<a href="{h}">x</a>' for h in hrefs))
    pages = [
        page("", "/one", "https://a.example/two/#part", "https://other.example/no"),
        page("/one", "two", "/", "/one"), page("/two/", "/three"), page("/lost", "/one"), ("b.example", "https://b.example/only", None),
    ]
    frame = spark.createDataFrame(pages, "host string, url string, html string")
    got = {(r.url.removeprefix("https://"), r.depth, r.crawled) for r in page_depths(frame, site_links(frame)).collect()}
    assert got == {
        ("a.example/", 0, True), ("a.example/one", 1, True), ("a.example/two", 1, True), ("a.example/three", 2, False), ("a.example/lost", None, True),
        ("b.example/", 0, False), ("b.example/only", None, True),
    }
    summary = {r.depth: (r.urls, r.crawled, r.hosts) for r in depth_summary(page_depths(frame, site_links(frame))).collect()}
    assert summary == {0: (2, 1, 2), 1: (2, 2, 1), 2: (1, 0, 1), None: (2, 2, 2)}
