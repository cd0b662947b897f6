"""Rules against plain code; the model on hosts that its table does not hold."""

from sitescope.llm import urlfilter
from sitescope.llm.common import read
from sitescope.llm.queries import QUERIES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    name = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    way = rest[cut:]
    return name, way[: min([way.index(c) for c in "?#" if c in way], default=len(way))]


def ruled(name, way):
    found = [(len(d + p), d + p, v) for v, d, p in urlfilter.RULES if (name == d or name.endswith("." + d)) and way.startswith(p)]
    return max(found)[1:] if found else (None, None)


def test_whole_table(spark):
    urls = {r.page_id: r.url for r in read(spark, "/root/testdata/sf0.01", "pages").collect()}
    rows = QUERIES["op4_url_filter"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path) == parts(urls[r.page_id])
        rule, verdict = ruled(r.host, r.path)
        assert r.rule == rule and (verdict or r.verdict) == r.verdict
    free = [r for r in rows if r.rule is None and not any(w in r.host for w in urlfilter.UNWANTED if len(w) > 3)]
    assert sum(r.verdict == "allow" for r in free) > 0.97 * len(free) > 0


def test_model_on_unseen_hosts(spark):
    model = urlfilter.learn(urlfilter.labelled_urls(spark))
    bad = ["cheap-pills", "casino-win", "ads-track", "spam-farm", "free-bets", "adult-x", "bonus-slots", "hot-porn-cams", "viagra-deals", "lotteryjackpot"]
    good = ["riverschool", "oldlibrary", "thonend", "ereston", "citymuseum", "mathforum", "wintertravel", "gardenbooks", "lakehouse", "erthing"]
    urls = [f"http://{s}{h}.example.{e}/en/{i}" for i, h in enumerate(bad + good) for s in ("", "blog.") for e in ("net", "org")]
    rows = {r.url: r.verdict for r in urlfilter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), model, rules=()).collect()}
    wrong = [u for u in urls if rows[u] != ("block" if any(b in u for b in bad) else "allow")]
    assert len(wrong) <= 0.05 * len(urls), wrong


def test_longest_rule_and_edges(spark):
    urls = [None, "", "no scheme/x", "http://", "HTTP://WWW.Example.COM", "http://www.example.com/en/1", "http://a.example.com/en/", "http://example.com/en", "http://notexample.com/en/1"]
    urls += ["x://a.net/es/1", "x://a.net/es", "x://a.network/es/", "x://net/fr/?q", "x://ÄB.com/#f", "a?b://c.com/d", "http://x.com\n.net/fr/\ny"] + ["http://" + "a" * 50_000 + ".net/fr/"] * 2
    frame = spark.createDataFrame([(i, u, 1, "h") for i, u in enumerate(urls)], "page_id long, url string, rule int, host string")
    out = urlfilter.judge(frame, "allow").orderBy("page_id")
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    for r in out.collect():
        assert (r.host, r.path) == parts(r.url), r.url
        assert (r.rule, r.verdict) == (ruled(r.host, r.path)[0], ruled(r.host, r.path)[1] or "allow")
    assert urlfilter.judged_pages(frame).count() == len(urls)
    assert urlfilter.judged_pages(frame.limit(0)).count() == 0


def test_one_sided_tables(spark):
    rows = lambda *v: spark.createDataFrame([(f"http://{i}.net/", x) for i, x in enumerate(v)], "url string, verdict string")
    assert urlfilter.learn(rows()) == "allow"
    assert urlfilter.learn(rows("block", None, "block")) == "block"
