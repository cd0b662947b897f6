"""Pages with known articles."""

import re
import time

from sitescope.llm import pagetext
from sitescope.llm.common import read


def test_whole_table(spark):
    pages = {r.page_id: r.html for r in read(spark, "/root/testdata/sf0.01", "pages").collect()}
    rows = pagetext.extracted_pages(read(spark, "/root/testdata/sf0.01", "pages")).collect()
    assert len(rows) == len(pages)
    import html

    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


SENTENCES = "The first sentence of a paragraph, which is long enough. Another follows it; and a third."


def test_frames_without_an_article_element():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body class="page">
    <header><h1>Site</h1></header><div id="main-menu"><a href=x>One</a> <a href=y>Two</a></div>
    <div class="cookie-notice">We use cookies, and more cookies. Accept them, please.</div>
    <div class="content"><h2>A short &amp; small heading</h2><p>{SENTENCES}<p>Short.<ul><li>point one<li>point  two</ul>
    <script>var x = "<p>no</p>";</script><form><label>Mail, name, and more.</label><input></form><!-- <p>no</p> -->
    <p>a &lt;b&gt; c&nbsp;&nbsp;d<br>e<b>f</b>g</p><div class="ad">Buy, buy, buy!</div></div>
    <aside>{SENTENCES}</aside><div id="comments"><p>{SENTENCES}</p></div><footer>&copy; {SENTENCES}</footer></body></html>"""
    want = ["A short & small heading", SENTENCES, "Short.", "point one", "point two", "a <b> c d efg"]
    assert pagetext.main_text(page) == "\n\n".join(want)


def test_small_articles_beat_large_frames():
    for text in ("That it.", "x"):
        page = f"<body><nav>{SENTENCES}</nav><div>{SENTENCES}</div><article><h1>{text}</h1><p><b>{text}<br></article><div>{SENTENCES}</div>"
        assert pagetext.main_text(page) == f"{text}\n\n{text}"


def test_broken_and_plain_pages():
    assert [pagetext.main_text(x) for x in (None, "", "   ", "<p></p>", "<script>x", "<!-- x", "<nav>x</nav>")] == [""] * 7
    assert pagetext.main_text("plain text &eacute; a < b") == "plain text é a < b"
    assert pagetext.main_text("<article><p>one<p>two <a hre") == "one\n\ntwo"
    assert pagetext.main_text("<article><p title='a > b'>one</p></div></section><p>two</article>") == "one\n\ntwo"
    assert pagetext.main_text("<article>" + "<div>" * 3000 + "deep, deep.") == "deep, deep."
    long = "word, " * 200_000
    assert pagetext.main_text(f"<article><p>{long}</article>") == long.strip()


def test_nothing_of_an_article_is_dropped():
    """Headings and leads outside the body's div, sections, long lists and tables, references."""
    long = "".join(f"<p>{SENTENCES} {SENTENCES}</p>" for _ in range(30))
    body = ["Title", "Lead.", *[f"{SENTENCES} {SENTENCES}"] * 30]
    inner = f"<h1>Title</h1><p>Lead.</p><div>{long}</div>"
    refs = "<ul>" + "".join(f"<li><a href=x>Reference {i}</a></li>" for i in range(9)) + "</ul>"
    named = [f"Reference {i}" for i in range(9)]
    for page in ("<article>{}</article>", "<main>{}</main>", "<div class=page>{}</div>"):
        assert pagetext.main_text(page.format(inner)) == "\n\n".join(body)
        assert pagetext.main_text(page.format(f"<section><h2>A</h2><p>Short, but text.</p></section><section>{long}</section><section><p>End.</p></section>")) == "\n\n".join(["A", "Short, but text.", *body[2:], "End."])
        for a, b in (("<ul>", "</ul>"), ("<table>", "</table>")):
            items = long.replace("<p>", "<li>" if a == "<ul>" else "<tr><td>").replace("</p>", "")
            assert pagetext.main_text(page.format(f"<p>Before, all of it.</p>{a}{items}{b}<p>After.</p>")) == "\n\n".join(["Before, all of it.", *body[2:], "After."])
        assert pagetext.main_text(page.format(f"<p>{SENTENCES}</p>{refs}<p>{SENTENCES}</p>")) == "\n\n".join([SENTENCES, *named, SENTENCES])
    assert pagetext.main_text(f"<article><p>{SENTENCES}</p>{refs}</article>") == "\n\n".join([SENTENCES, *named])


def test_a_teaser_is_not_the_text():
    """The article element is a bonus; it does not outweigh a whole text elsewhere."""
    text = "".join(f"<p>{SENTENCES}</p>" for _ in range(12))
    want = "\n\n".join([SENTENCES] * 12)
    teaser = "<article class=card><h3>More</h3><p>A short teaser, no more.</p></article>"
    for page in (f"<body>{teaser}<div id=content>{text}</div>", f"<body><div id=content>{text}</div>{teaser}{teaser}"):
        assert pagetext.main_text(page) == want
    assert pagetext.main_text(f"<body><div>{SENTENCES}</div><article>{text}</article><div>{SENTENCES}</div>") == want
    within = pagetext.main_text(f"<body><div id=content>{text}{teaser}{text}</div>")
    assert within == "\n\n".join([want, "More", "A short teaser, no more.", want])


def test_whole_table_without_marks(spark):
    """The ratios alone find the same text when no element is called article."""
    rows = read(spark, "/root/testdata/sf0.01", "pages").collect()
    same = 0
    for r in rows:
        bare = re.sub("<(/?)article>", r"<\1div>", r.html)
        same += pagetext.main_text(bare) == pagetext.main_text(r.html)
    assert same >= 0.97 * len(rows)


def test_class_words_are_no_verdict():
    """Words of the frame as parts of other names, and names around all of the text."""
    text = "".join(f"<p>{SENTENCES}</p>" for _ in range(5))
    want, rest = "\n\n".join([SENTENCES] * 5), f'<div id="comments"><p>{SENTENCES}</p></div><footer>x</footer>'
    for name in ("site no-sidebar", "layout-with-sidebar", "post comments-open", "social-science", "ad-free", "skip-lazy", "notice-of-appeal", "has-related-posts"):
        for inner in (f"<article>{text}</article>", text):
            assert pagetext.main_text(f'<body><nav><a>m</a></nav><div class="{name}">{inner}</div>{rest}') == want, name
    assert pagetext.main_text(f'<article class="post comment-status-open">{text}</article>{rest}') == want
    assert pagetext.main_text(f'<article class="widget">{text}</article>{rest}') == want
    assert pagetext.main_text(f'<form id="page"><h1>T</h1>{text}</form><div class="ad">Buy, buy.</div>') == f"T\n\n{want}"
    assert pagetext.main_text(f'<body><div class="widget">{text}</div>') == want
    assert pagetext.main_text(f'<body data-id="sidebar"><div id=\'main\' data-class="ad">{text}</div>') == want


def test_frames_by_whole_names():
    for name in ('id="respond"', 'class="adsbygoogle"', "class=sidebar-left", 'class="x post-comments"', 'role="complementary"', 'class="cookie-notice box"', 'id="nav-2"'):
        assert pagetext.main_text(f"<body><div><h1>T</h1><p>{SENTENCES}</p></div><div {name}><p>{SENTENCES}</p></div>") == f"T\n\n{SENTENCES}", name
    inline = 'One, two <span class="ad">BUY <span>more</span> now</span>three<b class="share-button"> S</b>.'
    assert pagetext.main_text(f"<article><p>{inline}</p><p>End, <i class=ad>not closed.</p><p>Last.</p></article>") == "One, two three .\n\nEnd,\n\nLast."
    long = f"<p>{SENTENCES}</p>" * 30
    assert pagetext.main_text(f'<article><h1>A</h1><p>Short, text.</p></article><div id="comments">{long}</div>') == "A\n\nShort, text."


def test_time_is_in_proportion():
    """Deep, broken and repetitive pages of up to a megabyte."""
    begin = time.perf_counter()
    pages = {
        "<script " * 130_000: "", "<div>" * 50_000 + "deep, deep." + "</div>" * 50_000: "deep, deep.", "<div>" * 50_000 + "</section>" * 50_000 + "a, b.": "a, b.",
        "<!" * 500_000: "", '<p a="' * 150_000: "", "<!--" * 200_000: "",
    }
    for page, want in pages.items():
        assert pagetext.main_text(page) == want
    for part in ("<div>word, ", "<h1><p>w, ", "<ul><li>x, ", '<div class="sidebar">x, ', '<span class="ad">'):
        pagetext.main_text(part * 30_000)
    assert time.perf_counter() - begin < 30


def test_edges(spark):
    rows = [(1, None, None, "t", 1), (None, "u", "", "t", 1), (2, "u", "<p>a, b.</p>", "t", 1), (2, "u", "<p>a, b.</p>", "t", 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    assert sorted(((r.page_id or 0), r.text, r.n_chars) for r in pagetext.extract(frame).collect()) == [(0, "", 0), (1, "", 0), (2, "a, b.", 5), (2, "a, b.", 5)]
    assert pagetext.extracted_pages(frame.limit(0)).count() == 0
