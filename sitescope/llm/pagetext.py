"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with the path of block elements from the
root. For every path, text length, punctuation and link text are added up over its
blocks; the ratios of text and of punctuation per block are smoothed along the page,
fused, and paths under the threshold or mostly of links are no content. All blocks count
for the ratios, also where a page marks its content (article, main); the marks are a bonus:
the marked text is the article, whole, unless content outside it is longer than twice the
marked content and ``BONUS`` characters more. Else the container is the deepest element that
holds all unmarked content; all its blocks from the first to the last of content come along
(headings, short paragraphs, lists of links), and before and after them all but paths of links.

Elements that are never text (scripts, styles, comments, buttons) and landmarks of the frame (nav,
footer) are left out with all below. Other elements may be named as frame: by their kind (aside,
form, header), or by a class, id or role that consists of words of the frame and of words of
layout only, so ``sidebar-left`` is one and ``no-sidebar`` or ``comments-open`` is not. Such a name is
evidence and no verdict: an element that holds most text with the page's h1 or main keeps it, or nearly
all where no other part has a heading or mark, and so does the longest article of a page without
another mark. Inline elements so named are left out alone.

A null or empty page, or one without text, gives an empty string. Unclosed tags end where
their parent ends, paragraphs at the next block; a page that breaks off is read as far as it
goes. Time and memory are in proportion to the page, however deep or broken it is.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from sitescope.llm.common import arrow_rows, widened

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|select)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^<>]*>|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
_MARK = re.compile(r"(?<![\w-])(?P<key>class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_FRAME = frozenset("button datalist footer head menu nav noscript object option".split())
_OFTEN_FRAME = frozenset("aside dialog fieldset form header".split())
_ENDS_P = _BLOCKS - {"html", "body"}
_CONTAINERS = frozenset("address article aside blockquote body center details div dl fieldset figure footer form header main nav ol pre section table ul".split())
#: Names of frame parts, roles of landmarks, and words of layout that say nothing.
_WORDS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr masthead menu nav navbar navigation newsletter notice notices outbrain pagination popup promo promoted promotion "
    "related reply replies respond share sharing sidebar skip social sponsor sponsored subscribe taboola toolbar widget widgets".split()
)
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
_LAYOUT = frozenset(
    "area article author bar block body bottom box button buttons col column container content custom desktop entry fixed form global google "
    "group header icon icons inner item items left link links list lg main md meta mobile outer page panel post posts primary right row "
    "secondary section site slot sm small sticky tertiary text title top unit wrap wrapper".split()
)
_CONTENT = frozenset("article main".split())
#: Text outside the marks is the content if it is longer than so many times the marked text and so many characters.
BONUS = (2, 200)
#: Shares of all text from which an element is no frame, whatever its name: with the page's h1 or main, and without.
MOST, NEARLY_ALL = 0.5, 0.9
#: Parts of running text, lists and tables; the container is never one of them.
_PARTS = frozenset("p li h1 h2 h3 h4 h5 h6 td th tr tbody thead tfoot table ul ol dl blockquote pre dd dt".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


class _Element:
    """``order`` and ``last`` number the elements from itself to the last below it; ``named`` is the nearest one named as frame."""

    __slots__ = ("name", "path", "parent", "out", "content", "article", "named", "order", "last", "chars", "heads", "hidden")

    def __init__(self, name, path, parent, order):
        self.name, self.path, self.parent, self.order, self.last = name, path, parent, order, order
        self.out = parent is not None and parent.out
        self.content = name in _CONTENT or parent is not None and parent.content
        self.article = name == "article" or parent is not None and parent.article
        self.named = parent.named if parent is not None else None
        self.chars, self.heads, self.hidden = 0, False, False


def _named_frame(rest: str) -> bool:
    """Whether class, id or role names a part of the frame: all its words are of frame or layout, one at least of frame."""
    for m in _MARK.finditer(rest):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            if m["key"].lower() == "role":
                if name in _ROLES:
                    return True
                continue
            parts = [x for x in re.split(r"[-_]+", name) if x and not x.isdigit()]
            if not _WORDS.isdisjoint(parts) and all(x in _WORDS or x in _LAYOUT for x in parts):
                return True
    return False


def blocks(page: str) -> list[list]:
    """[element, text, link text length] of every block outside the frame, in page order."""
    paths: dict[tuple, int] = {}
    root = _Element("", 0, None, 0)
    elements, open_ = [root], Counter()
    at, found, parts, linked, links = root, [], [], 0, 0
    hidden, depth, under = "", 0, root  # an inline element of the frame: its name, how often it is open, where it stands

    def close():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text and not at.out:
            found.append([at, text, linked])
        parts, linked = [], 0

    def put(raw):
        nonlocal linked
        if not at.out and raw and not hidden:
            text = html.unescape(raw)
            parts.append(text)
            if links:
                linked += len(text.strip())

    def leave(element):
        """All that is open below ``element`` ends."""
        nonlocal at, hidden
        while at is not element:
            open_[at.name] -= 1
            if at is under:
                hidden = ""
            at = at.parent

    def without(names):
        """Ends the nearest open element of these names, if only its own kind stands between."""
        if any(open_[n] > 0 for n in names):
            up = at
            while up is not root and up.name not in names and up.name not in _CONTAINERS:
                up = up.parent
            if up is not root and up.name in names:
                leave(up.parent)

    place = 0
    for m in _TOKEN.finditer(page):
        put(page[place : m.start()])
        place = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m["raw"]:
                parts.append(" ")
        elif name in ("br", "hr", "img"):
            parts.append(" ")
        elif name in _VOID:
            continue
        elif name not in _BLOCKS and name not in _FRAME:
            if name == "a":
                links = max(0, links - 1) if m["end"] else links + 1
            if hidden:
                if name == hidden:
                    depth += -1 if m["end"] else 1
                    hidden = hidden if depth else ""
            elif not m["end"] and not m["rest"].endswith("/") and _named_frame(m["rest"]):
                parts.append(" ")
                hidden, depth, under = name, 1, at
        elif m["end"]:
            if open_[name] > 0:
                up = at
                while up.name != name:
                    up = up.parent
                close()
                leave(up.parent)
                links = 0
        else:
            close()
            links = 0
            if name in _ENDS_P:
                without(("p",))
            if name in ("li", "dd", "dt", "tr", "td", "th"):
                without({"td": ("td", "th"), "th": ("td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt")}.get(name, (name,)))
            inside_article = at.article
            at = _Element(name, paths.setdefault((at.path, name), len(paths) + 1), at, len(elements))
            elements.append(at)
            open_[name] += 1
            at.out = at.out or name in _FRAME
            often = name in _OFTEN_FRAME and not (name == "header" and inside_article)
            if not at.out and name not in ("html", "body", "main") and (often or _named_frame(m["rest"])):
                at.named = at
            if name in ("h1", "main") and at.named is not None:
                at.named.heads = True
    tail = page[place:]
    if re.match(r"<[A-Za-z/!]", tail):
        tail = ""  # a tag that breaks off
    else:
        tail = re.sub(r"<[A-Za-z/!][^<>]*+\Z", "", tail, flags=re.S)
    put(tail)
    close()
    _judge(elements, found)
    return [b for b in found if b[0].named is None or not b[0].named.hidden]


def _judge(elements: list[_Element], found: list[list]) -> None:
    """Sets the last element below each, and which of those named as frame are hidden."""
    for element, text, linked in found:
        if element.named is not None:
            element.named.chars += len(text) - linked
    total = sum(len(text) - linked for _, text, linked in found)
    named = [e for e in elements if e.named is e]
    for e in reversed(elements[1:]):
        e.parent.last = max(e.parent.last, e.last)
    for e in reversed(named):
        if e.parent.named is not None:
            e.parent.named.chars += e.chars
            e.parent.named.heads |= e.heads
    longest = max((e for e in named if e.name == "article"), key=lambda e: e.chars, default=None)
    marked = any(e.content and e.named is None for e, _, _ in found)
    headed = marked or any(e.name == "h1" and e.named is None for e, _, _ in found)
    for e in named:
        kept = e.chars >= NEARLY_ALL * total and not headed or e.chars > MOST * total and e.heads or e is longest and not marked
        above = e.parent.named
        e.hidden = not kept or above is not None and above.hidden


def _smoothed(values: list[float]) -> list[float]:
    """Gaussian mean over two neighbours on each side."""
    kernel = [math.exp(-(k * k) / 2) for k in range(-2, 3)]
    out = []
    for i in range(len(values)):
        pairs = [(w, values[i + k]) for k, w in zip(range(-2, 3), kernel, strict=True) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in pairs) / sum(w for w, _ in pairs))
    return out


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, joined by empty lines."""
    found = blocks(page) if page else []
    if not found:
        return ""
    sums: dict[int, list[float]] = {}
    for element, text, linked in found:
        s = sums.setdefault(element.path, [0, 0, 0, 0])
        for i, value in enumerate((1, len(text), len(_PUNCTUATION.findall(text)), linked)):
            s[i] += value
    ratio = {p: (chars / n, marks / n) for p, (n, chars, marks, _) in sums.items()}
    text_ratio = _smoothed([ratio[e.path][0] for e, _, _ in found])
    mark_ratio = _smoothed([ratio[e.path][1] for e, _, _ in found])
    fused = [t * (1 + m) for t, m in zip(text_ratio, mark_ratio, strict=True)]
    least = 0.1 * sum(fused) / len(fused)
    best: dict[int, float] = {}
    for (element, _, _), f in zip(found, fused, strict=True):
        best[element.path] = max(best.get(element.path, 0), f)
    linkish = {p for p, s in sums.items() if s[3] > 0.5 * s[1]}
    content = {p for p in sums if best[p] >= least and p not in linkish} or set(sums)

    marked = [e.content for e, _, _ in found]
    sides = [sum(len(text) for (e, text, _), m in zip(found, marked, strict=True) if m == side and e.path in content) for side in (False, True)]
    if any(marked) and sides[0] <= BONUS[0] * sides[1] + BONUS[1]:
        return "\n\n".join(text for (_, text, _), m in zip(found, marked, strict=True) if m)

    places = [i for i, (e, _, _) in enumerate(found) if e.path in content and not marked[i]]
    low, high = (pick(found[i][0].order for i in places) for pick in (min, max))
    inside = found[places[0]][0]
    while not inside.order <= low <= high <= inside.last or inside.parent is not None and inside.name in _PARTS:
        inside = inside.parent
    kept = []
    for i, (element, text, _) in enumerate(found):
        within = inside.order <= element.order <= inside.last
        if within and (places[0] <= i <= places[-1] or element.path not in linkish):
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of ``page`` in place of it, and its length in code points.

    Columns named ``text`` or ``n_chars`` are replaced; every row stays.
    """
    arrow_rows(pages.sparkSession, 200)
    kept = pages.drop(*[c for c in (text, "n_chars") if c != page])
    place = kept.columns.index(page)

    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(place).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != place]
            names = [n for i, n in enumerate(batch.schema.names) if i != place]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), lengths], [*names, text, "n_chars"])

    return kept.mapInArrow(run, widened(kept.drop(page), **{text: "string", "n_chars": "long"}))


def extracted_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    return extract(pages.select("page_id", "url", "html"))
