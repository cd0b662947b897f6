"""URL and hostname column functions.

Everything here is a Catalyst expression over RFC 3986 (appendix B) regular
expressions, so a malformed URL gives an empty part instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space.
WHITESPACE_CHARACTERS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)

_SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*"
SCHEME_PATTERN = rf"^({_SCHEME}):"
AUTHORITY_PATTERN = rf"^(?:{_SCHEME}:)?//([^/?#]*)"
PATH_PATTERN = rf"^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)"
QUERY_PATTERN = r"^[^?#]*\?([^#]*)"
FRAGMENT_PATTERN = r"(?s)^[^#]*#(.*)$"
PARAMS_PATTERN = r";[^/]*$"

# Page types and the path words that decide them, in test order.
PAGE_TYPE_KEYWORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("careers", ("career", "careers", "jobs", "join-us", "join-our-team")),
    ("contact", ("contact", "contact-us", "get-in-touch")),
    ("about", ("about", "about-us", "who-we-are", "our-story")),
    ("privacy", ("privacy", "privacy-policy")),
    ("terms", ("terms", "terms-of-service", "terms-and-conditions", "tos")),
    ("blog", ("blog", "news", "articles", "insights")),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once and written once in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_ws(text: Column) -> Column:
    """Trim Unicode white space from both ends."""
    return F.trim(text, F.lit(WHITESPACE_CHARACTERS))


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME_PATTERN, 1))


def authority_of(url: Column) -> Column:
    return F.regexp_extract(url, AUTHORITY_PATTERN, 1)


def raw_path_of(url: Column) -> Column:
    """Path including any ``;params`` of the last segment."""
    return F.regexp_extract(url, PATH_PATTERN, 1)


def path_of(url: Column) -> Column:
    """Path without the ``;params`` of the last segment."""
    return F.regexp_replace(raw_path_of(url), PARAMS_PATTERN, "")


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, QUERY_PATTERN, 1)


def fragment_of(url: Column) -> Column:
    return F.regexp_extract(url, FRAGMENT_PATTERN, 1)


def host_of(url: Column) -> Column:
    """Lower-cased authority without a leading ``www.`` (port and user info stay)."""
    return F.regexp_replace(F.lower(authority_of(url)), r"^www\.", "")


def normalize_hostname(raw: Column) -> Column:
    """Trimmed, lower-cased host without ``www.``; NULL when it is not a hostname."""

    def checked(host: Column) -> Column:
        valid = host.contains(".") & ~host.contains("/") & ~host.contains(" ")
        return F.when(valid, F.regexp_replace(host, r"^www\.", ""))

    return let(F.lower(strip_ws(raw)), checked)


def normalize_url(raw: Column) -> Column:
    """Canonical http(s) URL, or NULL when the scheme or host is not acceptable."""
    url = strip_ws(raw)
    full_path = raw_path_of(url)
    params = F.regexp_extract(full_path, r";([^/]*)$", 1)
    tail = F.concat(
        F.rtrim(path_of(url), F.lit("/")),
        F.when(params != "", F.concat(F.lit(";"), params)).otherwise(""),
        F.when(query_of(url) != "", F.concat(F.lit("?"), query_of(url))).otherwise(""),
        F.when(fragment_of(url) != "", F.concat(F.lit("#"), fragment_of(url))).otherwise(""),
    )
    valid = scheme_of(url).isin("http", "https") & (authority_of(url) != "")
    return F.when(
        valid, F.concat(scheme_of(url), F.lit("://"), F.lower(authority_of(url)), tail)
    )


def url_rejection(raw: Column) -> Column:
    """Why :func:`normalize_url` gave NULL; NULL itself for a good URL."""
    url = strip_ws(raw)
    return F.when(~scheme_of(url).isin("http", "https"), "scheme must be http or https").when(
        authority_of(url) == "", "host is missing"
    )


def page_type_of(url: Column, is_home: Column | None = None) -> Column:
    """Role of a page judged by words anywhere in its path (``/photos`` is terms)."""
    path = F.trim(F.lower(path_of(url)), F.lit("/"))
    home = path == ""
    kind = F.when(home if is_home is None else (home | is_home), "home")
    for page_type, words in PAGE_TYPE_KEYWORDS:
        hit = path.contains(words[0])
        for word in words[1:]:
            if not any(word != other and other in word for other in words):
                hit = hit | path.contains(word)
        kind = kind.when(hit, page_type)
    return kind.otherwise("other")


def _without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


def _resolve_dots(segments: Column) -> Column:
    """Apply ``.`` and ``..`` to a segment array and join it to a path."""

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", kept)
            .when((segment == "..") & (F.size(kept) > 0), F.slice(kept, 1, F.size(kept) - 1))
            .when(segment == "..", kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    start = F.array().cast("array<string>")
    ends_in_dots = F.element_at(segments, -1).isin(".", "..")
    kept = F.concat(
        F.aggregate(segments, start, step),
        F.when(ends_in_dots, F.array(F.lit(""))).otherwise(start),
    )
    # ".." at the root also takes the leading empty segment, hence the slash.
    return F.regexp_replace(F.array_join(kept, "/"), "^/?", "/")


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` seen from ``base``, without its fragment."""
    return let(
        F.struct(
            _without_fragment(href).alias("ref"),
            scheme_of(base).alias("scheme"),
            authority_of(base).alias("authority"),
            raw_path_of(base).alias("path"),
            query_of(base).alias("query"),
            _without_fragment(base).alias("whole"),
        ),
        _resolve_against,
    )


def _resolve_against(parts: Column) -> Column:
    ref = parts["ref"]
    authority, path, query = authority_of(ref), raw_path_of(ref), query_of(ref)

    def with_query(prefix: Column, text: Column) -> Column:
        return F.concat(prefix, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))

    def below(directory: Column) -> Column:
        joined = F.split(F.concat(directory, path), "/", -1)
        return let(
            joined,
            lambda all_: F.concat(  # empty inner segments vanish
                F.slice(all_, 1, 1),
                F.filter(F.slice(all_, 2, F.greatest(F.size(all_) - 2, F.lit(0))), lambda s: s != ""),
                F.slice(all_, -1, 1),
            ),
        )

    root = F.concat(parts["scheme"], F.lit("://"), parts["authority"])
    base_dir = F.regexp_replace(parts["path"], r"[^/]*$", "")
    segments = F.when(path.startswith("/"), F.split(path, "/", -1)).otherwise(
        below(F.when(base_dir == "", "/").otherwise(base_dir))
    )
    scheme = scheme_of(ref)
    return (
        F.when(ref == "", parts["whole"])
        .when((scheme != "") & (scheme != parts["scheme"]), ref)
        .when(
            authority != "",
            with_query(F.concat(parts["scheme"], F.lit("://"), authority, path), query),
        )
        .when(
            path == "",
            with_query(
                F.concat(root, parts["path"]),
                F.coalesce(F.nullif(query, F.lit("")), parts["query"]),
            ),
        )
        .otherwise(with_query(F.concat(root, let(segments, _resolve_dots)), query))
    )
