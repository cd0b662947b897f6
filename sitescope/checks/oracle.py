"""The same questions in plain SQL, for an independent engine.

Every text is built from common table expressions over the raw test tables; none
uses the library's Spark code. Regular expressions are written for RE2.
"""

from __future__ import annotations

from sitescope.functions.rules import (
    GENERATOR_PATTERN,
    RulePattern,
    marketing_rules,
    technology_rules,
)
from sitescope.sources.bindings import (
    BODY_SNIPPETS,
    HEAD_SNIPPETS,
    PATHS,
    ROBOTS_TEXT,
    ROBOTS_TEXT_AGENT,
)

ORACLES: dict[str, str] = {}


def q(text: object) -> str:
    """A SQL literal."""
    if text is None:
        return "cast(null as varchar)"
    if isinstance(text, str):
        return "'" + text.replace("'", "''") + "'"
    return str(text)


def _choose(number: str, options: tuple) -> str:
    whens = " ".join(f"when {i} then {q(o)}" for i, o in enumerate(options))
    return f"(case ({number}) % {len(options)} {whens} end)"


# --- pages ------------------------------------------------------------------

_HOST = r"regexp_replace(lower(regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^www[.]', '')"
_PATH = (
    r"regexp_replace(regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"
)


def _id(text: str) -> str:
    return f"cast('0x' || substr(md5({text}), 1, 15) as bigint)"


def host(url: str) -> str:
    return _HOST.format(url)


def page_type(url: str) -> str:
    path = f"lower({_PATH.format(url)})"
    return f"""(case when trim({path}, '/') = '' then 'home'
 when regexp_matches({path}, 'career|jobs|join-us|join-our-team') then 'careers'
 when regexp_matches({path}, 'contact|get-in-touch') then 'contact'
 when regexp_matches({path}, 'about|who-we-are|our-story') then 'about'
 when regexp_matches({path}, 'privacy') then 'privacy'
 when regexp_matches({path}, 'terms|tos') then 'terms'
 when regexp_matches({path}, 'blog|news|articles|insights') then 'blog' else 'other' end)"""


def _fill(text: str) -> str:
    return f"replace(replace({text}, '{{host}}', host), '{{id}}', cast(page_id as varchar))"


CAPTURES = f"""
raw as (select page_id, url as raw_url, html as raw_html, {host('url')} as host from pages),
ided as (select *, {_id("regexp_extract(host, '([^.]+)[.]example[.]', 1)")} as company_id, {_id('host')} as domain_id from raw),
captures as (select page_id, host, company_id, domain_id,
 coalesce(regexp_extract(raw_url, '^([a-z]+):', 1) || '://' || host || {_choose('page_id', PATHS)}, raw_url) as url,
 case when page_id % 29 = 7 then null when page_id % 17 = 3 then 404 else 200 end as status,
 page_id % 29 = 7 as failed, page_id % 31 = 9 as pdf,
 replace(replace(raw_html, '</head>', {_fill(_choose('company_id', HEAD_SNIPPETS))} || '</head>'),
  '<body>', '<body>' || {_fill(_choose('page_id', BODY_SNIPPETS))}) as body,
 case company_id % 5 when 0 then 'cf-ray' when 1 then 'server' when 2 then 'set-cookie' else 'server' end as hkey,
 case company_id % 5 when 0 then 'ray-' || page_id when 1 then 'Cloudflare' when 2 then 'laravel_session=abc; path=/' else 'nginx' end as hval
 from ided),
site_pages as (select page_id, host, company_id, domain_id, url, {page_type('url')} as page_type, failed,
 coalesce(status, 0) as http_status,
 case when failed then null when pdf then 'application/pdf' else 'text/html' end as content_type,
 case when failed or pdf then null else nullif(body, '') end as html, hkey, hval from captures)"""

# Opaque blocks first, then tags with quoted attribute values respected.
_BODY = r"""(?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*>"""
_OPAQUE = rf"(?is)<!--.*?(?:-->|\z)|<script\b{_BODY}.*?(?:</script\s*>|\z)|<style\b{_BODY}.*?(?:</style\s*>|\z)"
_ATTR = r"""[^\s"'<>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
_ANY_TAG = rf"(?is)</?[a-z]{_BODY}|<[!?][^>]*>"
_TITLE = rf"(?is)<title(?:>|[\s/]{_BODY})(.*?)(?:</title\s*>|\z)"


def _tags(text: str, name: str) -> str:
    return f"regexp_extract_all({text}, {q(rf'(?is)<{name}(?:>|[\s/]{_BODY})')}, 0)"


def _decode(text: str) -> str:
    """The references that occur in the test pages; the ampersand comes last."""
    for reference, character in (("&quot;", '"'), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, {q(reference)}, {q(character)})"
    return text


def _attr(tag: str, name: str, var: str) -> str:
    pairs = f"regexp_extract_all({tag}, {q(_ATTR)}, 0)"
    pair = f"list_filter({pairs}, lambda {var}: regexp_matches({var}, {q(rf'(?i)^{name}\s*=')}))[1]"
    value = rf"regexp_replace({pair}, '^[^=]*=\s*', '')"
    quotes = q(r"""(?s)^"(.*)"$|^'(.*)'$""")
    return _decode(rf"regexp_replace({value}, {quotes}, '\1\2')")


_MARKUP = f"regexp_replace(coalesce(html, ''), {q(_OPAQUE)}, ' ', 'g')"
_HREFS = (
    f"list_filter(list_transform({_tags('markup', 'a')}, lambda t: trim({_attr('t', 'href', 'p')})), "
    "lambda h: h is not null)"
)

SEO = f"""
marked as (select *, {_MARKUP} as markup from site_pages),
listed as (select *, {_tags('markup', 'meta')} as metas, {_tags('markup', 'link')} as links,
 {_tags('markup', 'img')} as images, {_HREFS} as hrefs,
 regexp_extract_all(markup, {q(_TITLE)}, 1)[1] as raw_title,
 regexp_extract_all(coalesce(html, ''), {q(_OPAQUE)}, 0) as blocks from marked),
signals as (select page_id, company_id, url,
 nullif(trim({_decode('raw_title')}), '') as title,
 nullif(trim({_attr("list_filter(metas, lambda m: " + _attr('m', 'name', 'p') + " = 'description')[1]", 'content', 'p')}), '') as meta_description,
 nullif(trim({_attr("list_filter(links, lambda m: list_contains(string_split(" + _attr('m', 'rel', 'p') + ", ' '), 'canonical'))[1]", 'href', 'p')}), '') as canonical,
 nullif(trim({_attr("list_filter(metas, lambda m: " + _attr('m', 'name', 'p') + " = 'robots')[1]", 'content', 'p')}), '') as meta_robots,
 cast(len({_tags('markup', 'h1')}) as int) as h1_count, cast(len({_tags('markup', 'h2')}) as int) as h2_count,
 len(list_filter(metas, lambda m: starts_with(lower(coalesce(nullif({_attr('m', 'property', 'p')}, ''), {_attr('m', 'name', 'p')}, '')), 'og:'))) > 0 as has_open_graph,
 len(list_filter(metas, lambda m: starts_with(lower(coalesce(nullif({_attr('m', 'property', 'p')}, ''), {_attr('m', 'name', 'p')}, '')), 'twitter:'))) > 0 as has_twitter_card,
 len(list_filter(blocks, lambda b: regexp_matches(b, '(?i)^<script[^>]*type="application/ld\\+json"'))) > 0 as has_structured_data,
 starts_with(lower(url), 'https://') as has_ssl,
 cast(len(images) as int) as images_total,
 cast(len(list_filter(images, lambda i: coalesce(trim({_attr('i', 'alt', 'p')}), '') = '')) as int) as images_missing_alt,
 cast(len(list_filter(hrefs, lambda h: starts_with(h, '/') or (regexp_matches(h, '^https?://') and {host('h')} = {host('url')}))) as int) as internal_links,
 cast(len(list_filter(hrefs, lambda h: regexp_matches(h, '^https?://') and {host('h')} <> {host('url')})) as int) as external_links,
 cast(len(regexp_extract_all(regexp_replace(markup, {q(_ANY_TAG)}, ' ', 'g'), '\\S+')) as int) as word_count
 from listed),
scored as (select *, not contains(lower(coalesce(meta_robots, '')), 'noindex') as is_indexable,
 case when images_total = 0 then 1.0 else (images_total - images_missing_alt)::double / images_total end as alt_coverage from signals),
scores as (select *, round_even(least(
 case when length(title) between 10 and 60 then 18 when title is not null then 9 else 0 end
 + case when length(meta_description) between 50 and 160 then 15 when meta_description is not null then 7.5 else 0 end
 + case when h1_count = 1 then 12 when h1_count > 1 then 6 else 0 end
 + case when canonical is not null then 10 else 0 end + case when is_indexable then 10 else 0 end
 + case when has_open_graph then 8 else 0 end + case when has_structured_data then 8 else 0 end
 + case when has_ssl then 9 else 0 end + 6 * alt_coverage::double + case when internal_links > 0 then 4 else 0 end, 100.0)::double, 2) as score from scored),
graded as (select *, case when score >= 90 then 'A' when score >= 75 then 'B' when score >= 60 then 'C' when score >= 40 then 'D' else 'F' end as grade from scores),
ranked_homes as (select page_id, company_id, row_number() over (partition by company_id order by
 case when html <> '' and page_type = 'home' then 0 when html <> '' then 1 else 2 end, domain_id, page_id) as rn from site_pages),
homes as (select company_id, page_id from ranked_homes where rn = 1)"""

SIGNALS = (
    "page_id, url, title, meta_description, canonical, meta_robots, h1_count, h2_count, has_open_graph, "
    "has_twitter_card, has_structured_data, has_ssl, images_total, images_missing_alt, internal_links, "
    "external_links, word_count"
)


def _with(*parts: str) -> str:
    return "with " + ",".join(parts) + "\n"


ORACLES["page_capture"] = (
    _with(CAPTURES, f"m as (select *, {_MARKUP} as markup from site_pages)")
    + f"""select page_id, url, page_type, http_status, content_type,
 case when http_status = 200 and content_type = 'text/html' then trim({_decode(f"regexp_extract_all(markup, {q(_TITLE)}, 1)[1]")}) end as title,
 sha256(coalesce(html, '')) as content_hash, cast(length(html) as int) as html_length,
 case when not failed and hkey = 'server' then hval end as server, case when failed then 0 else 2 end as header_count from m"""
)
ORACLES["header_json"] = _with(CAPTURES) + """select page_id,
 case when failed then null when content_type = 'text/html' then 'text/html; charset=utf-8' else content_type end as content_type,
 case when not failed and hkey = 'cf-ray' then hval end as cf_ray from site_pages"""

_RAW_URL = """case page_id % 7 when 0 then '  ' || upper(url) || '/ ' when 1 then regexp_replace(url, '^https?', 'ftp')
 when 2 then regexp_replace(url, '//[^/]*', '//') when 3 then regexp_replace(url, '//', '//WWW.')
 when 4 then url || '/;v=1?q=a b#frag' when 5 then regexp_replace(url, '^https?://', '') else url end"""
ORACLES["url_normalise"] = (
    rf"""with r as (select page_id, trim({_RAW_URL}) as u from pages),
parts as (select page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as s,
 lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) as a,
 regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) as p,
 regexp_extract(u, '^[^?#]*\?([^#]*)', 1) as qs, regexp_extract(u, '^[^#]*#(.*)$', 1) as f from r),
n as (select page_id, case when s in ('http', 'https') and a <> '' then s || '://' || a || rtrim(regexp_replace(p, ';[^/]*$', ''), '/')
 || case when regexp_extract(p, ';([^/]*)$', 1) <> '' then ';' || regexp_extract(p, ';([^/]*)$', 1) else '' end
 || case when qs <> '' then '?' || qs else '' end || case when f <> '' then '#' || f else '' end end as url,
 case when s not in ('http', 'https') then 'scheme must be http or https' when a = '' then 'host is missing' end as reason from parts)
select page_id, url, {host('url')} as host, reason from n"""
)
ORACLES["hostname_normalise"] = r"""with h as (select page_id, regexp_extract(url, '//([^/?#]*)', 1) as h from pages),
r as (select page_id, case page_id % 6 when 0 then ' WWW.' || upper(h) || chr(9) when 1 then h || '/x' when 2 then replace(h, '.', '')
 when 3 then 'a ' || h when 4 then ' ' else h end as raw from h),
t as (select page_id, lower(trim(raw, ' ' || chr(9))) as x from r)
select page_id, case when contains(x, '.') and not contains(x, '/') and not contains(x, ' ') then regexp_replace(x, '^www[.]', '') end as hostname from t"""
ORACLES["page_types"] = _with(CAPTURES) + (
    f"select page_id, url, {host('url')} as host, {page_type('url')} as page_type, "
    f"case when page_id % 10 = 0 then 'home' else {page_type('url')} end as forced_type from captures"
)

# Links: the references in the pages are absolute, rooted, relative or a query.
LINKS = rf"""
link_pages as (select page_id, host, company_id, url as base, {_MARKUP} as markup from site_pages where html <> ''),
raw_links as (select page_id, host, base, unnest({_HREFS}) as href, generate_subscripts({_HREFS}, 1) as pos from link_pages),
cut as (select page_id, host, base, pos, regexp_replace(href, '#.*$', '') as href,
 regexp_extract(base, '^([a-z]+):', 1) as scheme, regexp_extract(base, '//([^/?#]*)', 1) as auth,
 regexp_extract(base, '^[a-z]+://[^/?#]*([^?#]*)', 1) as bpath from raw_links
 where href <> '' and not regexp_matches(href, '^(mailto:|tel:|javascript:|#)')),
absolute as (select page_id, host, pos, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href
 when starts_with(href, '//') then scheme || ':' || href when starts_with(href, '/') then scheme || '://' || auth || href
 when starts_with(href, '?') then scheme || '://' || auth || bpath || href
 else scheme || '://' || auth || case when regexp_replace(bpath, '[^/]*$', '') = '' then '/' else regexp_replace(bpath, '[^/]*$', '') end || href end as url from cut),
distinct_links as (select page_id, host, url, min(pos) as first_pos from absolute where regexp_matches(url, '^https?://') group by all),
page_links as (select page_id, host, url, cast(row_number() over (partition by page_id order by first_pos) - 1 as int) as pos from distinct_links)"""

ORACLES["extract_links"] = _with(CAPTURES, LINKS) + "select page_id, pos, url from page_links"
ORACLES["first_link_per_type"] = (
    _with(
        CAPTURES,
        LINKS,
        f"t as (select {host('url')} as host, {page_type('url')} as page_type, page_id, pos, url from page_links)",
        "r as (select *, row_number() over (partition by host, page_type order by page_id, pos, url) as rn from t "
        "where page_type not in ('home', 'other'))",
    )
    + "select host, page_type, page_id, pos, url from r where rn = 1"
)


def _frontier(pages: str) -> str:
    """Links of one page per host, seen from the site root."""
    return (
        LINKS.replace(
            "select page_id, host, company_id, url as base",
            "select page_id, host, company_id, 'https://' || host || '/' as base",
        ).replace("from site_pages where html <> ''", pages)
        + f""",
own as (select host, url, {page_type('url')} as page_type, row_number() over (partition by host order by pos) as pos
 from page_links where {host('url')} = host),
firsts as (select *, row_number() over (partition by host, page_type order by pos) as rn from own where page_type not in ('home', 'other')),
candidates as (select host, cast(pos as int) as pos, url, page_type from firsts where rn = 1
 union all select host, 0, 'https://' || host || '/', 'home' from site_pages where html <> '' group by host)"""
    )


_FIRST_PAGES = "from site_pages where page_id in (select min(page_id) from site_pages where html <> '' group by host)"
ROBOTS = """
robot_hosts as (select distinct host, domain_id % 3 as kind from captures),
allowed_of as (select c.*, case when k.kind = 0 then not (starts_with(c.upath, '/privacy-policy') or (starts_with(c.upath, '/te') and not starts_with(c.upath, '/terms'))) else true end as allowed
 from (select *, case when regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) = '' then '/' else regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) end as upath from {0}) c
 left join robot_hosts k using (host))"""
ORACLES["link_frontier"] = (
    _with(CAPTURES, _frontier(_FIRST_PAGES), ROBOTS.format("candidates"))
    + "select host, pos, url, page_type from allowed_of where allowed"
)
ORACLES["link_frontier_capped"] = (
    _with(
        CAPTURES,
        _frontier(_FIRST_PAGES),
        "capped as (select *, row_number() over (partition by host order by pos) as turn from candidates)",
    )
    + "select host, pos, url, page_type from capped where turn <= 2"
)
assert "Disallow: /te\n" in ROBOTS_TEXT and "Disallow:\n" in ROBOTS_TEXT_AGENT
ORACLES["robots_policies"] = _with(CAPTURES) + """select distinct host,
 case domain_id % 3 when 0 then 2.0 else 0.0 end::double as crawl_delay, case domain_id % 3 when 0 then 3 else 1 end as rule_count,
 case domain_id % 3 when 0 then '/privacy-policy /terms /te' else '' end as paths from captures where domain_id % 3 < 2"""
ORACLES["robots_gate"] = (
    _with(CAPTURES, ROBOTS.format("captures")) + "select page_id, host, url, allowed from allowed_of"
)
ORACLES["polite_schedule"] = _with(CAPTURES) + """select page_id, host, url,
 case domain_id % 3 when 0 then 2.0 else 1.0 end::double as delay_seconds,
 ((row_number() over (partition by host order by page_id) - 1) * case domain_id % 3 when 0 then 2.0 else 1.0 end)::double as start_seconds from captures"""


# --- detection --------------------------------------------------------------


def _rules(rules: tuple[RulePattern, ...]) -> str:
    rows = ",\n".join(
        f"({n}, {r.rule}, {q(r.name)}, {q(r.category)}, {q(r.kind)}, {q(r.header)}, "
        f"{r.confidence}::double, {q(r.pattern)}, {q(r.evidence)}, {str(r.has_version).lower()})"
        for n, r in enumerate(rules)
    )
    return f"rules(number, ord, name, category, kind, header, conf, pattern, evidence, versioned) as (values {rows})"


MATCHES = """
hits as (select company_id, domain_id, page_id, number,
 case when versioned then nullif(regexp_extract(html, case when versioned then pattern else '()' end, 1, 'i'), '') end as version
 from site_pages, rules where kind = 'html' and html <> '' and regexp_matches(html, pattern, 'i'))"""
COMPANY_MATCHES = f"""
first_hits as (select company_id, number, version from
 (select *, row_number() over (partition by company_id, number order by domain_id, page_id) as rn from hits) where rn = 1),
gens as (select company_id, generator from (select *, row_number() over (partition by company_id order by domain_id, page_id) as rn from
 (select *, regexp_extract(html, {q(GENERATOR_PATTERN)}, 1, 'i') as generator from site_pages) where generator <> '') where rn = 1),
all_headers as (select company_id, domain_id, page_id, hkey as header, hval as value from site_pages where not failed union all
 select company_id, domain_id, page_id, 'content-type', case content_type when 'text/html' then 'text/html; charset=utf-8' else content_type end from site_pages where not failed),
merged as (select company_id, header, value from
 (select *, row_number() over (partition by company_id, header order by domain_id, page_id) as rn from all_headers) where rn = 1),
matches as (select * from first_hits
 union all select company_id, number, case when versioned then nullif(regexp_extract(generator, case when versioned then pattern else '()' end, 1, 'i'), '') end
  from gens, rules where kind = 'meta_gen' and regexp_matches(generator, pattern, 'i')
 union all select company_id, number, null from merged join rules using (header) where kind = 'header' and regexp_matches(value, pattern, 'i')),
technologies as (select company_id, ord, name as technology, category, max(conf) as confidence,
 arg_min(evidence, (-conf, number)) as evidence, arg_min(case when version is not null then version end, number) as version
 from matches join rules using (number) group by company_id, ord, name, category)"""
TECH = (_rules(technology_rules()), CAPTURES, MATCHES, COMPANY_MATCHES)

ORACLES["page_matches"] = _with(_rules(technology_rules()), CAPTURES, MATCHES) + (
    "select page_id, cast(number as int) as number, version from hits"
)
ORACLES["rule_coverage"] = _with(_rules(technology_rules() + marketing_rules()), CAPTURES, MATCHES) + (
    "select cast(number as int) as number, any_value(name) as name, any_value(category) as category, any_value(conf) as confidence, "
    "any_value(pattern) as pattern, count(page_id) as pages from rules left join hits using (number) where kind = 'html' group by number"
)
ORACLES["merged_headers"] = _with(*TECH) + "select * from merged"
ORACLES["generators"] = _with(*TECH) + "select * from gens"
ORACLES["detect_technologies"] = _with(*TECH) + "select * from technologies"
ORACLES["detected_companies_by_technology"] = (
    _with(*TECH) + "select technology, count(distinct company_id) as companies from technologies group by 1"
)
ORACLES["detect_custom_rules"] = (
    _with(
        """rules(number, ord, name, category, kind, header, conf, pattern, evidence, versioned) as (values
 (0, 0, 'Charset', 'Custom', 'html', '', 0.5::double, 'charset="(?P<version>[a-z0-9-]+)"', 'html:charset="(?P<version>[a-z0-9-]+)"', true),
 (1, 0, 'Charset', 'Custom', 'html', '', 0.7::double, '<article>', 'html:<article>', false),
 (2, 1, 'Tracker', 'Custom', 'html', '', 0.6::double, 'track\\(\\d+\\)', 'html:track\\(\\d+\\)', false),
 (3, 2, 'Nginx', 'Custom', 'header', 'server', 0.9::double, '^nginx$', 'header:^nginx$', false))""",
        CAPTURES,
        MATCHES,
        COMPANY_MATCHES,
    )
    + "select * from technologies"
)
ORACLES["detect_marketing"] = (
    _with(_rules(marketing_rules()), CAPTURES, MATCHES)
    + "select company_id, ord, name as tool_name, category, arg_min(pattern, number) as evidence from hits join rules using (number) group by company_id, ord, name, category"
)
ORACLES["detect_custom_marketing"] = (
    _with(
        r"""rules(number, ord, name, category, kind, header, conf, pattern, evidence, versioned) as (values
 (0, 0, 'Tracker', 'Custom', 'html', '', 0.5::double, 'track\(\d+\)', '', false),
 (1, 1, 'Calendar', 'Custom', 'html', '', 0.5::double, 'calendly\.com/x', '', false),
 (2, 1, 'Calendar', 'Custom', 'html', '', 0.5::double, 'calendly', '', false),
 (3, 2, 'Nothing', 'Custom', 'html', '', 0.5::double, 'no such text', '', false))""",
        CAPTURES,
        MATCHES,
    )
    + "select company_id, ord, name as tool_name, category, arg_min(pattern, number) as evidence from hits join rules using (number) group by company_id, ord, name, category"
)
ORACLES["company_marketing"] = ORACLES["detect_marketing"]
ORACLES["technology_catalog"] = """with known as (select p_brand, min(p_type) as category from part group by 1 having p_brand < 'Brand#20')
select p_brand as technology, category, cast(null as varchar) as vendor from known
union all select p_brand, upper(arg_min(p_name, p_partkey)), null from part where p_brand not in (select p_brand from known) group by p_brand"""

# --- seo --------------------------------------------------------------------

ORACLES["homepage_pick"] = _with(CAPTURES, SEO) + "select * from homes"
ORACLES["seo_signals"] = _with(CAPTURES, SEO) + f"select {SIGNALS} from signals"
ORACLES["seo_scores"] = _with(CAPTURES, SEO) + (
    "select page_id, is_indexable, round(alt_coverage::double, 6) as alt_coverage, score, grade from graded"
)
ORACLES["seo_profiles"] = (
    _with(
        CAPTURES,
        SEO,
        "vitals as (select url, min(page_id) as n from captures where starts_with(url, 'https:') group by url)",
    )
    + """select company_id, url, score, grade, is_indexable, word_count, cast(n % 4000 as int) as cwv_lcp_ms,
 (n % 10 / 10)::double as cwv_cls, cast(n % 300 as int) as cwv_inp_ms from graded join homes using (page_id, company_id) left join vitals using (url)"""
)

# --- projection -------------------------------------------------------------

_FLAGS = ", ".join(
    f"bool_or(page_type = '{kind}') as {flag}"
    for flag, kind in (
        ("has_contact_page", "contact"),
        ("has_careers_page", "careers"),
        ("has_blog", "blog"),
        ("has_privacy", "privacy"),
        ("has_terms", "terms"),
    )
)
ORACLES["page_flags"] = _with(CAPTURES) + f"select company_id, {_FLAGS} from site_pages group by 1"
SITE_DOCS = f"""
site_companies as (select company_id, 'Site ' || min(regexp_extract(host, '([^.]+)[.]example[.]', 1)) as display_name,
 case when company_id % 4 <> 0 then 'Industry ' || company_id % 4 end as industry, case when company_id % 2 = 0 then '1-10' else '11-50' end as size_bucket,
 arg_min(host, domain_id) as primary_domain from captures group by company_id),
tech_lists as (select company_id, list(technology order by ord) as techs from technologies group by 1),
flags as (select company_id, {_FLAGS} from site_pages group by 1),
documents as (select c.company_id, display_name, primary_domain, industry, cast(null as varchar) as country, cast(null as varchar) as state,
 cast(null as varchar) as city, size_bucket, score as seo_score, grade as seo_grade, coalesce(techs, []) as technologies,
 coalesce(has_ssl, false) as has_ssl, has_contact_page, has_careers_page, has_blog, has_privacy, has_terms,
 lower(concat_ws(' ', display_name, industry, nullif(array_to_string(coalesce(techs, []), ' '), ''))) as text_blob
 from site_companies c left join tech_lists using (company_id) left join flags using (company_id)
 left join (select company_id, has_ssl, score, grade from graded join homes using (page_id, company_id)) s using (company_id))"""
_SITE = (*TECH, SEO, SITE_DOCS)
ORACLES["search_projection"] = _with(*_SITE) + "select * from documents"
ORACLES["stream_enrichment"] = ORACLES["search_projection"]
ITEM = "company_id, display_name, primary_domain, industry, country, seo_score, seo_grade, technologies"
ORACLES["search_over_projection"] = _with(*_SITE) + (
    f"select {ITEM} from documents where list_has_any(technologies, ['React', 'WordPress', 'Shopify']) "
    "order by seo_score desc nulls last, display_name, company_id limit 30"
)

# --- search -----------------------------------------------------------------

DOCS = """
brands as (select o_custkey as k, list_sort(list_distinct(list(p_brand))) as techs from orders join lineitem on l_orderkey = o_orderkey
 join part on p_partkey = l_partkey group by 1),
flags as (select o_custkey as k, bool_or(o_orderpriority = '1-URGENT') as f1, bool_or(o_orderpriority = '2-HIGH') as f2,
 bool_or(o_orderpriority = '3-MEDIUM') as f3, bool_or(o_orderstatus = 'F') as f4, bool_or(o_orderstatus = 'P') as f5, max(o_orderdate) as last from orders group by 1),
base as (select *, case when c_custkey % 10 <> 0 then ((c_custkey * 37) % 101)::double end as score from customer
 join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey left join brands on brands.k = c_custkey left join flags on flags.k = c_custkey),
docs as (select c_custkey as company_id, c_name as display_name, lower(replace(c_name, '#', '-')) || '.example.com' as primary_domain,
 c_mktsegment as industry, n_name as country, r_name as state, 'City ' || c_custkey % 7 as city,
 case when c_acctbal < 0 then '1-10' when c_acctbal < 3000 then '11-50' when c_acctbal < 6000 then '51-200' else '201+' end as size_bucket,
 score as seo_score, case when score is null then null when score >= 90 then 'A' when score >= 75 then 'B' when score >= 60 then 'C' when score >= 40 then 'D' else 'F' end as seo_grade,
 coalesce(techs, []) as technologies, c_custkey % 2 = 0 as has_ssl, coalesce(f1, false) as has_contact_page, coalesce(f2, false) as has_careers_page,
 coalesce(f3, false) as has_blog, coalesce(f4, false) as has_privacy, coalesce(f5, false) as has_terms,
 lower(c_name || ' ' || c_mktsegment || case when len(techs) > 0 then ' ' || array_to_string(techs, ' ') else '' end) as text_blob,
 coalesce(last, timestamp '1990-01-01 00:00:00') as indexed_at from base)"""
_BY_SCORE = "seo_score desc nulls last, display_name, company_id"
_BY_SCORE_UP = "seo_score asc nulls first, display_name, company_id"
_FLAGSHIP = """(contains(text_blob, 'brand#1') or contains(lower(display_name), 'brand#1'))
 and industry in ('BUILDING', 'MACHINERY', 'FURNITURE') and list_has_any(technologies, ['Brand#1', 'Brand#7', 'Brand#12'])
 and seo_score >= 20 and has_contact_page"""


def _page(where: str, order: str, limit: int = 200, offset: int = 0) -> str:
    return _with(DOCS) + f"select {ITEM} from docs where {where} order by {order} limit {limit} offset {offset}"


ORACLES["search_page"] = _page(_FLAGSHIP, _BY_SCORE, 25)
ORACLES["search_text"] = _page("contains(text_blob, 'customer#00000001')", _BY_SCORE)
ORACLES["search_filters_and"] = _page(
    "seo_score >= 40 and seo_score <= 75.5 and state = 'ASIA' and has_blog", _BY_SCORE
)
ORACLES["search_tech_any"] = _page("list_has_any(technologies, ['Brand#3', 'Brand#25'])", _BY_SCORE)
ORACLES["search_bool_false"] = _page("not has_ssl and not has_terms", _BY_SCORE)
ORACLES["search_number_eq"] = _page("seo_score = 37", _BY_SCORE)
ORACLES["search_grade_city"] = _page(
    "seo_grade in ('A', 'B') and city = 'City 3' and size_bucket in ('51-200', '201+')", _BY_SCORE
)
ORACLES["search_sort_name_desc"] = _page("true", "display_name desc, company_id", 50)
ORACLES["search_sort_name_asc"] = _page("true", "display_name, company_id", 50, 50)
ORACLES["search_sort_recency"] = _page("true", "indexed_at desc nulls last, company_id", 40)
ORACLES["search_sort_recency_asc"] = _page("true", "indexed_at asc nulls first, company_id", 40)
ORACLES["search_sort_score_asc"] = _page("true", _BY_SCORE_UP, 50, 150)
ORACLES["search_page_3"] = _page("true", _BY_SCORE, 30, 60)
ORACLES["search_far_page"] = _page("true", _BY_SCORE_UP, 25, 1000)
ORACLES["search_total_filtered"] = _with(DOCS) + f"select count(*) as total from docs where {_FLAGSHIP}"


ORACLES["search_suggest"] = _with(DOCS) + (
    "select company_id, display_name from docs where starts_with(lower(display_name), 'customer#00000001') order by display_name, company_id limit 10"
)
ORACLES["technology_json"] = _with(DOCS) + (
    "select company_id, technologies, '[' || array_to_string(list_transform(technologies, lambda t: '\"' || t || '\"'), ',') || ']' as text from docs"
)
ORACLES["upsert_documents"] = _with(DOCS) + (
    "select company_id, display_name, case when industry = 'BUILDING' or size_bucket = '1-10' then 99.0::double else seo_score end as seo_score, "
    "case when industry = 'BUILDING' or size_bucket = '1-10' then ['Rescan'] else technologies end as technologies, has_ssl, indexed_at from docs"
)


def _facet(fields: list[str], where: str = "true") -> str:
    parts = []
    for f in fields:
        if f == "technology":
            value = "unnest(technologies)"
        elif f.startswith("has_"):
            value = f"case when {f} then 'True' else 'False' end"
        else:
            value = f"cast({f} as varchar)"
        parts.append(f"select '{f}' as field, {value} as value from docs where {where}")
    union = " union all ".join(parts)
    return _with(DOCS) + f'select field, value, count(*) as "count" from ({union}) where value is not null group by all'


ORACLES["facet_industry"] = _facet(["industry"])
ORACLES["facet_technology"] = _facet(["technology"], "list_contains(technologies, 'Brand#3')")
ORACLES["facets_bundle"] = _facet(
    ["industry", "technology", "country", "seo_grade", "seo_score", "has_ssl"], "seo_score >= 30"
)

# --- entities and relations -------------------------------------------------

MODEL = """
companies as (select c_custkey as company_id, c_name as display_name, case when c_custkey % 9 <> 0 then c_name || ' Ltd' end as legal_name,
 case when c_custkey % 13 = 0 then 'enriched' else 'discovered' end as status, c_mktsegment as industry,
 case when c_acctbal < 0 then '1-10' else '11-50' end as size_bucket,
 timestamp '2020-01-01 00:00:00' + to_days(cast(c_custkey * 7 % 1000 as int)) as created_at from customer),
domains as (select c_custkey * 2 + i as domain_id, c_custkey as company_id,
 case when i = 1 then 'shop.' else '' end || lower(replace(c_name, '#', '-')) || '.example.com' as hostname, i = 0 as is_primary,
 case when c_custkey % 5 = 0 then 'crawled' else 'pending' end as crawl_status
 from customer, (values (0), (1)) t(i) where c_custkey % 11 <> 0 and (i = 0 or c_custkey % 3 = 0)),
crawl_jobs as (select o_orderkey as job_id, o_custkey * 2 as domain_id,
 case when o_orderpriority = '5-LOW' then 'failed' when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'O' then 'pending' else 'running' end as status,
 o_orderdate as created_at from orders),
jobs as (select job_id, domain_id, status, case when status = 'pending' then 0 else 1 end as attempts,
 case when status = 'failed' then 'TimeoutError: read' end as error, created_at from crawl_jobs),
job_pages as (select l_orderkey as job_id, l_linenumber as page_no, 'https://s' || l_suppkey || '.example.com/p' || l_partkey as url,
 case when l_linenumber = 1 then 'home' else 'other' end as page_type, case when l_returnflag = 'R' then 404 else 200 end as http_status, l_shipdate as fetched_at from lineitem),
detections as (select o_custkey as company_id, p_brand as technology, max(round(1 - l_discount, 2)) as confidence from lineitem
 join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey group by all),
catalog as (select p_brand as technology, min(p_type) as category from part group by 1)"""
M = _with(MODEL)
_COMPANY = "company_id, display_name, legal_name, status, industry, size_bucket, created_at"
_DOMAIN = "domain_id, hostname, is_primary, crawl_status"

ORACLES["company_listing"] = _with(
    MODEL, "listed as (select * from companies order by created_at desc, company_id desc limit 50 offset 50)"
) + f"select {_COMPANY}, {_DOMAIN} from listed left join domains using (company_id)"
ORACLES["company_detail"] = M + f"select {_COMPANY}, {_DOMAIN} from companies left join domains using (company_id)"
ORACLES["company_by_id"] = M + (
    f"select {_COMPANY} from companies where company_id in (select user_id * 13 from events)"
)
ORACLES["companies_by_hostname"] = (
    M + "select hostname, company_id, display_name, domain_id from domains join companies using (company_id)"
)
REQUESTS = """
asked as (select o_orderkey as request_id, 'customer-' || lpad(cast(case when o_orderkey % 3 = 0 then 7 else o_custkey end as varchar), 9, '0') || '.example.com' as h from orders),
requests as (select request_id, case when request_id % 10 = 1 then ' WWW.' || upper(h) when request_id % 50 = 2 then 'not a host' else h end as requested,
 case when request_id % 10 <> 1 and request_id % 50 = 2 then null else h end as hostname from asked),
found as (select * from requests left join domains using (hostname))"""
ORACLES["request_crawls"] = _with(MODEL, REQUESTS) + (
    "select request_id as job_id, domain_id, hostname, 'website' as job_type, 'pending' as status, 0 as attempts, 0 as pages_crawled "
    "from found where domain_id is not null"
)
ORACLES["rejected_crawls"] = _with(MODEL, REQUESTS) + (
    "select request_id, requested, case when hostname is null then 'invalid hostname' else 'no company owns this domain' end as reason "
    "from found where domain_id is null"
)
CANDIDATES = """
cand as (select c_custkey as n, c_custkey % 13 as kind, case when c_custkey % 17 = 0 then '' else c_name end as name, c_mktsegment as industry from customer),
checked as (select n as request_id, name as display_name, industry, kind,
 case when name = '' then 'blank display name' when kind = 1 then 'duplicate hostname' when kind = 2 then 'second primary domain' when kind = 3 then 'invalid hostname' end as reason,
 case kind when 1 then 2 when 2 then 2 when 3 then 2 when 4 then 2 when 7 then 0 else 1 end as hosts from cand),
claims as (select request_id, 0 as pos, case kind when 6 then 'customer-' || lpad(cast(request_id as varchar), 9, '0') || '.example.com'
  when 8 then 'popular.example.org' else 'new' || request_id || '.example.org' end as hostname from checked where reason is null and hosts > 0
 union all select request_id, 1, 'new' || (request_id + 1) || '.example.org' from checked where reason is null and kind = 4),
owned as (select request_id, arg_min(hostname, pos) as hostname from claims where hostname in (select hostname from domains) group by 1),
free as (select * from claims where request_id not in (select request_id from owned)),
accepted as (select request_id from checked where reason is null and hosts = 0 union all
 select request_id from free f group by request_id having not bool_or(exists (select 1 from free g where g.hostname = f.hostname and g.request_id < f.request_id)))"""
ORACLES["candidate_checks"] = _with(MODEL, CANDIDATES) + (
    "select request_id, display_name, reason, hosts from checked"
)
ORACLES["domain_conflicts"] = _with(MODEL, CANDIDATES) + "select * from owned"
# A conflict chain is never longer than two here, so "nobody earlier claims it" is
# the whole rule; longer chains are compared with brute force in the tests.
ORACLES["registered_companies"] = _with(MODEL, CANDIDATES) + (
    "select request_id as company_id, display_name, industry, 'discovered' as status from checked where request_id in (select request_id from accepted)"
)
ORACLES["registered_domains"] = _with(MODEL, CANDIDATES) + (
    "select request_id as company_id, pos, hostname, pos = 0 as is_primary, 'pending' as crawl_status from claims where request_id in (select request_id from accepted)"
)
ORACLES["registration_rejects"] = _with(MODEL, CANDIDATES) + (
    "select request_id, coalesce(reason, 'domain already owned') as reason from checked where request_id not in (select request_id from accepted)"
)
ORACLES["list_jobs"] = M + "select * from jobs where status = 'failed' order by created_at desc, job_id desc limit 40 offset 80"
ORACLES["pending_jobs"] = M + "select * from jobs where status = 'pending' order by created_at desc, job_id desc limit 50"
ORACLES["job_detail"] = M + (
    "select job_id, status, page_no, url, page_type, http_status from jobs left join job_pages using (job_id)"
)
ORACLES["job_pages_in_order"] = M + "select job_id, page_no, url from job_pages"
ORACLES["domain_pages"] = M + "select domain_id, job_id, page_no, url from jobs join job_pages using (job_id)"
ORACLES["company_pages"] = M + (
    "select company_id, hostname, domain_id, job_id, page_no, url from domains join jobs using (domain_id) join job_pages using (job_id)"
)
ORACLES["pages_per_job"] = M + (
    "select job_id, any_value(status) as status, count(page_no) as pages_crawled from jobs left join job_pages using (job_id) group by job_id"
)
ORACLES["company_technology_list"] = M + "select * from detections left join catalog using (technology)"
ORACLES["company_facts"] = M + "select * from detections"
ORACLES["company_seo"] = "select c_custkey as company_id, c_name as display_name, case when c_custkey % 10 <> 0 then ((c_custkey * 37) % 101)::double end as seo_score from customer"
ORACLES["missing_companies"] = M + (
    "select distinct user_id * 13 as company_id from events where user_id * 13 not in (select company_id from companies)"
)
ORACLES["catalog_page"] = M + "select * from catalog order by technology limit 10"
ORACLES["companies_by_technology"] = M + (
    "select technology, count(distinct company_id) as companies from detections group by 1"
)
ORACLES["dashboard_kpis"] = M + (
    "select 'companies' as kpi, count(*) as value from companies union all select 'crawl_jobs', count(*) from jobs "
    "union all select 'pending_crawls', count(*) from jobs where status = 'pending' union all select 'technologies', count(*) from catalog"
)
ORACLES["primary_domains"] = M + "select company_id, arg_min(hostname, domain_id) as primary_domain from domains group by 1"

# --- maintenance and integrity ----------------------------------------------

ORACLES["upsert_latest"] = """with r as (select o_custkey as company_id, o_totalprice as score, o_orderdate as scanned_at,
 row_number() over (partition by o_custkey order by o_orderdate desc, o_totalprice desc) as rn from orders)
select company_id, score, scanned_at from r where rn = 1 union all
select c_custkey, round(c_acctbal, 2), timestamp '1999-01-01 00:00:00' from customer where c_custkey not in (select o_custkey from orders)"""
ORACLES["replace_for_company"] = M + (
    "select company_id, technology, confidence from detections join companies using (company_id) where industry not in ('MACHINERY', 'BUILDING') union all "
    "select company_id, 'Rescan', 0.5::double from companies where industry = 'BUILDING'"
)
ORACLES["update_domain_status"] = _with(
    MODEL,
    "r as (select domain_id, case status when 'completed' then 'crawled' when 'failed' then 'failed' end as new_status, "
    "row_number() over (partition by domain_id order by created_at desc, job_id desc) as rn from jobs)",
) + (
    "select d.domain_id, company_id, hostname, is_primary, coalesce(new_status, crawl_status) as crawl_status "
    "from domains d left join (select * from r where rn = 1) r using (domain_id)"
)
ORACLES["update_job_rows"] = M + (
    "select j.job_id, domain_id, case when n is null then status else 'completed' end as status, coalesce(n, attempts) as attempts, "
    "case when n is null then error end as error, created_at from jobs j left join "
    "(select job_id as id, cast(count(*) as int) as n from job_pages group by 1 having max(http_status) = 200) d on d.id = j.job_id"
)
ORACLES["unknown_domains_in_jobs"] = M + (
    "select distinct domain_id from jobs where domain_id not in (select domain_id from domains)"
)
ORACLES["append_jobs"] = _with(MODEL, REQUESTS) + (
    "select status, count(*) as jobs, count(*) as ids from (select status from jobs union all "
    "select 'pending' from found where domain_id is not null) group by 1"
)
ORACLES["delete_companies"] = M + (
    "select d.* from domains d join companies using (company_id) where not (industry = 'MACHINERY' and status = 'discovered')"
)
DAMAGED = """
bad_companies as (select company_id, status, case when company_id % 97 = 0 then ' ' else display_name end as display_name from companies),
bad_domains as (select domain_id, case when company_id % 83 = 3 then -company_id else company_id end as company_id,
 case when company_id % 101 = 5 then 'no_dot' when company_id % 89 = 4 then 'WWW.same.example.com' else hostname end as hostname,
 case when company_id % 101 = 5 then 'no_dot' when company_id % 89 = 4 then 'same.example.com' else hostname end as normal,
 is_primary or company_id % 45 = 0 as is_primary from domains),
bad_detections as (select company_id, technology, case when company_id % 211 = 0 then 1.5 else confidence end as confidence from detections),
bad_catalog as (select * from catalog where technology <> 'Brand#7'),
report as (
 select 'blank_display_name' as rule, cast(company_id as varchar) as key, 1 as rows from bad_companies where trim(display_name) = ''
 union all select 'invalid_hostname', cast(domain_id as varchar), 1 from bad_domains where normal = 'no_dot'
 union all select 'hostname_twice_in_company', company_id || '|' || normal, count(*) from bad_domains group by company_id, normal having count(*) > 1
 union all select 'several_primaries', cast(company_id as varchar), count(*) from bad_domains where is_primary group by company_id having count(*) > 1
 union all select 'hostname_not_unique', normal, count(*) from bad_domains group by normal having count(*) > 1
 union all select 'confidence_out_of_range', cast(company_id as varchar), 1 from bad_detections where not confidence between 0 and 1
 union all select 'score_out_of_range', cast(c_custkey as varchar), 1 from customer where not round(c_acctbal, 2) / 100 between 0 and 100
 union all select 'domain_without_company', cast(company_id as varchar), count(*) from bad_domains where company_id not in (select company_id from bad_companies) group by company_id
 union all select 'detection_without_technology', technology, count(*) from bad_detections where technology not in (select technology from bad_catalog) group by technology
 union all select 'enriched_without_domain', cast(company_id as varchar), 1 from bad_companies where status = 'enriched' and company_id not in (select company_id from bad_domains))"""
ORACLES["integrity_report"] = _with(MODEL, DAMAGED) + "select rule, key, cast(rows as bigint) as rows from report"
ORACLES["integrity_summary"] = _with(MODEL, DAMAGED) + (
    "select rule, count(*) as violations, cast(sum(rows) as bigint) as rows from report group by 1"
)

ORACLES["crawl_orphans"] = _with(_rules(marketing_rules()), CAPTURES, MATCHES, MODEL) + (
    "select 'job_without_domain' as rule, cast(domain_id as varchar) as key, count(*) as rows from jobs "
    "where domain_id not in (select domain_id from domains) group by domain_id "
    "union all select 'page_without_job', cast(job_id as varchar), count(*) from job_pages "
    "where job_id not in (select job_id from jobs where job_id % 50 <> 1) group by job_id "
    "union all select 'tool_without_company', cast(company_id as varchar), count(distinct ord) from hits join rules using (number) "
    "where company_id % 4 = 0 group by company_id"
)

# --- job lifecycle: an ordered walk, event by event -------------------------

ORACLES["job_fold"] = """with recursive ev as (select user_id, cast(ts as date) as day, ts, event_id, event_id % 9 - 1 as pages,
 case event_type when 'view' then 'start' when 'purchase' then 'complete' when 'error' then 'fail' else 'enqueue' end as step,
 row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as n from events),
walk as (select user_id, day, 0::bigint as n, 'pending' as state, 0 as attempts, 0::bigint as pages_crawled,
  cast(null as timestamp) as started_at, cast(null as timestamp) as finished_at, 0::bigint as illegal from ev group by user_id, day
 union all select w.user_id, w.day, e.n,
  case when w.state = 'pending' and step = 'start' then 'running' when w.state = 'running' and step = 'complete' and pages >= 0 then 'completed'
   when w.state = 'running' and step = 'fail' then 'failed' else w.state end,
  w.attempts + case when w.state = 'pending' and step = 'start' then 1 else 0 end,
  case when w.state = 'running' and step = 'complete' and pages >= 0 then pages else w.pages_crawled end,
  case when w.state = 'pending' and step = 'start' then e.ts else w.started_at end,
  case when w.state = 'running' and (step = 'fail' or step = 'complete' and pages >= 0) then e.ts else w.finished_at end,
  w.illegal + case when (w.state = 'pending' and step in ('start', 'enqueue')) or (w.state = 'running' and (step = 'fail' or step = 'complete' and pages >= 0)) then 0 else 1 end
 from walk w join ev e on e.user_id = w.user_id and e.day = w.day and e.n = w.n + 1)
select user_id, day, state, attempts, cast(pages_crawled as int) as pages_crawled, started_at, finished_at, illegal, n as events
 from walk where (user_id, day, n) in (select user_id, day, max(n) from ev group by user_id, day)"""
ORACLES["stream_job_state"] = ORACLES["job_fold"]

# --- statistics -------------------------------------------------------------

ORACLES["stats_overview"] = M + (
    "select 'companies' as kpi, count(*) as value from companies union all select 'domains', count(*) from domains "
    "union all select 'crawled_domains', count(*) from domains where crawl_status = 'crawled'"
)
ORACLES["stats_industries"] = "select c_mktsegment as industry, count(*) as companies from customer group by 1"
ORACLES["stats_pipeline"] = M + (
    "select 'discovered' as stage, count(*) as companies from companies union all "
    "select 'crawled', count(distinct company_id) from domains where crawl_status = 'crawled' union all "
    "select 'enriched', count(*) from companies where status = 'enriched' union all "
    "select 'scored', count(*) from companies where company_id % 10 <> 0"
)
ORACLES["crawl_throughput"] = M + (
    "select to_timestamp(floor(epoch(fetched_at) / 2592000) * 2592000)::timestamp as window_start, count(*) as pages, "
    "cast(count_if(http_status <> 200) as bigint) as failed, round(count_if(http_status <> 200) / count(*), 6) as error_rate from job_pages group by 1"
)
