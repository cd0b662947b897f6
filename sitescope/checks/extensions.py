"""Queries beyond the first inventory, each beside its SQL counterpart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.checks import oracle as O
from sitescope.checks.oracle import CAPTURES, DOCS, ITEM, LINKS, ORACLES, _with, q
from sitescope.checks.queries import AS_OF, JOB_KEY, QUERIES, _candidates, _site_documents, query
from sitescope.functions.rules import marketing_rules
from sitescope.operators import (
    classify,
    contacts,
    depth,
    detect,
    entities,
    intelligence,
    locations,
    maintenance,
    names,
    relations,
    seo_scan,
    stats,
    taxonomy,
)
from sitescope.plans import relevance as rel
from sitescope.plans.search import Filter, SearchSpec, facet_counts, matching, order_of, request_errors, search, search_items
from sitescope.session import shared_dir
from sitescope.sources import bindings as B
from sitescope.sources.export import export, read_export

# --- weighted relevance -----------------------------------------------------

_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def _relevance_sql(terms: list[str], where: str, limit: int, every: bool = False) -> str:
    """BM25 over weighted term counts in whole millionths, from the documents as they are."""
    fields = (("display_name", 100), ("industry", 40), ("array_to_string(technologies, ' ')", 20), ("text_blob", 10))
    rows = " union all ".join(
        f"select company_id, unnest({_TOKENS.format(f)}) as term, {w} as weight from docs" for f, w in fields
    )
    asked = ", ".join(f"'{t}'" for t in terms)
    part = "cast(floor(1000000 * (idf * weight * (1.2::double + 1) / (weight + 100 * 1.2::double * (1 - 0.75::double + 0.75::double * length / mean)))) as bigint)"
    every_term = f"and held = {len(terms)}" if every else ""
    return _with(
        DOCS,
        f"""occurrences as materialized ({rows}),
postings as materialized (select company_id, term, cast(sum(weight) as bigint) as weight from occurrences group by all),
lengths as (select company_id, cast(sum(weight) as bigint) as length from postings group by 1),
corpus as (select (select count(*) from docs) as n, sum(length) / (select count(*) from docs)::double as mean from lengths),
idfs as materialized (select term, ln(1 + (any_value(n) - count(*) + 0.5::double) / (count(*) + 0.5::double)) as idf from postings, corpus where term in ({asked}) group by term),
top as (select cast(sum(floor(1000000 * idf * (1.2::double + 1))) as bigint) as top from idfs),
parts as (select company_id, cast(sum({part}) as bigint) as parts, count(*) as held from postings join idfs using (term) join lengths using (company_id), corpus group by 1),
scored as (select company_id, display_name, parts / top::double as relevance,
 floor(1000000 * ((1.0 - 0.25)::double * (parts / top::double) + 0.25::double * (coalesce(seo_score, 0) / 100.0::double))) / 1000000.0::double as score
 from parts join docs using (company_id), top where {where} {every_term})""",
    ) + f"""select cast(row_number() over (order by score desc, display_name, company_id) as int) as rank, company_id, display_name, relevance, score
 from scored order by score desc, display_name, company_id limit {limit}"""


def _relevant(spark: SparkSession, sf: str, spec: SearchSpec, every_term: bool = False) -> DataFrame:
    documents = B.search_documents(spark, sf)
    return rel.relevance(rel.build_index(documents), documents, spec, every_term=every_term)


@query
def search_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Any of a rare, a common and two universal terms, under two filters."""
    filters = (Filter("has_ssl", "eq", ("no",)), Filter("industry", "in", ("BUILDING", "MACHINERY")))
    return _relevant(spark, sf, SearchSpec(text="Building, brand#3 CUSTOMER 000000123", filters=filters, page_size=100))


ORACLES["search_relevance"] = _relevance_sql(
    ["building", "brand", "3", "customer", "000000123"], "not has_ssl and industry in ('BUILDING', 'MACHINERY')", 100
)


@query
def search_relevance_all(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold every term."""
    return _relevant(spark, sf, SearchSpec(text="furniture brand 25", page_size=40), every_term=True)


ORACLES["search_relevance_all"] = _relevance_sql(["furniture", "brand", "25"], "true", 40, every=True)

# --- names ------------------------------------------------------------------

_PLAIN = r"nullif(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '')"


@query
def fuzzy_names(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of names that are one typing error apart, over customers and suppliers."""
    return names.similar_names(names.name_classes(B.named_parties(spark, sf)), 1)


_CLASSES = f"""named as (select c_custkey * 2 as id, c_name as name from customer
 union all select s_suppkey * 2 + 1, case when s_suppkey % 3 = 0 then replace(s_name, 'Supplier', 'Custmer') else s_name end from supplier),
classes as materialized (select {_PLAIN.format('name')} as plain, min(id) as class from named group by 1 having plain is not null)"""
ORACLES["fuzzy_names"] = _with(_CLASSES) + (
    "select x.class as a, y.class as b, cast(levenshtein(x.plain, y.plain) as int) as distance from classes x join classes y "
    "on x.class < y.class and abs(length(x.plain) - length(y.plain)) <= 1 and levenshtein(x.plain, y.plain) <= 1"
)


@query
def name_members(spark: SparkSession, sf: str) -> DataFrame:
    """The class of every company: copies of a name are members, not pairs."""
    return names.name_classes(B.named_parties(spark, sf)).select("company_id", "class", "plain")


ORACLES["name_members"] = _with(_CLASSES) + f"select id as company_id, class, plain from named join classes on plain = {_PLAIN.format('name')}"


@query
def search_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """A typed name with errors, by shared trigrams."""
    return names.names_like(B.search_documents(spark, sf), "Custmer 000000123", 0.4, 50)


_PADDED = "list_distinct(flatten(list_transform(list_filter(string_split({0}, ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
ORACLES["search_fuzzy"] = _with(
    f"""cut as (select c_custkey as company_id, c_name as display_name, {_PADDED.format(_PLAIN.format('c_name'))} as own,
 {_PADDED.format("'custmer 000000123'")} as asked from customer),
measured as (select company_id, display_name, round(len(list_intersect(own, asked)) / (len(own) + len(asked) - len(list_intersect(own, asked))), 6) as similarity from cut)"""
) + "select company_id, display_name, similarity from measured where similarity >= 0.4 order by similarity desc, display_name, company_id limit 50"

# --- industries -------------------------------------------------------------

_LEAF = "c_mktsegment || '/' || c_nationkey || '/' || case when c_acctbal < 0 then 'small' else 'large' end"
_INDUSTRIES = f"""leaves as (select distinct c_mktsegment as a, c_mktsegment || '/' || c_nationkey as b, {_LEAF} as c from customer),
industries as (select 'ALL' as node, cast(null as varchar) as above union select a, 'ALL' from leaves union select b, a from leaves union select c, b from leaves),
closure as (select node as ancestor, node, 0 as depth from industries
 union all select i.above, c.node, c.depth + 1 from closure c join industries i on i.node = c.ancestor where i.above is not null),
placed as (select c_custkey as company_id, case when c_custkey % 11 = 5 then null when c_custkey % 7 = 0 then c_mktsegment || '/' || c_nationkey
 when c_custkey % 7 = 1 then c_mktsegment else {_LEAF} end as industry_id from customer)"""
_RECURSIVE = "with recursive "


@query
def industry_closure(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.hierarchy(B.industries(spark, sf)).closure


ORACLES["industry_closure"] = _RECURSIVE + _INDUSTRIES + "select ancestor, node, cast(depth as int) as depth from closure"


@query
def industry_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Companies of every industry, alone and with all below it."""
    return taxonomy.totals(B.company_industries(spark, sf), taxonomy.hierarchy(B.industries(spark, sf)).closure)


ORACLES["industry_totals"] = _RECURSIVE + _INDUSTRIES + (
    "select ancestor as node, count(*) filter (where depth = 0) as own, count(*) as total from closure join placed on industry_id = node group by 1"
)


@query
def search_industry_tree(spark: SparkSession, sf: str) -> DataFrame:
    """A search in two industries that also finds the companies of all industries below them."""
    closure = taxonomy.hierarchy(B.industries(spark, sf)).closure
    documents = B.search_documents(spark, sf).join(B.company_industries(spark, sf), "company_id")
    found = taxonomy.within(documents, closure, ["MACHINERY", "FURNITURE/5", "BUILDING/3/large"])
    return search_items(found, SearchSpec(filters=(Filter("seo_score", "gte", ("10",)),), page_size=100))


ORACLES["search_industry_tree"] = _RECURSIVE + _INDUSTRIES + "," + DOCS + (
    f" select {ITEM} from docs join placed using (company_id) where industry_id in (select node from closure where ancestor in "
    "('MACHINERY', 'FURNITURE/5', 'BUILDING/3/large')) and seo_score >= 10 order by seo_score desc nulls last, display_name, company_id limit 100"
)


@query
def industry_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Industries on a cycle, after every segment was hung below its own first nation."""
    rows = B.industries(spark, sf)
    first = rows.where(F.col("parent_id") != "ALL").where(~F.col("parent_id").contains("/")).groupBy("parent_id").agg(F.min("industry_id").alias("below"))
    hung = rows.join(first.withColumnRenamed("parent_id", "industry_id"), "industry_id", "left")
    hung = hung.select("industry_id", F.coalesce("below", "parent_id").alias("parent_id"))
    return taxonomy.hierarchy(hung).cycles


ORACLES["industry_cycles"] = _RECURSIVE + _INDUSTRIES + "select a as node from leaves union select min(b) from leaves group by a"

# --- crawl depth ------------------------------------------------------------


@query
def crawl_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Links from the home page to every url of its host; pages that nothing links to have none."""
    pages = B.crawled_pages(spark, sf).select("host", "url", "html")
    return depth.page_depths(pages, depth.site_links(pages))


@query
def crawl_depth_summary(spark: SparkSession, sf: str) -> DataFrame:
    return depth.depth_summary(crawl_depth(spark, sf))


@query
def queue_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs waiting at the end of each twelve hours."""
    return stats.queue_depth(B.job_events(spark, sf), JOB_KEY, "12 hours")


ORACLES["queue_depth"] = """with jobs as (select user_id, cast(ts as date) as day, min(ts) as came, min(case when event_type = 'view' then ts end) as started from events group by 1, 2),
moves as (select came as at_, 1 as came, 0 as started from jobs union all select started, 0, 1 from jobs where started is not null),
moved as (select to_timestamp(floor(epoch(at_) / 43200) * 43200)::timestamp as window_start, cast(sum(came) as bigint) as came, cast(sum(started) as bigint) as started from moves group by 1)
select *, cast(sum(came - started) over (order by window_start) as bigint) as waiting from moved"""


def _canonical(url: str) -> str:
    plain = f"regexp_replace(regexp_replace({url}, '#.*$', ''), '^https?://(?:www[.])?', 'https://')"
    path = f"regexp_replace({plain}, '^https://[^/?]*', '')"
    return f"case when {path} = '' then {plain} || '/' when {path} = '/' then {plain} else regexp_replace({plain}, '/+$', '') end"


_DEPTHS = _RECURSIVE + ",".join(
    [
        CAPTURES,
        LINKS,
        f"""own as materialized (select distinct host, {_canonical('url')} as url from site_pages),
edges as materialized (select distinct l.host, {_canonical('b.url')} as url, {_canonical('l.url')} as target from page_links l join site_pages b using (page_id)
 where regexp_replace(regexp_extract(l.url, '//([^/?#]*)', 1), '^www[.]', '') = l.host),
reach as (select distinct host, 'https://' || host || '/' as url, 0 as depth from own
 union select e.host, e.target, r.depth + 1 from reach r join edges e on e.host = r.host and e.url = r.url where r.depth < 25 and e.url <> e.target),
levels as (select host, url, cast(min(depth) as int) as depth from reach group by 1, 2),
depths as (select coalesce(o.host, l.host) as host, coalesce(o.url, l.url) as url, depth, o.url is not null as crawled
 from own o full join levels l on o.host = l.host and o.url = l.url)""",
    ]
)
ORACLES["crawl_depth"] = _DEPTHS + " select * from depths"
ORACLES["crawl_depth_summary"] = _DEPTHS + (
    " select depth, count(*) as urls, count_if(crawled)::bigint as crawled, count(distinct host) as hosts from depths group by depth"
)

# --- locations --------------------------------------------------------------


def _written_sql() -> str:
    """The addresses as the bindings write them."""

    def written(key: str, nation: str) -> str:
        names = "[" + ", ".join(q(x) for x in B.STREETS) + f"][{key} % {len(B.STREETS)} + 1]"
        kinds = "[" + ", ".join("[" + ", ".join(q(x) for x in k) + "]" for k in B.KINDS) + f"][{key} % 3 + 1]"
        kinds += f"[case {key} % 5 when 1 then 2 when 3 then 3 else 1 end]"
        wrong = f"case when {key} % 13 = 4 then substr({names}, 1, 2) || substr({names}, 4) else {names} end"
        line = f"({key} % 7 + 1) || case when {key} % 4 = 2 then ', ' else ' ' end || {wrong} || ' ' || {kinds}"
        return (
            f"case when {key} % 6 = 5 then upper({line}) else {line} end as street, 'City ' || {nation} % 6 || case when {key} % 9 = 0 then '.' else '' end as city, "
            f"case when {key} % 8 <> 3 then cast(10000 + {nation} * 10 + {key} % {len(B.STREETS)} % 2 as varchar) end as postcode, 'Nation ' || {nation} % 5 as country"
        )

    return (
        f"written as (select c_custkey * 2 as company_id, {written('c_custkey', 'c_nationkey')} from customer "
        f"union all select s_suppkey * 2 + 1, {written('(s_suppkey * 3 + 1)', 's_nationkey')} from supplier)"
    )


def _words_out(text: str) -> str:
    for word, shorts in locations.STREET_WORDS.items():
        text = f"regexp_replace({text}, '\\b(?:{'|'.join(shorts)})\\b', '{word}', 'g')"
    return text


_PLACES = _RECURSIVE + ",".join(
    [
        _written_sql(),
        f"""plain as materialized (select company_id, {_words_out(_PLAIN.format('street'))} as street, {_PLAIN.format('city')} as city, cast(null as varchar) as state,
 postcode, {_PLAIN.format('country')} as country from written),
spelled as materialized (select *, regexp_extract(street, '\\b(\\d+\\p{{L}}?)\\b', 1) as number,
 trim(regexp_replace(regexp_replace(street, '\\b\\d+\\p{{L}}?\\b', ' ', 'g'), ' +', ' ', 'g')) as name,
 {'cast(' + chr(39) + '0x' + chr(39) + " || substr(md5(concat_ws('|', street, city, coalesce(postcode, ''), country)), 1, 15) as bigint)"} as spelling from plain),
each as materialized (select spelling, count(*) as n, any_value(street) as street, any_value(city) as city, any_value(state) as state, any_value(postcode) as postcode,
 any_value(country) as country, any_value(number) as number, any_value(name) as name from spelled group by 1),
coded as materialized (select *, coalesce(postcode, case when min(postcode) over s = max(postcode) over s then min(postcode) over s end, '') as code
 from each window s as (partition by country, city, number, name)),
near as materialized (select x.spelling as a, y.spelling as b from coded x join coded y on x.country = y.country and x.city = y.city and x.number = y.number
 and x.code = y.code and levenshtein(x.name, y.name) <= 1),
reach as (select spelling as a, spelling as b from coded union select r.a, n.b from reach r join near n on n.a = r.b),
grouped as (select a as spelling, min(b) as grp from reach group by 1),
ranked as (select *, row_number() over (partition by grp order by n desc, spelling) as place, count(*) over (partition by grp) as spellings, sum(n) over (partition by grp) as total
 from coded join grouped using (spelling)),
places as materialized (select grp, spelling as location_id, street, city, state, postcode, country, spellings, cast(total as bigint) as addresses from ranked where place = 1)""",
    ]
)


@query
def location_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return locations.resolve_locations(B.addresses(spark, sf)).locations


ORACLES["location_dimension"] = _PLACES + " select * exclude (grp) from places"


@query
def company_locations(spark: SparkSession, sf: str) -> DataFrame:
    return locations.resolve_locations(B.addresses(spark, sf)).links


ORACLES["company_locations"] = _PLACES + (
    " select company_id, location_id, count(*) as addresses from spelled join grouped using (spelling) join places using (grp) group by 1, 2"
)

# --- classification, estimates, contacts ------------------------------------

_RULES = classify.evidence_table(
    """
    English | 3 | the, that
    English | 2 | of the, and
    French | 4 | les, est
    French | 2 | la, de la
    German | 3 | der, die
    German | 4 | und
    Spanish | 3 | el, que
    Sale | 7 | we are hiring, about us
    """
)


def _business_sql() -> str:
    cut = f"(case page_id % {len(B.BUSINESS_SNIPPETS)} " + " ".join(f"when {i} then {q(x)}" for i, x in enumerate(B.BUSINESS_SNIPPETS)) + " end)"
    said = f"replace(replace({cut}, '{{host}}', host), '{{id}}', lpad(cast(page_id % 1000 as varchar), 4, '0'))"
    return f"business as materialized (select page_id, company_id, url, page_type, replace(html, '</body>', {said} || '</body>') as html from site_pages)"


def _words_of(text: str) -> str:
    return rf"' ' || trim(regexp_replace(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"


def _shown(markup: str) -> str:
    """Visible text; the two references that are no letters are dropped first."""
    text = f"regexp_replace({markup}, {q(O._ANY_TAG)}, ' ', 'g')"
    return O._decode(f"replace(replace({text}, '&copy;', '©'), '&middot;', ' ')")


_TEXTS = f"""marked as materialized (select page_id, company_id, url, page_type, html, regexp_replace(html, {q(O._OPAQUE)}, ' ', 'g') as markup from business where html is not null),
texts as materialized (select company_id, {_words_of(O._decode(f"regexp_extract_all(markup, {q(O._TITLE)}, 1)[1]"))} as title,
 {_words_of("regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)")} as path, {_words_of(_shown('markup'))} as text from marked)"""


@query
def industry_predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Labels by replaced rules over titles, paths and texts of all pages."""
    return classify.classify(classify.page_texts(B.business_pages(spark, sf)), _RULES, least=8.0, lead=0.25)


def _classified(rules: list, least: float, lead: float) -> str:
    values = ", ".join(f"({i}, {q(r.label)}, {q(r.phrase)}, {r.weight})" for i, r in enumerate(rules))
    return f"""rules(number, label, phrase, weight) as (values {values}),
hits as (select company_id, number, max(case when contains(title, ' ' || phrase || ' ') then 4 when contains(path, ' ' || phrase || ' ') then 2 else 1 end) as factor, count(*) as n
 from texts join rules on contains(title, ' ' || phrase || ' ') or contains(path, ' ' || phrase || ' ') or contains(text, ' ' || phrase || ' ') group by 1, 2),
pointed as (select company_id, label, phrase, (weight * factor * (2 - pow(2.0::double, 1 - least(n, 20))))::double as points from hits join rules using (number)),
sums as (select company_id, label, sum(points) as points, string_agg(phrase, ', ' order by -points, phrase) as phrases from pointed group by 1, 2),
placed as (select *, row_number() over (partition by company_id order by -points, label) as place, sum(points) over (partition by company_id) as total from sums),
best as (select a.company_id, a.label, a.points as score, a.phrases, b.label as runner_up, coalesce(b.points, 0) as behind, a.total from (select * from placed where place = 1) a
 left join (select * from placed where place = 2) b using (company_id)),
judged as (select *, score >= {least}::double and score - behind >= {lead}::double * score as sure from best),
labelled as (select company_id, case when sure then label else 'unknown' end as label, case when sure then round(score / (total + {least}::double), 6) else 0.0 end::double as confidence,
 coalesce(score, 0.0)::double as score, runner_up, case when sure then phrases end as evidence from (select distinct company_id from texts) left join judged using (company_id))"""


ORACLES["industry_predicted"] = _with(CAPTURES, _business_sql(), _TEXTS, _classified(_RULES, 8.0, 0.25)) + "select * from labelled"


@query
def estimate_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Every signal about every company with what was observed."""
    tools = detect.detect_technologies(B.crawled_pages(spark, sf)).groupBy("company_id").agg(F.count("*").alias("technologies"))
    return intelligence.evidence_of(intelligence.page_facts(B.business_pages(spark, sf)), tools, 2024)


@query
def company_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return intelligence.estimates(estimate_evidence(spark, sf))


def _evidence_sql() -> str:
    hiring = " or ".join(f"contains(text, ' {p} ')" for p in intelligence.HIRING)
    steps = lambda n, *rows: " ".join(f"when {n} >= {least} then {{'v': {q(v)}, 'p': {p}::double}}" for least, v, p in rows)
    eras = ((20, "20+"), (10, "10-19"), (5, "5-9"), (0, "0-4"))
    signals = [
        ("employee_range", "page volume", "pages", ((30, "201+", 0.3), (12, "51-200", 0.3), (5, "11-50", 0.25), (1, "1-10", 0.25))),
        ("employee_range", "careers pages", "careers", ((3, "51-200", 0.4), (1, "11-50", 0.3))),
        ("employee_range", "technologies", "tools", ((8, "51-200", 0.3), (4, "11-50", 0.25), (1, "1-10", 0.2))),
        ("revenue_range", "technologies", "tools", ((8, "20M+", 0.25), (4, "1M-20M", 0.25), (1, "under 1M", 0.2))),
        ("revenue_range", "page volume", "pages", ((30, "20M+", 0.25), (12, "1M-20M", 0.25), (1, "under 1M", 0.2))),
        ("hiring_status", "careers pages", "careers", ((3, "hiring", 0.7), (1, "hiring", 0.5), (0, "not hiring", 0.4))),
        ("hiring_status", "phrases", "hiring", ((2, "hiring", 0.7), (1, "hiring", 0.6))),
    ]
    rows = [
        f"select company_id, {q(a)} as attribute, {q(n)} as signal, cast({c} as varchar) as observed, case {steps(c, *rules)} end as s from facts" for a, n, c, rules in signals
    ]
    for column, name, p in (("founded", "founding year", 0.8), ("shown", "copyright year", 0.4)):
        cases = steps(f"2024 - {column}", *[(n, v, p) for n, v in eras])
        rows.append(f"select company_id, 'company_age', {q(name)}, cast({column} as varchar), case {cases} end from facts")
    return rf"""counted as (select company_id, count(*) as pages, count_if(page_type = 'careers') as careers from business group by 1),
shown as (select company_id, min(cast(nullif(regexp_extract(lower(html), '(?:©|&copy;|\(c\)|copyright)[^0-9]{{0,20}}((?:19|20)\d\d)', 1), '') as int)) as shown from business group by 1),
said as (select company_id, count_if({hiring}) as hiring,
 min(cast(nullif(regexp_extract(text, '(?:founded in|established in|established|since|est) ((?:19|20)\d\d) ', 1), '') as int)) as founded from texts group by 1),
tool_counts as (select company_id, count(*) as tools from technologies group by 1),
facts as materialized (select company_id, pages, careers, coalesce(hiring, 0) as hiring, founded, shown, coalesce(tools, 0) as tools
 from counted left join shown using (company_id) left join said using (company_id) left join tool_counts using (company_id)),
evidence as materialized (select company_id, attribute, s.v as value, signal, observed, s.p as probability from ({' union all '.join(rows)}) where s is not null),
valued as (select company_id, attribute, value, round(1 - list_reduce(list_sort(list(probability)), lambda w, p: w * (1 - p), 1.0::double), 6) as confidence, count(*) as signals
 from evidence group by all)"""


_ESTIMATES = _with(*O.TECH, _business_sql(), _TEXTS, _evidence_sql())
ORACLES["estimate_evidence"] = _ESTIMATES + "select * from evidence"
ORACLES["company_estimates"] = _ESTIMATES + (
    "select company_id, attribute, value, confidence, cast(signals as int) as signals from valued "
    "qualify row_number() over (partition by company_id, attribute order by confidence desc, value) = 1"
)


@query
def company_contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Mail addresses, phones and profiles of every company over all its pages."""
    return contacts.company_contacts(B.business_pages(spark, sf))


@query
def best_contacts(spark: SparkSession, sf: str) -> DataFrame:
    return contacts.best_contacts(contacts.company_contacts(B.business_pages(spark, sf)))


_MAIL_SQL = rf"case when regexp_matches({{0}}, '^{contacts.MAIL}$') and not regexp_matches({{0}}, {q(contacts.NOT_MAIL)}) and not contains({{0}}, '..') and length(split_part({{0}}, '@', 1)) <= 64 then {{0}} end"


def _mail(text: str) -> str:
    return _MAIL_SQL.replace("{0}", f"lower(trim({text}))")


def _phone(text: str) -> str:
    digits = f"regexp_replace({text}, '[^0-9]', '', 'g')"
    return (
        f"case when starts_with(trim({text}), '+') and length({digits}) between 8 and 15 then '+' || {digits} "
        f"when not starts_with(trim({text}), '+') and length({digits}) = 10 then {digits} end"
    )


_NETWORKS = " ".join(f"when {q(h)} then {q(k)}" for h, k in contacts.PROFILES.items())
_CONTACTS = _with(
    CAPTURES,
    _business_sql(),
    f"""marked as materialized (select page_id, company_id, page_type, regexp_replace(html, {q(O._OPAQUE)}, ' ', 'g') as markup from business where html is not null),
hrefs as (select page_id, company_id, unnest({O._HREFS}) as href from marked),
linked as (select *, replace(split_part(regexp_replace(href, '(?i)^(?:mailto|tel):', ''), '?', 1), '%20', ' ') as target, lower(split_part(href, ':', 1)) as scheme,
 regexp_replace({O.host('href')}, '^(?:m|[a-z]{{2}})[.]', '') as site,
 regexp_replace(regexp_extract(href, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/+$', '') as path from hrefs),
networked as (select *, case site {_NETWORKS} end as network from linked),
of_links as (select page_id, company_id, case scheme when 'mailto' then 'mail' when 'tel' then 'phone' else network end as kind,
 case when scheme = 'mailto' then {_mail('target')} when scheme = 'tel' then {_phone('target')}
  when network is not null and path <> '' and not regexp_matches(path, {q(contacts.NOT_PROFILE)}) then 'https://' || site || path end as value, 'link' as place from networked),
visible as materialized (select page_id, company_id, case when page_type = 'contact' then 'contact page' else 'text' end as place, {_shown('markup')} as shown from marked),
mails as (select page_id, company_id, place, unnest(regexp_extract_all(shown, {q(contacts.MAIL)})) as m from visible),
phones as (select page_id, company_id, place, unnest(regexp_extract_all(shown, {q(contacts.PHONE)})) as m from visible),
found as (select distinct * from (select page_id, company_id, kind, value, place from of_links union all select page_id, company_id, 'mail', {_mail('m')}, place from mails
 union all select page_id, company_id, 'phone', {_phone('m')}, place from phones) where value is not null),
counted as (select company_id, kind, value, place, count(*) as n from found group by all),
sure as (select company_id, kind, value, cast(sum(n) as bigint) as pages, round(1 - list_reduce(list_sort(list(pow(case place when 'link' then 1 - 0.7::double when 'contact page' then 1 - 0.6::double else 1 - 0.35::double end, least(n, 3)))),
 lambda a, w: a * w, 1.0::double), 6) as confidence from counted group by all)""",
)
ORACLES["company_contacts"] = _CONTACTS + "select company_id, kind, value, confidence, pages from sure"
ORACLES["best_contacts"] = _CONTACTS + (
    "select company_id, kind, value, confidence from sure qualify row_number() over (partition by company_id, kind order by confidence desc, value) = 1"
)

# --- marketing and size in searches -----------------------------------------


def _marketed(spark: SparkSession, sf: str) -> DataFrame:
    """Search documents with the marketing tools and the estimated size of each company."""
    tools = detect.detect_marketing(B.crawled_pages(spark, sf)).groupBy("company_id").agg(F.sort_array(F.collect_set("tool_name")).alias("marketing"))
    size = company_estimates(spark, sf).where("attribute = 'employee_range'").select("company_id", F.col("value").alias("employee_range"))
    return _site_documents(spark, sf).join(tools, "company_id", "left").join(size, "company_id", "left")


@query
def search_marketing(spark: SparkSession, sf: str) -> DataFrame:
    spec = SearchSpec(
        filters=(Filter("marketing", "contains", ("hotjar", "meta pixel", "Google Tag Manager")), Filter("employee_range", "in", ("1-10", "11-50", "51-200"))),
        page_size=100,
    )
    return search_items(_marketed(spark, sf), spec)


@query
def facet_marketing(spark: SparkSession, sf: str) -> DataFrame:
    return facet_counts(_marketed(spark, sf), SearchSpec(filters=(Filter("has_contact_page", "eq", ("false",)),), facets=("marketing", "employee_range")))


_MARKETED = f"""tool_rules(number, ord, tool, pattern) as (values {', '.join(f"({n}, {r.rule}, {q(r.name)}, {q(r.pattern)})" for n, r in enumerate(marketing_rules()))}),
tool_lists as (select company_id, list_sort(list(distinct tool)) as marketing from site_pages join tool_rules on html <> '' and regexp_matches(html, pattern, 'i') group by 1),
sizes as (select company_id, value as employee_range from valued where attribute = 'employee_range' qualify row_number() over (partition by company_id order by confidence desc, value) = 1),
marketed as (select * from documents left join tool_lists using (company_id) left join sizes using (company_id))"""
_BOTH = _with(*O._SITE, _business_sql(), _TEXTS.replace("marked as", "page_marks as").replace("from marked", "from page_marks"), _evidence_sql(), _MARKETED)
ORACLES["search_marketing"] = _BOTH + (
    f"select {ITEM} from marketed where list_has_any(marketing, ['Hotjar', 'Meta Pixel', 'Google Tag Manager']) and employee_range in ('1-10', '11-50', '51-200') "
    "order by seo_score desc nulls last, display_name, company_id limit 100"
)
ORACLES["facet_marketing"] = _BOTH + (
    "select field, value, count(*) as \"count\" from (select 'marketing' as field, unnest(marketing) as value from marketed where not has_contact_page "
    "union all select 'employee_range', employee_range from marketed where not has_contact_page) where value is not null group by all"
)

# --- exports, registration in one pass --------------------------------------


def _exported(spark: SparkSession, sf: str, form: str) -> DataFrame:
    spec = SearchSpec(filters=(Filter("seo_score", "gte", ("50",)),))
    documents = B.search_documents(spark, sf)
    folder = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    export(matching(documents, spec), folder, form, order_of(spec.sort), file_rows=1000)
    return read_export(spark, folder, check=True)


@query
def export_result(spark: SparkSession, sf: str) -> DataFrame:
    """All documents a search finds, written as CSV in its order and read back."""
    return _exported(spark, sf, "csv")


@query
def export_json(spark: SparkSession, sf: str) -> DataFrame:
    return _exported(spark, sf, "json")


ORACLES["export_result"] = ORACLES["export_json"] = _with(DOCS) + "select * from docs where seo_score >= 50"


@query
def first_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Requests accepted by the rule that needs no rounds, over suppliers' and customers' claims in long chains."""
    checked = entities.check_candidates(_candidates(spark, sf))
    claims = checked.where("reason is null").select("request_id", F.inline("hosts")).select("request_id", "hostname")
    chain = B.table(spark, sf, "orders").select(
        (F.col("o_orderkey") + 10_000_000).alias("request_id"),
        F.explode(F.array(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")), F.concat(F.lit("c"), (F.col("o_orderkey") + F.col("o_custkey") % 3).cast("string")))).alias("hostname"),
    )
    return entities.first_claims(claims.union(chain))


ORACLES["first_claims"] = _with(
    O.MODEL,
    O.CANDIDATES,
    """all_claims as (select request_id, hostname from claims union all
 select o_orderkey + 10000000, unnest(['c' || o_orderkey, 'c' || (o_orderkey + o_custkey % 3)]) from orders),
firsts as (select hostname, min(request_id) as f from all_claims group by 1)""",
) + "select request_id from all_claims join firsts using (hostname) group by 1 having bool_and(request_id = f)"

# --- requests, envelopes, stamps, broken pages ------------------------------


@query
def saved_search_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Stored requests made from customers, most of them faulty, with what is wrong first."""
    n = F.col("c_custkey")
    pick = lambda number, options: F.element_at(F.array(*[F.lit(o) for o in options]), (number % len(options) + 1).cast("int"))
    values = F.when(n % 5 == 0, F.array().cast("array<string>")).when(n % 5 == 1, F.array(F.lit("40"))).when(n % 5 == 2, F.array(F.lit("1e1"), F.lit("nan"))).otherwise(
        F.array("c_mktsegment")
    )
    one = F.struct(pick(n, _SAVED_FIELDS).alias("field"), pick(F.floor(n / 7), _SAVED_OPS).alias("op"), values.alias("values"))
    requests = B.table(spark, sf, "customer").select(
        n.alias("request_id"),
        F.array(one).alias("filters"),
        F.when(n % 19 == 0, F.array(F.lit("no_facet"))).alias("facets"),
        F.when(n % 23 == 0, "price").otherwise("name").alias("sort"),
        (n % 29).alias("page"),
        (n % 31 * 7).alias("page_size"),
    )
    return request_errors(requests)


_SAVED_FIELDS = ("industry", "seo_score", "has_ssl", "technology", "revenue", "marketing")
_SAVED_OPS = ("eq", "in", "gte", "is_true", "contains", "like")
ORACLES["saved_search_errors"] = f"""with r as (select c_custkey as n, {O._choose('c_custkey', _SAVED_FIELDS)} as field, {O._choose('(c_custkey // 7)', _SAVED_OPS)} as op,
 case c_custkey % 5 when 0 then 0 when 2 then 2 else 1 end as k, c_custkey % 5 = 1 as number from customer),
kinds as (select *, case field when 'industry' then 'text' when 'seo_score' then 'number' when 'has_ssl' then 'bool' when 'revenue' then null else 'list' end as kind from r),
forms as (select *, case when kind = 'text' and op in ('eq', 'in') or kind = 'number' and op in ('gte', 'lte', 'eq') or kind = 'bool' and op in ('eq', 'is_true')
 or kind = 'list' and op = 'contains' then true else false end as known from kinds)
select n as request_id, case when n % 29 < 1 then 'page' when n % 31 * 7 not between 1 and 200 then 'page size' when n % 23 = 0 then 'sort' when n % 19 = 0 then 'unknown facet'
 when not known then 'unknown filter' when kind = 'number' and k > 0 and not number then 'not a finite number'
 when op = 'eq' and k <> 1 or op in ('gte', 'lte') and k <> 1 or op in ('in', 'contains') and k < 1 then 'number of values' end as reason from forms"""


@query
def search_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of a search's answer as rows: total, page numbers, and how many items and facet rows came."""
    found = search(B.search_documents(spark, sf), SearchSpec(text=" Customer ", filters=(Filter("seo_score", "gte", ("90",)),), facets=("industry",), page=2, page_size=40))
    counts = [found.total, found.items.agg(F.count("*").alias("total")), found.facets.agg(F.count("*").alias("total"))]
    named = [c.select(F.lit(n).alias("part"), F.col("total").alias("value")) for n, c in zip(("total", "items", "facets"), counts, strict=True)]
    bounds = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("part"), F.lit(v).cast("long").alias("value")) for n, v in (("page", found.page), ("page_size", found.page_size))])))
    return maintenance.union_all([*named, bounds])


ORACLES["search_envelope"] = _with(DOCS, "hits as (select * from docs where contains(text_blob, 'customer') and seo_score >= 90)") + (
    "select 'total' as part, count(*) as value from hits union all select 'items', least(greatest(count(*) - 40, 0), 40) from hits "
    "union all select 'facets', count(distinct industry) from hits union all select 'page', 2 union all select 'page_size', 40"
)


@query
def jobs_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """A listing's page with its total beside every item."""
    found = relations.listing(B.crawl_jobs(spark, sf).where("status = 'failed'"), [F.desc("created_at"), F.desc("job_id")], 2, 30)
    total = found.total.scalar()
    return found.items.select("job_id", "created_at", total.alias("total"), F.lit(found.page).alias("page"))


ORACLES["jobs_envelope"] = O.M + (
    "select job_id, created_at, (select count(*) from jobs where status = 'failed') as total, 2 as page from jobs where status = 'failed' "
    "order by created_at desc, job_id desc limit 30 offset 30"
)


@query
def stamped_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Companies with the time of a repeatable run."""
    rows = B.companies(spark, sf).select("company_id", "status")
    return maintenance.stamped(rows, "updated_at", AS_OF).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


ORACLES["stamped_rows"] = O.M + f"select company_id, status, '{AS_OF}' as updated_at from companies"


@query
def malformed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of pages that break off, whose quotes are gone, or whose tags are never closed."""
    pages = B.crawled_pages(spark, sf).select("page_id", "url", "html")
    n, html = F.col("page_id"), F.col("html")
    broken = (
        F.when(n % 4 == 0, F.substring(html, F.lit(1), F.floor(F.length(html) / 2).cast("int")))
        .when(n % 4 == 1, F.replace(html, F.lit('"'), F.lit("")))
        .when(n % 4 == 2, F.replace(F.replace(html, F.lit("</"), F.lit("<")), F.lit("<p>"), F.lit("<p <p>")))
        .otherwise(F.concat(html, F.lit("<a href='/x'><h1")))
    )
    return seo_scan.seo_signals(pages.withColumn("html", broken)).select("page_id", "title", "h1_count", "h2_count", "images_total", "internal_links", "word_count")


_BROKEN = """broken as (select * replace (case page_id % 4 when 0 then substr(html, 1, length(html) // 2) when 1 then replace(html, '"', '')
 when 2 then replace(replace(html, '</', '<'), '<p>', '<p <p>') else html || '<a href=''/x''><h1' end as html) from site_pages)"""
ORACLES["malformed_pages"] = _with(CAPTURES, _BROKEN, O.SEO.replace("from site_pages)", "from broken)", 1)) + (
    "select page_id, case when not regexp_matches(title, '(?i)</?[a-z]') then title end as title, h1_count, h2_count, images_total, internal_links, word_count from signals"
)

__all__ = ["ORACLES", "QUERIES"]
