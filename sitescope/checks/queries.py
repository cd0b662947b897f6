"""One runnable query per operator, over the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.functions import urls as U
from sitescope.functions.seo import alt_coverage
from sitescope.operators import (
    detect,
    entities,
    frontier,
    jobs,
    maintenance,
    projection,
    quality,
    relations,
    robots,
    seo_scan,
    stats,
)
from sitescope.plans.search import (
    Filter,
    SearchSpec,
    Sort,
    facet_counts,
    search_items,
    search_total,
    suggest,
)
from sitescope.session import checkpointed, shared_dir
from sitescope.sources import bindings as B
from sitescope.sources.files import read_headers, read_list, read_stream, write_headers, write_list
from sitescope.streaming.enrichment import EnrichmentStore, start_enrichment
from sitescope.streaming.job_state import JobStateStore, job_states, start_job_state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AS_OF = "2024-06-01 00:00:00"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- search -----------------------------------------------------------------

SPECS: dict[str, SearchSpec] = {
    "search_page": SearchSpec(
        text="brand#1",
        filters=(
            Filter("industry", "in", ("BUILDING", "MACHINERY", "FURNITURE")),
            Filter("technology", "contains", ("BRAND#1", "brand#7", "Brand#12")),
            Filter("seo_score", "gte", ("20",)),
            Filter("has_contact_page", "is_true"),
        ),
    ),
    "search_text": SearchSpec(text="  Customer#00000001 ", page_size=200),
    "search_filters_and": SearchSpec(
        filters=(
            Filter("seo_score", "gte", ("40",)),
            Filter("seo_score", "lte", ("75.5",)),
            Filter("state", "eq", ("ASIA",)),
            Filter("has_blog", "eq", ("Yes",)),
        ),
        page_size=200,
    ),
    "search_tech_any": SearchSpec(
        filters=(Filter("technology", "contains", ("BRAND#3", "brand#25")),), page_size=200
    ),
    "search_bool_false": SearchSpec(
        filters=(Filter("has_ssl", "eq", ("no",)), Filter("has_terms", "eq", ("false",))),
        page_size=200,
    ),
    "search_number_eq": SearchSpec(filters=(Filter("seo_score", "eq", ("37",)),), page_size=200),
    "search_grade_city": SearchSpec(
        filters=(
            Filter("seo_grade", "in", ("A", "B")),
            Filter("city", "eq", ("City 3",)),
            Filter("size_bucket", "in", ("51-200", "201+")),
        ),
        page_size=200,
    ),
    "search_sort_name_desc": SearchSpec(sort=Sort("name"), page_size=50),
    "search_sort_name_asc": SearchSpec(sort=Sort("name", False), page=2, page_size=50),
    "search_sort_recency": SearchSpec(sort=Sort("recency"), page_size=40),
    "search_sort_recency_asc": SearchSpec(sort=Sort("recency", False), page_size=40),
    "search_sort_score_asc": SearchSpec(sort=Sort("seo_score", False), page=4, page_size=50),
    "search_page_3": SearchSpec(page=3, page_size=30),
}
FACET_SPECS: dict[str, SearchSpec] = {
    "facet_industry": SearchSpec(facets=("industry",)),
    "facet_technology": SearchSpec(
        filters=(Filter("technology", "contains", ("brand#3",)),), facets=("technology",)
    ),
    "facets_bundle": SearchSpec(
        text="customer",
        filters=(Filter("seo_score", "gte", ("30",)),),
        facets=("industry", "technology", "country", "seo_grade", "seo_score", "has_ssl"),
    ),
}


def _page_query(spec: SearchSpec) -> Query:
    return lambda spark, sf: search_items(B.search_documents(spark, sf), spec)


def _facet_query(spec: SearchSpec) -> Query:
    return lambda spark, sf: facet_counts(B.search_documents(spark, sf), spec)


for _name, _spec in SPECS.items():
    QUERIES[_name] = _page_query(_spec)
for _name, _spec in FACET_SPECS.items():
    QUERIES[_name] = _facet_query(_spec)


@query
def search_total_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return search_total(B.search_documents(spark, sf), SPECS["search_page"])


@query
def search_suggest(spark: SparkSession, sf: str) -> DataFrame:
    return suggest(B.search_documents(spark, sf), " Customer#00000001 ")


@query
def search_far_page(spark: SparkSession, sf: str) -> DataFrame:
    """The page that starts at the 1001st company, by the path for far pages."""
    spec = SearchSpec(sort=Sort("seo_score", False), page=41, page_size=25)
    return search_items(B.search_documents(spark, sf), spec, deep_page=100)


# --- capture, urls, links ---------------------------------------------------


@query
def page_capture(spark: SparkSession, sf: str) -> DataFrame:
    pages = B.crawled_pages(spark, sf)
    return pages.select(
        "page_id",
        "url",
        "page_type",
        "http_status",
        "content_type",
        "title",
        "content_hash",
        F.length("html").alias("html_length"),
        F.element_at("headers", "server").alias("server"),
        F.size("headers").alias("header_count"),
    )


@query
def header_json(spark: SparkSession, sf: str) -> DataFrame:
    """Headers written as JSON text and read back."""
    pages = B.crawled_pages(spark, sf).select("page_id", "headers")
    return read_headers(write_headers(pages)).select(
        "page_id",
        F.element_at("headers", "content-type").alias("content_type"),
        F.element_at("headers", "cf-ray").alias("cf_ray"),
    )


@query
def technology_json(spark: SparkSession, sf: str) -> DataFrame:
    """Technology lists written as JSON text and read back."""
    documents = B.search_documents(spark, sf).select("company_id", "technologies")
    text = write_list(documents).withColumnRenamed("technologies", "text")
    return read_list(text.withColumn("technologies", F.col("text")))


def _raw_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Page URLs, some made dirty by their number."""
    url, n = F.col("url"), F.col("page_id")
    dirty = (
        F.when(n % 7 == 0, F.concat(F.lit("  "), F.upper(url), F.lit("/ ")))
        .when(n % 7 == 1, F.regexp_replace(url, "^https?", "ftp"))
        .when(n % 7 == 2, F.regexp_replace(url, "//[^/]*", "//"))
        .when(n % 7 == 3, F.regexp_replace(url, "//", "//WWW."))
        .when(n % 7 == 4, F.concat(url, F.lit("/;v=1?q=a b#frag")))
        .when(n % 7 == 5, F.regexp_replace(url, "^https?://", ""))
        .otherwise(url)
    )
    return B.table(spark, sf, "pages").select("page_id", dirty.alias("raw"))


@query
def url_normalise(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.col("raw")
    return _raw_urls(spark, sf).select(
        "page_id",
        U.normalize_url(raw).alias("url"),
        U.host_of(U.normalize_url(raw)).alias("host"),
        U.url_rejection(raw).alias("reason"),
    )


@query
def hostname_normalise(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id")
    host = U.authority_of(F.col("url"))
    raw = (
        F.when(n % 6 == 0, F.concat(F.lit(" WWW."), F.upper(host), F.lit("\t")))
        .when(n % 6 == 1, F.concat(host, F.lit("/x")))
        .when(n % 6 == 2, F.replace(host, F.lit("."), F.lit("")))
        .when(n % 6 == 3, F.concat(F.lit("a "), host))
        .when(n % 6 == 4, F.lit(" "))
        .otherwise(host)
    )
    pages = B.table(spark, sf, "pages").select("page_id", raw.alias("raw"))
    return pages.select("page_id", U.normalize_hostname(F.col("raw")).alias("hostname"))


@query
def page_types(spark: SparkSession, sf: str) -> DataFrame:
    return B.captures(spark, sf).select(
        "page_id",
        "url",
        U.host_of(F.col("url")).alias("host"),
        U.page_type_of(F.col("url")).alias("page_type"),
        U.page_type_of(F.col("url"), F.col("page_id") % 10 == 0).alias("forced_type"),
    )


@query
def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.extract_links(B.crawled_pages(spark, sf))


@query
def first_link_per_type(spark: SparkSession, sf: str) -> DataFrame:
    """First link of each type over the pages of a host, page by page."""
    pages = B.crawled_pages(spark, sf).select("page_id", "host", "html", "url")
    links = frontier.extract_links(pages).withColumn("host", U.host_of(F.col("url")))
    placed = links.select("host", F.struct("page_id", "pos").alias("pos"), "url")
    first = frontier.first_link_per_type(placed, "host")
    return first.select("host", "page_type", "pos.page_id", "pos.pos", "url")


def _homes(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with HTML; the first one of every host stands in for its home page."""
    pages = B.crawled_pages(spark, sf)
    return pages.filter("http_status > 0 and content_type = 'text/html'").select("host", "page_id", "html")


@query
def link_frontier(spark: SparkSession, sf: str) -> DataFrame:
    policies = robots.robots_policies(B.robots(spark, sf))
    return frontier.link_frontier(_homes(spark, sf), policies, order="page_id")


@query
def link_frontier_capped(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.link_frontier(_homes(spark, sf), None, max_pages=2, order="page_id")


@query
def robots_policies(spark: SparkSession, sf: str) -> DataFrame:
    found = robots.robots_policies(B.robots(spark, sf))
    return found.select(
        "host",
        "crawl_delay",
        F.size("rules").alias("rule_count"),
        F.array_join(F.transform("rules", lambda r: r["path"]), " ").alias("paths"),
    )


@query
def robots_gate(spark: SparkSession, sf: str) -> DataFrame:
    urls = B.captures(spark, sf).select("page_id", "host", "url")
    return robots.robots_gate(urls, robots.robots_policies(B.robots(spark, sf)))


@query
def polite_schedule(spark: SparkSession, sf: str) -> DataFrame:
    urls = B.captures(spark, sf).select("page_id", "host", "url")
    return robots.polite_schedule(urls, robots.robots_policies(B.robots(spark, sf)))


# --- detection --------------------------------------------------------------


@query
def page_matches(spark: SparkSession, sf: str) -> DataFrame:
    pages = B.crawled_pages(spark, sf)
    return detect.page_matches(pages, detect.technology_rules()).select("page_id", "number", "version")


@query
def rule_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Every HTML pattern of both rule sets with the pages it occurs on, also none."""
    rules = detect.technology_rules() + detect.marketing_rules()
    found = detect.page_matches(B.crawled_pages(spark, sf), rules)
    pages = found.groupBy("number").agg(F.count("*").alias("pages"))
    table = detect.rule_table(spark, rules).filter("kind = 'html'")
    return table.join(pages, "number", "left").select(
        "number", "name", "category", "confidence", "pattern", F.coalesce("pages", F.lit(0)).alias("pages")
    )


@query
def merged_headers(spark: SparkSession, sf: str) -> DataFrame:
    return detect.merged_headers(B.crawled_pages(spark, sf))


@query
def generators(spark: SparkSession, sf: str) -> DataFrame:
    return detect.generators(B.crawled_pages(spark, sf))


@query
def detect_technologies(spark: SparkSession, sf: str) -> DataFrame:
    return detect.detect_technologies(B.crawled_pages(spark, sf))


@query
def detect_marketing(spark: SparkSession, sf: str) -> DataFrame:
    return detect.detect_marketing(B.crawled_pages(spark, sf))


@query
def detect_custom_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Replaced rule set, with a version taken from the page text."""
    rules = detect.technology_rules(
        r"""
        Charset | Custom | html | | 0.5 | charset="(?P<version>[a-z0-9-]+)"
        Charset | Custom | html | | 0.7 | <article>
        Tracker | Custom | html | | 0.6 | track\(\d+\)
        Nginx | Custom | header | server | 0.9 | ^nginx$
        """
    )
    return detect.detect_technologies(B.crawled_pages(spark, sf), rules)


@query
def detect_custom_marketing(spark: SparkSession, sf: str) -> DataFrame:
    """Replaced marketing rule set."""
    rules = detect.marketing_rules(
        r"""
        Tracker | Custom | track\(\d+\)
        Calendar | Custom | calendly\.com/x
        Calendar | Custom | calendly
        Nothing | Custom | no such text
        """
    )
    return detect.detect_marketing(B.crawled_pages(spark, sf), rules)


@query
def detected_companies_by_technology(spark: SparkSession, sf: str) -> DataFrame:
    return detect.companies_by_technology(detect.detect_technologies(B.crawled_pages(spark, sf)))


@query
def technology_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Existing catalog over part brands, extended by detections of part names."""
    existing = B.technologies(spark, sf).filter("technology < 'Brand#20'")
    existing = existing.withColumn("vendor", F.lit(None).cast("string"))
    parts = B.table(spark, sf, "part").select(
        F.col("p_partkey").alias("company_id"),
        F.col("p_brand").alias("technology"),
        F.upper("p_name").alias("category"),
        F.lit(0).alias("ord"),
    )
    return detect.technology_catalog(parts, existing)


# --- seo --------------------------------------------------------------------


@query
def homepage_pick(spark: SparkSession, sf: str) -> DataFrame:
    return seo_scan.homepage_keys(B.crawled_pages(spark, sf))


@query
def seo_signals(spark: SparkSession, sf: str) -> DataFrame:
    pages = B.crawled_pages(spark, sf).select("page_id", "url", "html")
    return seo_scan.seo_signals(pages)


@query
def seo_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of every page, not only of home pages."""
    pages = B.crawled_pages(spark, sf).select("page_id", "url", "html")
    scored = seo_scan.with_score(seo_scan.seo_signals(pages))
    coverage = alt_coverage(F.col("images_total"), F.col("images_missing_alt"))
    return scored.select(
        "page_id", "is_indexable", F.round(coverage, 6).alias("alt_coverage"), "score", "grade"
    )


@query
def seo_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """One profile per company, with page speeds joined in for a part of the URLs."""
    vitals = (
        B.captures(spark, sf)
        .filter(F.col("url").startswith("https:"))
        .groupBy("url")
        .agg(F.min("page_id").alias("n"))
        .select(
            "url",
            (F.col("n") % 4000).alias("lcp_ms"),
            (F.col("n") % 10 / 10).alias("cls"),
            (F.col("n") % 300).alias("inp_ms"),
        )
    )
    found = seo_scan.seo_scan(B.crawled_pages(spark, sf), vitals)
    return found.select(
        "company_id", "url", "score", "grade", "is_indexable", "word_count", *seo_scan.VITALS
    )


# --- projection -------------------------------------------------------------


@query
def page_flags(spark: SparkSession, sf: str) -> DataFrame:
    return projection.page_flags(B.crawled_pages(spark, sf))


@query
def primary_domains(spark: SparkSession, sf: str) -> DataFrame:
    """Flags removed for some companies, restored, and read back."""
    domains = B.domains(spark, sf).withColumn(
        "is_primary", F.col("is_primary") & (F.col("company_id") % 4 != 0)
    )
    return projection.primary_domains(projection.with_primary(domains))


def _site_documents(spark: SparkSession, sf: str) -> DataFrame:
    facts = checkpointed(projection.page_facts(B.crawled_pages(spark, sf)))
    return projection.search_projection(
        B.site_companies(spark, sf),
        B.site_domains(spark, sf),
        facts,
        detect.technologies_of(facts),
        seo_scan.profiles_of(facts),
        AS_OF,
    )


@query
def search_projection(spark: SparkSession, sf: str) -> DataFrame:
    return _site_documents(spark, sf).drop("indexed_at")


@query
def upsert_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of some companies rescored and replaced, one new company added."""
    stored = B.search_documents(spark, sf).filter("size_bucket <> '1-10'")
    fresh = (
        B.search_documents(spark, sf)
        .filter("industry = 'BUILDING' or size_bucket = '1-10'")
        .withColumn("seo_score", F.lit(99.0))
        .withColumn("technologies", F.array(F.lit("Rescan")))
    )
    return projection.upsert_documents(stored, fresh).select(
        "company_id", "display_name", "seo_score", "technologies", "has_ssl", "indexed_at"
    )


@query
def search_over_projection(spark: SparkSession, sf: str) -> DataFrame:
    spec = SearchSpec(
        filters=(Filter("technology", "contains", ("react", "wordpress", "shopify")),),
        sort=Sort("seo_score"),
        page_size=30,
    )
    return search_items(_site_documents(spark, sf), spec)


# --- entities and relations -------------------------------------------------


@query
def company_listing(spark: SparkSession, sf: str) -> DataFrame:
    return relations.company_listing(B.companies(spark, sf), B.domains(spark, sf), 2, 50)


@query
def company_detail(spark: SparkSession, sf: str) -> DataFrame:
    return relations.company_detail(B.companies(spark, sf), B.domains(spark, sf))


@query
def company_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """Companies that a stream of id lookups asks for."""
    asked = B.table(spark, sf, "events").select((F.col("user_id") * 13).alias("company_id"))
    return relations.companies_by_id(B.companies(spark, sf), asked)


@query
def companies_by_hostname(spark: SparkSession, sf: str) -> DataFrame:
    found = entities.companies_by_hostname(B.companies(spark, sf), B.domains(spark, sf))
    return found.select("hostname", "company_id", "display_name", "domain_id")


def _crawl_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests over orders; one customer's host is asked for over and over."""
    key = F.col("o_custkey")
    asked = F.when(F.col("o_orderkey") % 3 == 0, F.lit(7)).otherwise(key)
    host = F.concat(F.lit("customer-"), F.lpad(asked.cast("string"), 9, "0"), F.lit(".example.com"))
    raw = (
        F.when(F.col("o_orderkey") % 10 == 1, F.concat(F.lit(" WWW."), F.upper(host)))
        .when(F.col("o_orderkey") % 50 == 2, F.lit("not a host"))
        .otherwise(host)
    )
    return B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), raw.alias("hostname"))


@query
def request_crawls(spark: SparkSession, sf: str) -> DataFrame:
    made, _ = entities.request_crawls(_crawl_requests(spark, sf), B.domains(spark, sf))
    return made


@query
def rejected_crawls(spark: SparkSession, sf: str) -> DataFrame:
    _, rejects = entities.request_crawls(_crawl_requests(spark, sf), B.domains(spark, sf))
    return rejects


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Registration requests over suppliers and customers, some of them faulty."""
    customers = B.table(spark, sf, "customer")
    n = F.col("c_custkey")
    host = lambda k, tld: F.concat(F.lit("New"), k.cast("string"), F.lit(tld))
    domain = lambda h, p: F.struct(h.alias("hostname"), F.lit(p).alias("is_primary"))
    own = domain(host(n, ".example.org"), False)
    lists = (
        F.when(n % 13 == 1, F.array(own, domain(F.concat(F.lit("www."), host(n, ".example.org")), False)))
        .when(n % 13 == 2, F.array(own, domain(host(n, ".example.net"), True)))
        .when(n % 13 == 3, F.array(domain(F.lit("bad host"), True), own))
        .when(n % 13 == 4, F.array(own, domain(host(n + 1, ".example.org"), False)))
        .when(n % 13 == 6, F.array(domain(F.concat(F.lit("customer-"), F.lpad(n.cast("string"), 9, "0"), F.lit(".example.com")), True)))
        .when(n % 13 == 7, F.array().cast("array<struct<hostname:string,is_primary:boolean>>"))
        .when(n % 13 == 8, F.array(domain(F.lit("popular.example.org"), True)))
        .otherwise(F.array(own))
    )
    return customers.select(
        n.alias("request_id"),
        F.when(n % 17 == 0, F.lit(" \t")).otherwise(F.concat(F.lit(" "), "c_name", F.lit("  "))).alias(
            "display_name"
        ),
        F.col("c_mktsegment").alias("industry"),
        lists.alias("domains"),
    )


@query
def candidate_checks(spark: SparkSession, sf: str) -> DataFrame:
    checked = entities.check_candidates(_candidates(spark, sf))
    return checked.select("request_id", "display_name", "reason", F.size("hosts").alias("hosts"))


@query
def domain_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    checked = entities.check_candidates(_candidates(spark, sf))
    claims = checked.filter("reason is null").select("request_id", F.inline("hosts"))
    return entities.owned_elsewhere(claims, B.domains(spark, sf))


@query
def registered_companies(spark: SparkSession, sf: str) -> DataFrame:
    made = entities.register_companies(_candidates(spark, sf), B.domains(spark, sf))
    return made.companies.select("company_id", "display_name", "industry", "status")


@query
def registered_domains(spark: SparkSession, sf: str) -> DataFrame:
    return entities.register_companies(_candidates(spark, sf), B.domains(spark, sf)).domains


@query
def registration_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return entities.register_companies(_candidates(spark, sf), B.domains(spark, sf)).rejects


@query
def list_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return relations.list_jobs(B.crawl_jobs(spark, sf), "failed", 3, 40)


@query
def pending_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return relations.pending_jobs(B.crawl_jobs(spark, sf))


@query
def job_detail(spark: SparkSession, sf: str) -> DataFrame:
    return relations.job_detail(B.crawl_jobs(spark, sf), B.job_pages(spark, sf)).select(
        "job_id", "status", "page_no", "url", "page_type", "http_status"
    )


@query
def job_pages_in_order(spark: SparkSession, sf: str) -> DataFrame:
    pages = B.job_pages(spark, sf).select("job_id", "page_no", "url")
    return relations.facts_in_order(pages, "job_id", "page_no")


@query
def domain_pages(spark: SparkSession, sf: str) -> DataFrame:
    found = relations.domain_pages(B.crawl_jobs(spark, sf), B.job_pages(spark, sf))
    return found.select("domain_id", "job_id", "page_no", "url")


@query
def company_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by company over its domains; some pages belong to domains nobody owns."""
    pages = relations.domain_pages(B.crawl_jobs(spark, sf), B.job_pages(spark, sf))
    found = relations.company_pages(B.domains(spark, sf), pages)
    return found.select("company_id", "hostname", "domain_id", "job_id", "page_no", "url")


@query
def pages_per_job(spark: SparkSession, sf: str) -> DataFrame:
    return relations.pages_per_job(B.crawl_jobs(spark, sf), B.job_pages(spark, sf))


@query
def company_technology_list(spark: SparkSession, sf: str) -> DataFrame:
    return relations.with_catalog(B.company_technologies(spark, sf), B.technologies(spark, sf))


@query
def company_facts(spark: SparkSession, sf: str) -> DataFrame:
    return relations.facts_in_order(B.company_technologies(spark, sf), "company_id", "technology")


@query
def company_marketing(spark: SparkSession, sf: str) -> DataFrame:
    """Marketing tools of every company in their stored order."""
    return relations.facts_in_order(detect.detect_marketing(B.crawled_pages(spark, sf)), "company_id", "ord")


@query
def company_seo(spark: SparkSession, sf: str) -> DataFrame:
    """Companies with their stored score, and those that have none."""
    scores = B.search_documents(spark, sf).select("company_id", "seo_score").filter("seo_score is not null")
    return B.companies(spark, sf).select("company_id", "display_name").join(scores, "company_id", "left")


@query
def missing_companies(spark: SparkSession, sf: str) -> DataFrame:
    asked = B.table(spark, sf, "events").select((F.col("user_id") * 13).alias("company_id"))
    return maintenance.missing_keys(asked, B.companies(spark, sf), "company_id")


@query
def catalog_page(spark: SparkSession, sf: str) -> DataFrame:
    return relations.catalog_page(B.technologies(spark, sf), 1, 10)


@query
def companies_by_technology(spark: SparkSession, sf: str) -> DataFrame:
    return detect.companies_by_technology(B.company_technologies(spark, sf))


@query
def dashboard_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return relations.dashboard_kpis(
        B.companies(spark, sf), B.crawl_jobs(spark, sf), B.technologies(spark, sf)
    )


# --- maintenance and integrity ----------------------------------------------


def _seo_rows(spark: SparkSession, sf: str, base: str) -> DataFrame:
    """Scores per customer: stored ones over customers, new ones over orders."""
    if base == "stored":
        return B.table(spark, sf, "customer").select(
            F.col("c_custkey").alias("company_id"),
            F.round("c_acctbal", 2).alias("score"),
            F.to_timestamp_ntz(F.lit("1999-01-01 00:00:00")).alias("scanned_at"),
        )
    return B.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("company_id"),
        F.col("o_totalprice").alias("score"),
        F.col("o_orderdate").alias("scanned_at"),
    )


@query
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.upsert_latest(
        _seo_rows(spark, sf, "stored"), _seo_rows(spark, sf, "new"), ["company_id"], "scanned_at"
    )


@query
def replace_for_company(spark: SparkSession, sf: str) -> DataFrame:
    """Detections of two industries replaced: by one new row each, or by none."""
    old = B.company_technologies(spark, sf)
    keys = B.companies(spark, sf).filter("industry in ('MACHINERY', 'BUILDING')")
    new = keys.filter("industry = 'BUILDING'").select(
        "company_id", F.lit("Rescan").alias("technology"), F.lit(0.5).alias("confidence")
    )
    return maintenance.replace_for_keys(old, new, keys, "company_id")


@query
def update_domain_status(spark: SparkSession, sf: str) -> DataFrame:
    changes = B.crawl_jobs(spark, sf).groupBy("domain_id").agg(
        F.max_by(
            F.when(F.col("status") == "completed", "crawled").when(
                F.col("status") == "failed", "failed"
            ),
            F.struct("created_at", "job_id"),
        ).alias("crawl_status")
    )
    return maintenance.update_in_place(B.domains(spark, sf), changes, "domain_id", ["crawl_status"])


@query
def update_job_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs whose pages all came back are completed, and their error is cleared."""
    done = B.job_pages(spark, sf).groupBy("job_id").agg(
        F.max("http_status").alias("worst"), F.count("*").cast("int").alias("attempts")
    )
    changes = done.filter("worst = 200").select(
        "job_id", F.lit("completed").alias("status"), "attempts", F.lit(None).cast("string").alias("error")
    )
    return maintenance.update_in_place(
        B.crawl_jobs(spark, sf), changes, "job_id", ["status", "attempts", "error"], null_clears=True
    )


@query
def unknown_domains_in_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.missing_keys(B.crawl_jobs(spark, sf), B.domains(spark, sf), "domain_id")


@query
def append_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs made from crawl requests, appended to the stored ones."""
    made, _ = entities.request_crawls(_crawl_requests(spark, sf), B.domains(spark, sf))
    stored = B.crawl_jobs(spark, sf).select("job_id", "domain_id", "status", "attempts")
    named = made.select(
        F.col("job_id").alias("request_id"), "domain_id", "status", "attempts"
    )
    all_jobs = maintenance.append_rows(stored, named, "job_id", ["request_id"])
    return all_jobs.groupBy("status").agg(
        F.count("*").alias("jobs"), F.count_distinct("job_id").alias("ids")
    )


@query
def delete_companies(spark: SparkSession, sf: str) -> DataFrame:
    """Domains left after the discovered companies of one industry are deleted."""
    companies = B.companies(spark, sf)
    doomed = companies.filter("industry = 'MACHINERY' and status = 'discovered'")
    _, kept = maintenance.delete_with_children(companies, B.domains(spark, sf), doomed, "company_id")
    return kept


@query
def integrity_report(spark: SparkSession, sf: str) -> DataFrame:
    """All rule violations in tables that were damaged by key."""
    n = F.col("company_id")
    companies = B.companies(spark, sf).withColumn(
        "display_name", F.when(n % 97 == 0, F.lit(" ")).otherwise(F.col("display_name"))
    )
    domains = B.domains(spark, sf)
    damaged = (
        domains.withColumn(
            "hostname",
            F.when(n % 101 == 5, F.lit("no_dot")).when(n % 89 == 4, F.lit("WWW.same.example.com")).otherwise(
                F.col("hostname")
            ),
        )
        .withColumn("is_primary", F.col("is_primary") | (n % 45 == 0))
        .withColumn("company_id", F.when(n % 83 == 3, -n).otherwise(n))
    )
    detections = B.company_technologies(spark, sf).withColumn(
        "confidence", F.when(n % 211 == 0, F.lit(1.5)).otherwise(F.col("confidence"))
    )
    catalog = B.technologies(spark, sf).filter("technology <> 'Brand#7'")
    profiles = _seo_rows(spark, sf, "stored").withColumn("score", F.col("score") / 100)
    report = quality.integrity_report(companies, damaged, detections, catalog, profiles)
    return report


@query
def crawl_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs of unknown domains, pages of jobs that are gone, tools of companies that are gone."""
    jobs_, companies = B.crawl_jobs(spark, sf), B.site_companies(spark, sf)
    return quality.crawl_orphans(
        jobs_,
        B.domains(spark, sf),
        B.job_pages(spark, sf),
        jobs_.filter("job_id % 50 <> 1"),
        detect.detect_marketing(B.crawled_pages(spark, sf)),
        companies.filter("company_id % 4 <> 0"),
    )


@query
def integrity_summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.summary(integrity_report(spark, sf))


# --- job lifecycle ----------------------------------------------------------

JOB_KEY = ("user_id", "day")


@query
def job_fold(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.fold_events(B.job_events(spark, sf), JOB_KEY)


# --- statistics -------------------------------------------------------------


@query
def stats_overview(spark: SparkSession, sf: str) -> DataFrame:
    return stats.overview(B.companies(spark, sf), B.domains(spark, sf))


@query
def stats_industries(spark: SparkSession, sf: str) -> DataFrame:
    return stats.companies_per(B.companies(spark, sf), "industry")


@query
def stats_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    scores = B.search_documents(spark, sf).filter("seo_score is not null")
    return stats.pipeline(B.companies(spark, sf), B.domains(spark, sf), scores)


@query
def crawl_throughput(spark: SparkSession, sf: str) -> DataFrame:
    return stats.crawl_throughput(B.job_pages(spark, sf), "30 days")


# --- streams ----------------------------------------------------------------


def _run_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream; the pattern lets it be one file as well as a folder.

    The stream runs in a session of its own with one state partition per core: a
    stream keeps that number for life, so it should follow the cluster.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return read_stream(own, f"{sf}/{name}.parque[t]", B.table(spark, sf, name).schema)


@query
def stream_job_state(spark: SparkSession, sf: str) -> DataFrame:
    raw = _stream_of(spark, sf, "events")
    run = _run_dir(spark, "job-state")
    store = JobStateStore(spark, f"{run}/state", JOB_KEY, "user_id long, day date")
    started = start_job_state(B.job_events_from(raw), store, f"{run}/checkpoint")
    return job_states(store, started)


@query
def stream_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    raw = _stream_of(spark, sf, "pages")
    run = _run_dir(spark, "enrichment")
    store = EnrichmentStore(spark, f"{run}/tables")
    started = start_enrichment(
        B.captures_from(raw),
        store,
        B.site_companies(spark, sf),
        B.site_domains(spark, sf),
        f"{run}/checkpoint",
        AS_OF,
    )
    started.awaitTermination()
    shape = _site_documents(spark, sf)
    return store.table("documents", shape).read().drop("indexed_at")
