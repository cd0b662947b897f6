"""Reads over the normalised tables: listings, details and lookups.

Details are flat (one row per child) rather than one row with a nested list, so a
parent with very many children is never gathered in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.operators.skew import page_of

# List page sizes, the worker's batch, and the largest page.
DEFAULT_PAGE_SIZE = 25
CATALOG_PAGE_SIZE = 50
WORKER_BATCH = 50
MAX_PAGE_SIZE = 200


def _listed(rows: DataFrame, order: list, page: int, page_size: int) -> DataFrame:
    """A page of a listing; the sizes a listing accepts are bounded."""
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size must lie in 1..{MAX_PAGE_SIZE}")
    return page_of(rows, order, page, page_size)


@dataclass(frozen=True)
class Listing:
    """One page of a listing with the total over all pages, as lazy frames."""

    items: DataFrame
    total: DataFrame
    page: int
    page_size: int


def listing(rows: DataFrame, order: list, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> Listing:
    total = rows.agg(F.count("*").alias("total"))
    return Listing(_listed(rows, order, page, page_size), total, page, page_size)


def rows_with_parent(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Parents with their children, and childless parents with NULL child columns.

    An inner join can split the children of one parent over tasks; an outer join cannot, so
    it reads only their keys. In both a task keeps the parents of its keys in memory, one row
    each, and streams the children, which are neither sorted nor made distinct.
    """
    kept = parents.hint("shuffle_hash")
    with_parent = children.join(kept, key)
    seen = children.select(key, F.lit(True).alias("_seen"))
    childless = kept.join(seen, key, "left").where(F.col("_seen").isNull()).drop("_seen")
    columns = [key, *[c for c in parents.columns if c != key], *[c for c in children.columns if c != key]]
    return with_parent.select(*columns).unionByName(childless, allowMissingColumns=True).select(*columns)


def company_listing(
    companies: DataFrame, domains: DataFrame, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE
) -> DataFrame:
    """A page of companies, newest first, with their domains."""
    listed = _listed(companies, [F.desc("created_at"), F.desc("company_id")], page, page_size)
    on_page = F.broadcast(listed.select("company_id"))  # one page of ids
    mine = domains.join(on_page, "company_id", "left_semi")
    return rows_with_parent(mine, listed, "company_id")


def company_detail(companies: DataFrame, domains: DataFrame, company_id: int | None = None):
    """Companies with their domains; one company when an id is given."""
    if company_id is not None:
        companies = companies.filter(F.col("company_id") == company_id)
        domains = domains.filter(F.col("company_id") == company_id)
    return rows_with_parent(domains, companies, "company_id")


def list_jobs(
    jobs: DataFrame, status: str | None = None, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE
) -> DataFrame:
    """A page of crawl jobs, newest first, optionally of one status."""
    rows = jobs if status is None else jobs.filter(F.col("status") == status)
    return _listed(rows, [F.desc("created_at"), F.desc("job_id")], page, page_size)


def pending_jobs(jobs: DataFrame, limit: int = WORKER_BATCH) -> DataFrame:
    """The jobs a worker takes next: the newest pending ones."""
    return list_jobs(jobs, "pending", 1, limit)


def job_detail(jobs: DataFrame, pages: DataFrame, job_id: int | None = None) -> DataFrame:
    """Jobs with the pages they recorded."""
    if job_id is not None:
        jobs = jobs.filter(F.col("job_id") == job_id)
        pages = pages.filter(F.col("job_id") == job_id)
    return rows_with_parent(pages, jobs, "job_id")


def pages_per_job(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    counted = pages.groupBy("job_id").agg(F.count("*").alias("pages_crawled"))
    return jobs.join(counted, "job_id", "left").select(
        "job_id", "status", F.coalesce("pages_crawled", F.lit(0)).alias("pages_crawled")
    )


def domain_pages(jobs: DataFrame, pages: DataFrame, domain_id: int | None = None) -> DataFrame:
    """Pages with the domain whose job recorded them: of one domain, or of all."""
    if domain_id is not None:
        jobs = jobs.filter(F.col("domain_id") == domain_id)
    return pages.join(jobs.select("job_id", "domain_id"), "job_id")


def company_pages(domains: DataFrame, pages: DataFrame, company_id: int | None = None) -> DataFrame:
    """Pages, which know only their domain, with the company that owns it.

    Pages of a domain that no company owns are left out; a domain with very many pages
    is split by Spark's skew join.
    """
    if company_id is not None:
        domains = domains.filter(F.col("company_id") == company_id)
    return pages.join(domains.select("domain_id", "company_id", "hostname"), "domain_id")


def catalog_page(technologies: DataFrame, page: int = 1, page_size: int = CATALOG_PAGE_SIZE):
    """A page of the technology catalog by name."""
    return _listed(technologies, [F.asc("technology")], page, page_size)


def with_catalog(company_technologies: DataFrame, technologies: DataFrame) -> DataFrame:
    """Detections with the category of their technology."""
    dim = technologies.select("technology", "category")
    return company_technologies.join(dim, "technology", "left")


def facts_in_order(
    facts: DataFrame, key: str, order: str, value: int | None = None
) -> DataFrame:
    """Child rows in their stored order: of one parent, or of all, parent by parent."""
    if value is not None:
        facts = facts.filter(F.col(key) == value)
    return facts.orderBy(key, order)


def companies_by_id(companies: DataFrame, requested: DataFrame) -> DataFrame:
    """The companies whose ids were asked for, each once however often it was."""
    return companies.join(requested.select("company_id").distinct(), "company_id", "left_semi")


def dashboard_kpis(companies: DataFrame, jobs: DataFrame, technologies: DataFrame) -> DataFrame:
    """Four totals as rows (kpi, value)."""
    job_totals = jobs.agg(
        F.count("*").alias("jobs"), F.count_if(F.col("status") == "pending").alias("pending")
    )
    stacked = job_totals.select(
        F.inline(
            F.array(
                F.struct(F.lit("crawl_jobs").alias("kpi"), F.col("jobs").alias("value")),
                F.struct(F.lit("pending_crawls").alias("kpi"), F.col("pending").alias("value")),
            )
        )
    )
    one = lambda name, df: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("kpi"), "value")
    return one("companies", companies).unionByName(stacked).unionByName(one("technologies", technologies))
