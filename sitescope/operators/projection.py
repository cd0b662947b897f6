"""The denormalised search document: one row per company."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.functions.seo import seo_grade
from sitescope.operators.detect import with_hits, with_tools
from sitescope.operators.maintenance import stamped, upsert_latest
from sitescope.operators.seo_scan import page_signals

# Which page type sets which flag.
PAGE_FLAGS = {
    "has_contact_page": "contact",
    "has_careers_page": "careers",
    "has_blog": "blog",
    "has_privacy": "privacy",
    "has_terms": "terms",
}


def page_facts(pages: DataFrame, rules=None, tools: bool = False) -> DataFrame:
    """What the enrichments need of each page, from one pass over its HTML.

    Hits of the technology rules and SEO signals, some hundred bytes a page. Stored
    once, the rows serve ``technologies_of``, ``profiles_of`` and ``page_flags``; with ``tools``
    also ``marketing_of``.
    """
    read = pages.select("company_id", "domain_id", "page_id", "url", "page_type", "headers", "html")
    found = with_hits(read, rules).drop("headers")
    return page_signals(with_tools(found) if tools else found)


def page_flags(pages: DataFrame) -> DataFrame:
    """Which kinds of page each company has; never reads the HTML."""
    return pages.groupBy("company_id").agg(
        *[F.bool_or(F.col("page_type") == kind).alias(flag) for flag, kind in PAGE_FLAGS.items()]
    )


def with_primary(domains: DataFrame) -> DataFrame:
    """The first domain of a company becomes primary when none is flagged."""
    per_company = domains.groupBy("company_id").agg(
        F.bool_or("is_primary").alias("_flagged"), F.min("domain_id").alias("_first")
    )
    placed = domains.join(per_company, "company_id", "left")
    promoted = ~F.col("_flagged") & (F.col("domain_id") == F.col("_first"))
    return placed.withColumn("is_primary", F.col("is_primary") | promoted).select(*domains.columns)


def primary_domains(domains: DataFrame, hostname: str = "hostname") -> DataFrame:
    """First flagged domain of each company."""
    return (
        domains.filter("is_primary")
        .groupBy("company_id")
        .agg(F.min_by(hostname, "domain_id").alias("primary_domain"))
    )


def technology_lists(company_technologies: DataFrame) -> DataFrame:
    """Technology names per company in detection order; a company has at most as
    many as the rule set has rules."""
    names = F.sort_array(F.collect_set(F.struct("ord", "technology")))
    return (
        company_technologies.groupBy("company_id")
        .agg(names.alias("_t"))
        .select("company_id", F.transform("_t", lambda t: t["technology"]).alias("technologies"))
    )


def text_blob(name, industry, technologies):
    """Lower-cased name, industry and technologies, blanks left out."""
    parts = F.filter(
        F.concat(F.array(name, industry), technologies), lambda p: F.coalesce(p != "", F.lit(False))
    )
    return F.lower(F.array_join(parts, " "))


def search_projection(
    companies: DataFrame,
    domains: DataFrame,
    pages: DataFrame,
    company_technologies: DataFrame,
    seo_profiles: DataFrame,
    as_of=None,
) -> DataFrame:
    """Search documents from the normalised tables.

    Each input is reduced to one row per company before the joins, so every join is
    between unique keys.
    """
    seo = seo_profiles.select("company_id", "has_ssl", F.col("score").alias("seo_score"))
    joined = (
        companies.select("company_id", "display_name", "industry", "size_bucket")
        .join(primary_domains(domains), "company_id", "left")
        .join(technology_lists(company_technologies), "company_id", "left")
        .join(seo, "company_id", "left")
        .join(page_flags(pages), "company_id", "left")
    )
    technologies = F.coalesce("technologies", F.array().cast("array<string>"))
    no = F.lit(False)
    unknown = F.lit(None).cast("string")
    documents = joined.select(
        "company_id",
        "display_name",
        "primary_domain",
        "industry",
        unknown.alias("country"),
        unknown.alias("state"),
        unknown.alias("city"),
        "size_bucket",
        "seo_score",
        seo_grade(F.col("seo_score")).alias("seo_grade"),
        technologies.alias("technologies"),
        F.coalesce("has_ssl", no).alias("has_ssl"),
        *[F.coalesce(flag, no).alias(flag) for flag in PAGE_FLAGS],
        text_blob(F.col("display_name"), F.col("industry"), technologies).alias("text_blob"),
    )
    return stamped(documents, "indexed_at", as_of)


def upsert_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The search table after inserting documents or replacing them whole."""
    return upsert_latest(existing, incoming, ["company_id"], "indexed_at")
