"""Links of a page and the pages of a site worth fetching next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitescope.functions import html as H
from sitescope.functions.urls import host_of, page_type_of, resolve_url
from sitescope.operators.robots import robots_gate

# Page types followed beyond the home page, and the cap per site.
TARGET_TYPES = ("about", "contact", "blog", "careers", "privacy", "terms")
MAX_PAGES = 8
_NOT_LINKS = ("mailto:", "tel:", "javascript:", "#")


def links_of(page: Column, base: Column) -> Column:
    """Distinct absolute http(s) links of a page in first-seen order."""

    def is_link(href: Column) -> Column:
        skip = href == ""
        for prefix in _NOT_LINKS:
            skip = skip | href.startswith(prefix)
        return ~skip

    wanted = F.filter(H.hrefs(H.visible_markup(page)), is_link)
    resolved = F.transform(wanted, lambda h: resolve_url(base, h))
    http = F.filter(resolved, lambda u: u.startswith("http://") | u.startswith("https://"))
    return F.array_distinct(http)


def extract_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, url: one row per distinct link, ``pos`` in document order."""
    return pages.select(
        "page_id", F.posexplode(links_of(F.col("html"), F.col("url"))).alias("pos", "url")
    )


def first_link_per_type(links: DataFrame, site: str) -> DataFrame:
    """Earliest link of each target page type per site, from rows (site, pos, url)."""
    typed = links.withColumn("page_type", page_type_of(F.col("url")))
    return (
        typed.filter(F.col("page_type").isin(*TARGET_TYPES))
        .groupBy(site, "page_type")
        .agg(F.min(F.struct("pos", "url")).alias("first"))
        .select(site, "page_type", F.col("first.pos").alias("pos"), F.col("first.url").alias("url"))
    )


def cap_per_site(rows: DataFrame, site: str, order: str, limit: int = MAX_PAGES) -> DataFrame:
    """First ``limit`` rows of each site. Spark applies the limit before the shuffle too."""
    turn = F.row_number().over(W.partitionBy(site).orderBy(order))
    return rows.withColumn("_turn", turn).filter(F.col("_turn") <= limit).drop("_turn")


def link_frontier(
    homes: DataFrame,
    policies: DataFrame | None = None,
    max_pages: int | None = None,
    order: str | None = None,
) -> DataFrame:
    """Pages to fetch per site: the home page, then the first link of each target type.

    ``homes``: host, html (one home page per host; with several, ``order`` names the
    column whose smallest value decides). Links are read where a page is read, and only
    the chosen ones, at most one a type, are shuffled. Types are taken in the order
    their first link appears. URLs that robots rules forbid are dropped before the
    cap; a forbidden home page means the site is not followed at all.
    """
    root = F.concat(F.lit("https://"), F.col("host"), F.lit("/"))
    found = homes.select(
        "host",
        (F.lit(0) if order is None else F.col(order)).alias("_place"),
        root.alias("home_url"),
        F.filter(
            links_of(F.coalesce("html", F.lit("")), root), lambda u: host_of(u) == F.col("host")
        ).alias("links"),
    ).withColumn(
        "typed",
        F.transform(
            "links",
            lambda u, i: F.struct(
                (i + 1).alias("pos"), u.alias("url"), page_type_of(u).alias("page_type")
            ),
        ),
    )
    home = F.struct(
        F.lit(0).alias("pos"), F.col("home_url").alias("url"), F.lit("home").alias("page_type")
    )

    def first_of(kind: str) -> Column:
        return F.get(F.filter("typed", lambda t: t["page_type"] == kind), F.lit(0))

    firsts = [first_of(kind) for kind in TARGET_TYPES]
    # inline() keeps the HTML out of the aggregate.
    chosen = found.select(
        "host", F.inline(F.array(F.struct("_place", F.array_compact(F.array(home, *firsts)).alias("_pages"))))
    )
    if order is not None:
        chosen = chosen.groupBy("host").agg(F.min_by("_pages", "_place").alias("_pages"))
    candidates = chosen.select("host", F.inline(F.array_compact("_pages")))
    if policies is not None:
        gated = robots_gate(candidates, policies)
        of_site = W.partitionBy("host")
        home_ok = F.bool_or((F.col("pos") == 0) & F.col("allowed")).over(of_site)
        candidates = (
            gated.withColumn("_home_ok", home_ok).filter("allowed and _home_ok").drop("allowed", "_home_ok")
        )
    return candidates if max_pages is None else cap_per_site(candidates, "host", "pos", max_pages)
