"""Crawl depth: how many links away from its home page a url of a site stands.

Breadth first: each round joins only the urls of the last level with the links, and drops
what earlier levels have seen. Levels are written to the shared folder as they are found, so a
lost executor costs a round, and the rounds are as many as the deepest url has links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.functions.urls import host_of
from sitescope.operators.frontier import links_of
from sitescope.operators.maintenance import union_all
from sitescope.session import checkpointed

#: Levels after which their union is written as one table.
MERGED = 16


def home_of(host: Column) -> Column:
    return F.concat(F.lit("https://"), host, F.lit("/"))


def canonical(url: Column) -> Column:
    """The url by which pages and links meet: https, no ``www.``, no fragment, no slash at the end; the bare host is its home page."""
    plain = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"^https?://(?:www\.)?", "https://")
    path = F.regexp_replace(plain, "^https://[^/?]*", "")
    return F.when(path == "", F.concat(plain, F.lit("/"))).when(path == "/", plain).otherwise(F.regexp_replace(plain, "/+$", ""))


def site_links(pages: DataFrame) -> DataFrame:
    """(host, url, target): distinct links between urls of one host. ``pages``: host, url, html.

    Links are read where a page is read; only urls move.
    """
    found = pages.select(
        "host",
        canonical(F.col("url")).alias("from"),
        F.explode(links_of(F.coalesce("html", F.lit("")), F.col("url"))).alias("link"),
    ).where(host_of(F.col("link")) == F.col("host"))
    return found.select("host", F.col("from").alias("url"), canonical(F.col("link")).alias("target")).where("url <> target").distinct()


def crawl_depth(links: DataFrame, homes: DataFrame, most: int | None = None) -> DataFrame:
    """(host, url, depth) of all urls that a home page reaches, itself at 0.

    ``links``: host, url, target; ``homes``: host, url. ``most`` ends the walk at that depth.
    """
    links = checkpointed(links.select("host", "url", "target"))
    level = checkpointed(homes.select("host", "url").distinct().withColumn("depth", F.lit(0)))
    seen, depth = [level], 0
    while (most is None or depth < most) and not level.isEmpty():
        depth += 1
        reached = links.join(level.select("host", "url"), ["host", "url"], "left_semi")
        fresh = reached.select("host", F.col("target").alias("url")).distinct()
        fresh = fresh.join(union_all(seen).select("host", "url"), ["host", "url"], "left_anti")
        level = checkpointed(fresh.withColumn("depth", F.lit(depth)))
        seen.append(level)
        if len(seen) > MERGED:
            seen = [checkpointed(union_all(seen))]
    return union_all(seen)


def page_depths(pages: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """(host, url, depth, crawled) of every page and every url reached; a page no link leads to has no depth.

    Home pages are the roots of the hosts that have pages.
    """
    own = pages.select("host", canonical(F.col("url")).alias("url")).distinct()
    homes = own.select("host", home_of(F.col("host")).alias("url")).distinct()
    reached = crawl_depth(links, homes, most)
    return own.withColumn("crawled", F.lit(True)).join(reached, ["host", "url"], "full").select(
        "host", "url", "depth", F.coalesce("crawled", F.lit(False)).alias("crawled")
    )


def depth_summary(depths: DataFrame) -> DataFrame:
    """(depth, urls, crawled, hosts) per level; unreached pages are the level null."""
    return depths.groupBy("depth").agg(
        F.count("*").alias("urls"), F.count_if("crawled").alias("crawled"), F.count_distinct("host").alias("hosts")
    )
