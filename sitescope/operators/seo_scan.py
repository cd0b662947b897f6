"""SEO signals, scores and the one-profile-per-company scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.functions import html as H
from sitescope.functions.seo import is_indexable, seo_grade, seo_score
from sitescope.functions.urls import host_of

SIGNALS = (
    "title",
    "meta_description",
    "canonical",
    "meta_robots",
    "h1_count",
    "h2_count",
    "has_open_graph",
    "has_twitter_card",
    "has_structured_data",
    "has_ssl",
    "images_total",
    "images_missing_alt",
    "internal_links",
    "external_links",
    "word_count",
)
VITALS = ("cwv_lcp_ms", "cwv_cls", "cwv_inp_ms")


def _parsed_meta(tag: Column) -> Column:
    return F.struct(
        H.attribute(tag, "name").alias("name"),
        H.attribute(tag, "property").alias("property"),
        H.attribute(tag, "content").alias("content"),
    )


def _meta_content(name: str) -> Column:
    first = F.get(F.filter("_metas", lambda m: m["name"] == name), F.lit(0))
    return H.blank_to_null(first["content"])


def _has_meta_prefix(prefix: str) -> Column:
    def key(meta: Column) -> Column:
        return F.lower(F.coalesce(F.nullif(meta["property"], F.lit("")), meta["name"], F.lit("")))

    return F.exists("_metas", lambda m: key(m).startswith(prefix))


def _canonical() -> Column:
    first = F.get(
        F.filter(
            "_links",
            lambda t: F.array_contains(F.split(H.attribute(t, "rel"), r"\s+"), "canonical"),
        ),
        F.lit(0),
    )
    return H.blank_to_null(H.attribute(first, "href"))


def seo_signals(pages: DataFrame) -> DataFrame:
    """Adds the on-page signals to rows with ``url`` and ``html``; drops ``html``.

    Row-local: the page is cleaned once, its tags are listed once, and the signals
    are read from those lists.
    """
    kept = [c for c in pages.columns if c != "html"]
    cleaned = pages.select(
        *kept,
        F.coalesce("html", F.lit("")).alias("_page"),
        H.visible_markup(F.coalesce("html", F.lit(""))).alias("_markup"),
    )
    listed = cleaned.select(
        *kept,
        H.raw_title(F.col("_markup")).alias("title"),
        F.transform(H.tags(F.col("_markup"), "meta"), _parsed_meta).alias("_metas"),
        H.tags(F.col("_markup"), "link").alias("_links"),
        H.tags(F.col("_markup"), "img").alias("_images"),
        H.hrefs(F.col("_markup")).alias("_hrefs"),
        H.count_tags(F.col("_markup"), "h1").alias("h1_count"),
        H.count_tags(F.col("_markup"), "h2").alias("h2_count"),
        H.has_json_ld(F.col("_page")).alias("has_structured_data"),
        H.word_count(F.col("_markup")).alias("word_count"),
        host_of(F.col("url")).alias("_host"),
    )
    absolute = F.filter("_hrefs", lambda h: h.startswith("http://") | h.startswith("https://"))
    own = F.filter(absolute, lambda h: host_of(h) == F.col("_host"))
    rooted = F.filter("_hrefs", lambda h: h.startswith("/"))
    missing_alt = F.filter(
        "_images", lambda i: H.blank_to_null(H.attribute(i, "alt")).isNull()
    )
    return listed.select(
        *kept,
        F.nullif("title", F.lit("")).alias("title"),
        _meta_content("description").alias("meta_description"),
        _canonical().alias("canonical"),
        _meta_content("robots").alias("meta_robots"),
        "h1_count",
        "h2_count",
        _has_meta_prefix("og:").alias("has_open_graph"),
        _has_meta_prefix("twitter:").alias("has_twitter_card"),
        "has_structured_data",
        F.lower("url").startswith("https://").alias("has_ssl"),
        F.size("_images").alias("images_total"),
        F.size(missing_alt).alias("images_missing_alt"),
        (F.size(own) + F.size(rooted)).alias("internal_links"),
        (F.size(absolute) - F.size(own)).alias("external_links"),
        "word_count",
    )


def with_score(signals: DataFrame) -> DataFrame:
    """Adds ``is_indexable``, ``score`` and ``grade``."""
    return (
        signals.withColumn("is_indexable", is_indexable(F.col("meta_robots")))
        .withColumn("score", seo_score())
        .withColumn("grade", seo_grade(F.col("score")))
    )


def _home_rank() -> Column:
    """0 for a home page with HTML, 1 for another page with HTML, 2 for a page without."""
    has_html = F.coalesce(F.col("html") != "", F.lit(False))
    return F.when(has_html & (F.col("page_type") == "home"), 0).when(has_html, 1).otherwise(2)


def homepage_keys(pages: DataFrame) -> DataFrame:
    """company_id and page_id of the page to scan: the first home page with HTML,
    else the first page with HTML, else the first page."""
    # inline() pins the narrow keys below the aggregate; as a plain projection they
    # would be folded into it, and the map-side sort would carry the HTML.
    keys = pages.select(
        "company_id", F.inline(F.array(F.struct(_home_rank().alias("rank"), "domain_id", "page_id")))
    )
    return (
        keys.groupBy("company_id")
        .agg(F.min(F.struct("rank", "domain_id", "page_id")).alias("k"))
        .select("company_id", F.col("k.page_id").alias("page_id"))
    )


def page_signals(pages: DataFrame) -> DataFrame:
    """Signals and ``home_rank`` of every page, without its HTML. Row-local."""
    return seo_signals(pages.withColumn("home_rank", _home_rank()))


def seo_scan(pages: DataFrame, vitals: DataFrame | None = None) -> DataFrame:
    """One scored SEO profile per company, of the page that ``homepage_keys`` names.

    The signals are read where a page is read, so the HTML is read once and is in no
    shuffle; the page of a company is picked from the narrow rows.

    ``vitals`` is an optional table of measured page speeds (url, lcp_ms, cls,
    inp_ms; one row per url). Without it those columns are NULL.
    """
    read = pages.select("company_id", "domain_id", "page_id", "page_type", "url", "html")
    return profiles_of(page_signals(read), vitals)


def profiles_of(signals: DataFrame, vitals: DataFrame | None = None) -> DataFrame:
    """``seo_scan`` from rows that ``page_signals`` made."""
    narrow = signals.select(
        "company_id",
        F.inline(
            F.array(
                F.struct(
                    F.struct("home_rank", "domain_id", "page_id").alias("place"),
                    F.struct("url", *SIGNALS).alias("page"),
                )
            )
        ),
    )
    picked = narrow.groupBy("company_id").agg(F.min_by("page", "place").alias("page"))
    profile = with_score(picked.select("company_id", "page.*"))
    if vitals is None:
        return profile.select(
            "*",
            F.lit(None).cast("int").alias("cwv_lcp_ms"),
            F.lit(None).cast("double").alias("cwv_cls"),
            F.lit(None).cast("int").alias("cwv_inp_ms"),
        )
    measured = vitals.select(
        "url",
        F.col("lcp_ms").cast("int").alias("cwv_lcp_ms"),
        F.col("cls").cast("double").alias("cwv_cls"),
        F.col("inp_ms").cast("int").alias("cwv_inp_ms"),
    )
    return profile.join(measured, "url", "left").select(*profile.columns, *VITALS)
