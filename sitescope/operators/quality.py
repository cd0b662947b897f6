"""Integrity rules as violation reports: rows of (rule, key, rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.functions.urls import normalize_hostname, strip_ws
from sitescope.operators.maintenance import union_all


#: Rules by number: marks carry the number, a tenth of the name's bytes in every group of an aggregation.
RULES = (
    "blank_display_name",
    "invalid_hostname",
    "hostname_twice_in_company",
    "several_primaries",
    "hostname_not_unique",
    "domain_without_company",
    "enriched_without_domain",
    "confidence_out_of_range",
    "technology_twice_in_company",
    "technology_name_not_unique",
    "detection_without_technology",
    "score_out_of_range",
    "several_seo_profiles",
    "job_without_domain",
    "page_without_job",
    "tool_without_company",
)


def _key(*columns: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def _mark(rule: str, key: Column, when: Column | None = None, child: int = 1, row: bool = False) -> Column:
    """One mark of a rule: a child or a parent of a key, or a broken row (which has its own number)."""
    mark = F.struct(
        F.lit(RULES.index(rule)).alias("rule"),
        key.cast("string").alias("key"),
        F.lit(child).cast("long").alias("n"),
        (F.monotonically_increasing_id() if row else F.lit(-1).cast("long")).alias("row"),
    )
    return mark if when is None else F.when(when, mark)


def failing(rule: str, key: str, bad: Column) -> Column:
    """A row that breaks a row rule; a NULL test counts as broken."""
    return _mark(rule, F.col(key), F.coalesce(bad, F.lit(True)), row=True)


def marks(frame: DataFrame, *found: Column) -> DataFrame:
    """All marks of a table, from one pass over it; ``failing`` gives none for rows that pass."""
    return frame.select(F.inline(F.array_compact(F.array(*found))))


def violations(marked: DataFrame, repeated: Sequence[str] = (), orphans: Sequence[str] = ()) -> DataFrame:
    """Rows (rule, key, rows) from the marks of all tables, in one aggregation.

    A rule in ``repeated`` is broken by a key with several children, one in ``orphans`` by a
    key with children and no parent (``n`` is 0), any other by each of its marks. Keys are
    counted on the map side first, so a key of very many rows is no burden.
    """
    counted = marked.groupBy("rule", "key", "row").agg(F.sum("n").alias("rows"), F.min("n").alias("_least"))
    several, without = (F.col("rule").isin(*map(RULES.index, names)) for names in (repeated, orphans))
    broken = F.when(several, F.col("rows") > 1).when(without, F.col("_least") > 0).otherwise(True)
    name = F.element_at(F.array(*map(F.lit, RULES)), F.col("rule") + 1)
    return counted.filter(broken).select(name.alias("rule"), "key", "rows")


def integrity_report(
    companies: DataFrame,
    domains: DataFrame,
    company_technologies: DataFrame,
    technologies: DataFrame,
    seo_profiles: DataFrame,
) -> DataFrame:
    """Every violation of the entity rules, over whole tables; each is read once."""
    company, enriched = _key("company_id"), F.col("status") == "enriched"
    normal = normalize_hostname(F.col("hostname"))
    hostname = F.coalesce(normal, F.col("hostname"))
    marked = [
        marks(
            companies,
            failing("blank_display_name", "company_id", strip_ws(F.col("display_name")) == ""),
            _mark("domain_without_company", company, child=0),
            _mark("enriched_without_domain", company, enriched),
        ),
        marks(
            domains,
            failing("invalid_hostname", "domain_id", normal.isNull()),
            _mark("hostname_twice_in_company", F.concat_ws("|", F.col("company_id").cast("string"), hostname)),
            _mark("several_primaries", company, F.col("is_primary")),
            _mark("hostname_not_unique", hostname),
            _mark("domain_without_company", company, F.col("company_id").isNotNull()),
            _mark("enriched_without_domain", company, child=0),
        ),
        marks(
            company_technologies,
            failing("confidence_out_of_range", "company_id", ~F.col("confidence").between(0, 1)),
            _mark("technology_twice_in_company", _key("company_id", "technology")),
            _mark("detection_without_technology", F.col("technology"), F.col("technology").isNotNull()),
        ),
        marks(
            technologies,
            _mark("technology_name_not_unique", F.col("technology")),
            _mark("detection_without_technology", F.col("technology"), child=0),
        ),
        marks(
            seo_profiles,
            failing("score_out_of_range", "company_id", ~F.col("score").between(0, 100)),
            _mark("several_seo_profiles", company),
        ),
    ]
    return violations(
        union_all(marked),
        repeated=(
            "hostname_twice_in_company",
            "several_primaries",
            "hostname_not_unique",
            "technology_twice_in_company",
            "technology_name_not_unique",
            "several_seo_profiles",
        ),
        orphans=("domain_without_company", "detection_without_technology", "enriched_without_domain"),
    )


def crawl_orphans(
    jobs: DataFrame,
    domains: DataFrame,
    pages: DataFrame,
    kept_jobs: DataFrame,
    marketing: DataFrame,
    companies: DataFrame,
) -> DataFrame:
    """Foreign keys of jobs, pages and marketing tools whose parent is gone."""
    links = (
        ("job_without_domain", "domain_id", jobs, domains),
        ("page_without_job", "job_id", pages, kept_jobs),
        ("tool_without_company", "company_id", marketing, companies),
    )
    marked = []
    for rule, key, children, parents in links:
        marked.append(marks(children, _mark(rule, F.col(key), F.col(key).isNotNull())))
        marked.append(marks(parents, _mark(rule, F.col(key), child=0)))
    return violations(union_all(marked), orphans=[rule for rule, *_ in links])


def summary(report: DataFrame) -> DataFrame:
    """Violations per rule."""
    return report.groupBy("rule").agg(F.count("*").alias("violations"), F.sum("rows").alias("rows"))
