"""SEO scoring columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points of the checklist (they sum to 100).
TITLE_POINTS = 18
DESCRIPTION_POINTS = 15
SINGLE_H1_POINTS = 12
CANONICAL_POINTS = 10
INDEXABLE_POINTS = 10
OPEN_GRAPH_POINTS = 8
STRUCTURED_DATA_POINTS = 8
SSL_POINTS = 9
ALT_POINTS = 6
INTERNAL_LINKS_POINTS = 4

# Lowest score of each grade, best first; anything lower is F.
GRADE_FLOORS = ((90, "A"), (75, "B"), (60, "C"), (40, "D"))


def is_indexable(meta_robots: Column) -> Column:
    return ~F.lower(F.coalesce(meta_robots, F.lit(""))).contains("noindex")


def alt_coverage(images_total: Column, images_missing_alt: Column) -> Column:
    return F.when(images_total == 0, F.lit(1.0)).otherwise(
        (images_total - images_missing_alt) / F.nullif(images_total, F.lit(0))
    )


def _length_points(text: Column, points: int, low: int, high: int) -> Column:
    return (
        F.when(F.length(text).between(low, high), float(points))
        .when(F.length(text) > 0, points / 2)
        .otherwise(0.0)
    )


def _flag_points(flag: Column, points: int) -> Column:
    return F.when(flag, float(points)).otherwise(0.0)


def seo_score(prefix: str = "") -> Column:
    """Score 0..100 from the signal columns, rounded half to even."""

    def c(name: str) -> Column:
        return F.col(prefix + name)

    total = (
        _length_points(c("title"), TITLE_POINTS, 10, 60)
        + _length_points(c("meta_description"), DESCRIPTION_POINTS, 50, 160)
        + F.when(c("h1_count") == 1, float(SINGLE_H1_POINTS))
        .when(c("h1_count") > 1, SINGLE_H1_POINTS / 2)
        .otherwise(0.0)
        + _flag_points(F.length(c("canonical")) > 0, CANONICAL_POINTS)
        + _flag_points(is_indexable(c("meta_robots")), INDEXABLE_POINTS)
        + _flag_points(c("has_open_graph"), OPEN_GRAPH_POINTS)
        + _flag_points(c("has_structured_data"), STRUCTURED_DATA_POINTS)
        + _flag_points(c("has_ssl"), SSL_POINTS)
        + ALT_POINTS * alt_coverage(c("images_total"), c("images_missing_alt"))
        + _flag_points(c("internal_links") > 0, INTERNAL_LINKS_POINTS)
    )
    return F.bround(F.least(total, F.lit(100.0)), 2)


def seo_grade(score: Column) -> Column:
    """Letter for a score; NULL for a NULL or out-of-range score."""
    grade = F.when(score.isNull() | ~score.between(0, 100), F.lit(None).cast("string"))
    for floor, letter in GRADE_FLOORS:
        grade = grade.when(score >= floor, letter)
    return grade.otherwise("F")
