"""What the plans of the costly operators read and move."""

import re

import pytest
from pyspark.sql import functions as F

from sitescope.operators import detect, frontier, projection, quality, relations, seo_scan
from sitescope.sources import bindings as B


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    """Pages in several files, as a large table has them."""
    path = str(tmp_path_factory.mktemp("plans") / "pages")
    frame = spark.range(40).select(
        (F.col("id") % 7).alias("company_id"),
        (F.col("id") % 9).alias("domain_id"),
        F.col("id").alias("page_id"),
        F.lit("https://a.example/").alias("url"),
        F.lit("home").alias("page_type"),
        F.concat(F.lit("h"), F.col("id") % 9).alias("host"),
        F.create_map(F.lit("server"), F.lit("nginx")).alias("headers"),
        F.concat(F.lit("<title>t</title><a href='/about'>"), F.col("id")).alias("html"),
    )
    frame.repartition(8).write.parquet(path)
    return spark.read.parquet(path)


def plan(frame):
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def nodes(frame, kind):
    """The details of every node of a kind, as text."""
    return re.findall(rf"(?m)^\(\d+\) {kind}\b.*\n(?:.+\n)*", plan(frame))


def scans(frame, column):
    return sum(bool(re.search(rf"\b{column}:", text)) for text in nodes(frame, "Scan parquet"))


FRAMES = {
    "seo_scan": lambda p: seo_scan.seo_scan(p),
    "detect_technologies": lambda p: detect.detect_technologies(p),
    "page_facts": lambda p: projection.page_facts(p),
    "link_frontier": lambda p: frontier.link_frontier(p.select("host", "page_id", "html"), order="page_id"),
}


@pytest.mark.parametrize("name", FRAMES)
def test_html_is_read_once_and_never_moved(pages, name):
    frame = FRAMES[name](pages)
    assert scans(frame, "html") == 1
    for kind in ("Exchange", "Sort", "SortAggregate", "HashAggregate", "ObjectHashAggregate"):
        for text in nodes(frame, kind):
            assert not re.search(r"\bhtml#", text), text
    assert "html" not in frame.columns


def test_tables_are_read_once_or_twice(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("company_id"), F.lit("n").alias("display_name"), F.lit("enriched").alias("status")).write.parquet(f"{tmp_path}/c")
    spark.range(90).select(
        F.col("id").alias("domain_id"), (F.col("id") % 60).alias("company_id"), F.lit("a.example").alias("hostname"), F.lit(True).alias("is_primary")
    ).write.parquet(f"{tmp_path}/d")
    companies, domains = spark.read.parquet(f"{tmp_path}/c"), spark.read.parquet(f"{tmp_path}/d")
    detections = spark.createDataFrame([(1, "X", 0.5)], "company_id long, technology string, confidence double")
    catalog, profiles = detections.select("technology"), spark.createDataFrame([(1, 1.0)], "company_id long, score double")
    report = quality.integrity_report(companies, domains, detections, catalog, profiles)
    assert len(nodes(report, "Scan parquet")) == 2
    assert report.filter("rule = 'hostname_not_unique'").first().rows == 90
    assert len(nodes(relations.company_detail(companies, domains), "Scan parquet")) == 4


def _planned(frame):
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_details_sort_no_children_and_make_none_distinct(spark):
    """A task holds one row a parent, whatever the children are; childless parents and NULL keys stay."""
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "job_id long, status string")
    children = spark.createDataFrame([(1, "u"), (1, "v"), (3, "w"), (9, "x"), (None, "y")], "job_id long, url string")
    found = relations.job_detail(parents, children)
    plan = _planned(found)
    assert "ShuffledHashJoin" in plan and not any(x in plan for x in ("SortMergeJoin", "Sort [", "Aggregate"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(
        [(1, "a", "u"), (1, "a", "v"), (2, "b", None), (3, "c", "w"), (None, "d", None)], key=repr
    )


def test_order_lines_of_the_integrity_report_are_not_sorted(spark, sf_dir):
    """Lines stream past their orders, and groups of marks carry a rule's number, not its name."""
    plan = _planned(B.company_technologies(spark, sf_dir))
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    marked = quality.marks(B.companies(spark, sf_dir), quality.failing("blank_display_name", "company_id", F.col("display_name") == ""))
    assert dict(marked.dtypes)["rule"] == "int"
