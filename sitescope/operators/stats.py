"""Totals and distributions over the pipeline's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overview(companies: DataFrame, domains: DataFrame) -> DataFrame:
    """Totals as rows (kpi, value): companies, domains, crawled domains."""
    per_status = domains.agg(
        F.count("*").alias("domains"), F.count_if(F.col("crawl_status") == "crawled").alias("crawled")
    ).select(
        F.inline(
            F.array(
                F.struct(F.lit("domains").alias("kpi"), F.col("domains").alias("value")),
                F.struct(F.lit("crawled_domains").alias("kpi"), F.col("crawled").alias("value")),
            )
        )
    )
    total = companies.agg(F.count("*").alias("value")).select(F.lit("companies").alias("kpi"), "value")
    return total.unionByName(per_status)


def companies_per(companies: DataFrame, column: str) -> DataFrame:
    """Companies per value of a column, NULL left out."""
    known = companies.filter(F.col(column).isNotNull())
    return known.groupBy(column).agg(F.count("*").alias("companies"))


def pipeline(companies: DataFrame, domains: DataFrame, profiles: DataFrame) -> DataFrame:
    """How far companies got: discovered, crawled, enriched, scored."""
    crawled = (
        domains.groupBy("company_id")
        .agg(F.bool_or(F.col("crawl_status") == "crawled").alias("crawled"))
    )
    scored = profiles.select("company_id", F.lit(True).alias("scored")).distinct()
    joined = companies.select("company_id", "status").join(crawled, "company_id", "left").join(
        scored, "company_id", "left"
    )
    steps = {
        "discovered": F.lit(True),
        "crawled": F.col("crawled"),
        "enriched": F.col("status") == "enriched",
        "scored": F.col("scored"),
    }
    totals = joined.agg(*[F.count_if(test).alias(step) for step, test in steps.items()])
    return totals.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(s).alias("stage"), F.col(s).alias("companies")) for s in steps]
            )
        )
    )


def crawl_throughput(pages: DataFrame, window: str = "1 hour") -> DataFrame:
    """Pages fetched and the share that failed, per time window."""
    failed = F.count_if(~F.col("http_status").between(200, 299))
    return (
        pages.groupBy(F.window("fetched_at", window).alias("w"))
        .agg(F.count("*").alias("pages"), failed.alias("failed"))
        .select(
            F.col("w.start").alias("window_start"),
            "pages",
            "failed",
            F.round(F.col("failed") / F.col("pages"), 6).alias("error_rate"),
        )
    )


def queue_depth(events: DataFrame, key: Sequence[str], window: str = "1 hour") -> DataFrame:
    """Jobs that came, were started and were waiting at the end of each time window with either.

    A job comes with its first event and leaves the queue with its first start. Jobs are added up
    by window before anything is put in order, so the running sum goes over windows, not jobs.
    """
    started = F.min(F.when(F.col("step") == "start", F.col("ts")))
    jobs = events.groupBy(*key).agg(F.min("ts").alias("came"), started.alias("started"))
    moves = F.array(
        F.struct(F.col("came").alias("at"), F.lit(1).alias("came"), F.lit(0).alias("started")),
        F.struct(F.col("started").alias("at"), F.lit(0).alias("came"), F.lit(1).alias("started")),
    )
    moved = jobs.select(F.inline(moves)).where("at is not null").groupBy(F.window("at", window).alias("w"))
    moved = moved.agg(F.sum("came").alias("came"), F.sum("started").alias("started")).select(F.col("w.start").alias("window_start"), "came", "started")
    so_far = W.orderBy("window_start").rowsBetween(W.unboundedPreceding, 0)  # one row a window
    return moved.withColumn("waiting", F.sum(F.col("came") - F.col("started")).over(so_far))
