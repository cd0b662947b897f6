"""Registering companies and requesting crawls, as batch jobs with rejects."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.functions.urls import normalize_hostname, strip_ws
from sitescope.session import checkpointed


@dataclass(frozen=True)
class Registration:
    """Accepted companies and domains, and rejected requests with a reason."""

    companies: DataFrame
    domains: DataFrame
    rejects: DataFrame


def check_candidates(candidates: DataFrame) -> DataFrame:
    """Adds the trimmed name, normalised ``hosts`` and the first ``reason`` against.

    ``candidates``: request_id, display_name, ..., domains array<struct<hostname,
    is_primary>>. The first domain is always primary, so a later primary one is a
    second primary. Everything here is local to a row.
    """
    named = candidates.withColumn("display_name", strip_ws(F.col("display_name"))).withColumn(
        "hosts",
        F.transform(
            F.coalesce("domains", F.array().cast("array<struct<hostname:string,is_primary:boolean>>")),
            lambda d, i: F.struct(
                i.alias("pos"),
                normalize_hostname(d["hostname"]).alias("hostname"),
                (d["is_primary"] | (i == 0)).alias("is_primary"),
            ),
        ),
    )

    def problem(host: Column, i: Column) -> Column:
        seen = F.exists(
            F.slice(F.col("hosts"), F.lit(1), i), lambda h: h["hostname"] == host["hostname"]
        )
        return (
            F.when(host["hostname"].isNull(), "invalid hostname")
            .when(seen, "duplicate hostname")
            .when((i > 0) & host["is_primary"], "second primary domain")
        )

    problems = F.filter(F.transform("hosts", problem), lambda p: p.isNotNull())
    blank = F.coalesce(F.col("display_name"), F.lit("")) == ""
    reason = F.when(blank, "blank display name").otherwise(F.get(problems, F.lit(0)))
    return named.withColumn("reason", reason).drop("domains")


def _claims(checked: DataFrame) -> DataFrame:
    return checked.filter("reason is null").select("request_id", F.inline("hosts"))


def owned_elsewhere(claims: DataFrame, existing_domains: DataFrame) -> DataFrame:
    """Requests that claim a hostname some company already owns."""
    owned = existing_domains.select("hostname", F.lit(True).alias("_owned"))
    hit = claims.join(owned, "hostname")
    return hit.groupBy("request_id").agg(F.min_by("hostname", "pos").alias("hostname"))


def first_come(claims: DataFrame) -> DataFrame:
    """request_ids to accept when requests are served in id order and a request
    fails if any of its hostnames went to an accepted one.

    In each round a request that is first on all its hostnames is accepted, which
    settles everyone sharing a hostname with it. The rounds needed equal the longest
    chain of requests that hinge on one another; the open rest is checkpointed.
    """
    accepted = None
    open_ = claims.select("request_id", "hostname")
    while True:
        first = open_.groupBy("hostname").agg(F.min("request_id").alias("_first"))
        placed = open_.join(first, "hostname")
        wins = checkpointed(
            placed.groupBy("request_id")
            .agg(F.bool_and(F.col("request_id") == F.col("_first")).alias("_wins"))
            .filter("_wins")
            .select("request_id")
        )
        accepted = wins if accepted is None else accepted.unionByName(wins)
        taken = open_.join(wins, "request_id", "left_semi").select("hostname")
        taken = taken.distinct().withColumn("_taken", F.lit(True))
        settled = open_.join(taken, "hostname").select("request_id")
        open_ = checkpointed(open_.join(settled.distinct(), "request_id", "left_anti"))
        if open_.isEmpty():
            return accepted


def first_claims(claims: DataFrame) -> DataFrame:
    """request_ids that are first on all their hostnames, by two aggregates however requests hinge on one another.

    A hostname is held for the first request that claims it, also if that one fails on another
    hostname; who comes later can ask again in the next batch. So this accepts no request that
    :func:`first_come` would reject for a hostname of an accepted one, but may put off some it accepts.
    """
    placed = claims.select("request_id", "hostname")
    first = placed.groupBy("hostname").agg(F.min("request_id").alias("_first"))
    won = placed.join(first, "hostname").groupBy("request_id").agg(F.bool_and(F.col("request_id") == F.col("_first")).alias("_wins"))
    return won.filter("_wins").select("request_id")


def register_companies(
    candidates: DataFrame, existing_domains: DataFrame, settle: Callable[[DataFrame], DataFrame] = first_come
) -> Registration:
    """Accept or reject whole companies, in request order.

    ``settle`` decides between requests of the batch: :func:`first_come` as if they were served one by one,
    :func:`first_claims` in a fixed number of shuffles.
    """
    checked = check_candidates(candidates)
    claims = _claims(checked)
    owned = owned_elsewhere(claims, existing_domains)
    free = claims.join(owned, "request_id", "left_anti")
    accepted = settle(free)
    no_domain = checked.filter("reason is null and size(hosts) = 0").select("request_id")
    accepted = accepted.unionByName(no_domain)

    good = checked.join(accepted, "request_id", "left_semi")
    domains = good.select("request_id", F.inline("hosts")).select(
        F.col("request_id").alias("company_id"),
        "pos",
        "hostname",
        "is_primary",
        F.lit("pending").alias("crawl_status"),
    )
    companies = good.select(
        F.col("request_id").alias("company_id"),
        *[c for c in good.columns if c not in ("request_id", "hosts", "reason")],
        F.lit("discovered").alias("status"),
    )
    rejects = checked.join(accepted, "request_id", "left_anti").select(
        "request_id",
        F.coalesce("reason", F.lit("domain already owned")).alias("reason"),
    )
    return Registration(companies, domains, rejects)


def companies_by_hostname(
    companies: DataFrame, domains: DataFrame, hostname: str | None = None
) -> DataFrame:
    """Companies with the hostname each is known under; optionally just one."""
    hosts = domains.select("hostname", "company_id", "domain_id")
    if hostname is not None:
        hosts = hosts.filter(F.col("hostname") == hostname.lower())
    return hosts.join(companies, "company_id")


def request_crawls(requests: DataFrame, domains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending jobs for known hostnames, and rejects for the rest.

    ``requests``: request_id, hostname. Every request makes a job of its own, also
    when a hostname is requested over and over.
    """
    named = requests.select(
        "request_id",
        F.col("hostname").alias("requested"),
        normalize_hostname(F.col("hostname")).alias("hostname"),
    )
    placed = named.join(domains.select("hostname", "domain_id"), "hostname", "left")
    jobs = placed.filter("domain_id is not null").select(
        F.col("request_id").alias("job_id"),
        "domain_id",
        "hostname",
        F.lit("website").alias("job_type"),
        F.lit("pending").alias("status"),
        F.lit(0).alias("attempts"),
        F.lit(0).alias("pages_crawled"),
    )
    rejects = placed.filter("domain_id is null").select(
        "request_id",
        "requested",
        F.when(F.col("hostname").isNull(), "invalid hostname")
        .otherwise("no company owns this domain")
        .alias("reason"),
    )
    return jobs, rejects
