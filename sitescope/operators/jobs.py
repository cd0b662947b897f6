"""Crawl job lifecycle: pending -> running -> completed | failed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.operators.skew import HOT_ROWS, attach

PENDING, RUNNING, COMPLETED, FAILED = "pending", "running", "completed", "failed"
STATE_COLUMNS = (
    "state",
    "attempts",
    "pages_crawled",
    "started_at",
    "finished_at",
    "illegal",
    "events",
)


def delivered_once(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row for each event id of a job, the earliest; events without an id are all different.

    Ids count within their job, so two jobs may use the same ones. Repeats meet by job and id,
    which also deals out a job of very many events.
    """
    facts = F.struct("ts", "step", "pages")
    known = events.where("event_id is not null").groupBy(*key, "event_id").agg(F.min(facts).alias("_e"))
    known = known.select(*key, "_e.ts", "event_id", "_e.step", "_e.pages")
    return known.unionByName(events.where("event_id is null").select(*key, "ts", "event_id", "step", "pages"))


def fold_events(
    events: DataFrame,
    key: Sequence[str],
    prior: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """State of each job after its events, and how many events were illegal.

    ``events``: key columns, ts, event_id, step (start, complete, fail, enqueue) and
    pages. The lifecycle only moves forward, so the fold needs no ordered walk: the
    first start opens a job, the first complete or fail after it closes it, enqueue
    is legal while pending, and anything else is illegal (a negative page count
    too). Both firsts are plain minima that combine before the shuffle. An event that was
    delivered again counts once.

    ``prior`` holds earlier states (key and STATE_COLUMNS) to continue from; only
    jobs with events are returned.
    """
    key = list(key)
    events = delivered_once(events, key)
    order = F.struct("ts", "event_id")
    is_start = F.col("step") == "start"
    opened = events.groupBy(*key).agg(
        F.min(F.when(is_start, order)).alias("_start"), F.count("*").alias("_n")
    )
    if prior is None:
        opened = opened.select(
            "*",
            F.lit(PENDING).alias("_state"),
            F.lit(0).alias("_attempts"),
            F.lit(0).alias("_pages"),
            F.lit(None).cast("timestamp_ntz").alias("_started"),
            F.lit(None).cast("timestamp_ntz").alias("_finished"),
            F.lit(0).cast("long").alias("_illegal"),
            F.lit(0).cast("long").alias("_events"),
        )
    else:
        old = prior.select(
            *key,
            F.col("state").alias("_state"),
            F.col("attempts").alias("_attempts"),
            F.col("pages_crawled").alias("_pages"),
            F.col("started_at").alias("_started"),
            F.col("finished_at").alias("_finished"),
            F.col("illegal").alias("_illegal"),
            F.col("events").alias("_events"),
        )
        opened = opened.join(old, key, "left").fillna(
            {"_state": PENDING, "_attempts": 0, "_pages": 0, "_illegal": 0, "_events": 0}
        )
    counts = opened.select(*key, "_n")
    placed = attach(events, opened, key, ["event_id"], counts, "left", hot_rows)
    pending, running = F.col("_state") == PENDING, F.col("_state") == RUNNING
    after_start = F.coalesce(pending & (order > F.col("_start")), F.lit(False)) | running
    closes = (F.col("step") == "fail") | ((F.col("step") == "complete") & (F.col("pages") >= 0))
    early = pending & (F.col("_start").isNull() | (order < F.col("_start")))
    closed = placed.groupBy(*key).agg(
        F.min(F.when(closes & after_start, F.struct("ts", "event_id", "step", "pages"))).alias("_end"),
        F.count_if((F.col("step") == "enqueue") & early).alias("_waits"),
        # The same on every row of a job.
        *[F.any_value(c).alias(c) for c in opened.columns if c not in key],
    )
    starts_now = pending & F.col("_start").isNotNull()
    ends_now = F.col("_end").isNotNull()
    done = F.when(F.col("_end.step") == "complete", COMPLETED).otherwise(FAILED)
    legal = F.col("_waits") + starts_now.cast("int") + ends_now.cast("int")
    return closed.select(
        *key,
        F.when(ends_now, done)
        .when(starts_now, RUNNING)
        .otherwise(F.col("_state"))
        .alias("state"),
        (F.col("_attempts") + starts_now.cast("int")).alias("attempts"),
        F.when(F.col("_end.step") == "complete", F.col("_end.pages"))
        .otherwise(F.col("_pages"))
        .cast("int")
        .alias("pages_crawled"),
        F.when(starts_now, F.col("_start.ts")).otherwise(F.col("_started")).alias("started_at"),
        F.coalesce("_end.ts", "_finished").alias("finished_at"),
        (F.col("_illegal") + F.col("_n") - legal).alias("illegal"),
        (F.col("_events") + F.col("_n")).alias("events"),
    )
