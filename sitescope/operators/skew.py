"""Building blocks that stay balanced when one key holds a large share of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitescope.session import checkpointed

# Rows of one key that a single join task is meant to take.
HOT_ROWS = 1_000_000
# Shares for rows whose key is NULL: they match nothing, so any spread is right.
NULL_SHARES = 1024
# Offsets beyond this are served from range partitions instead of one top-k task.
DEEP_PAGE = 100_000


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    counts: DataFrame,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join a per-key ``lookup`` (unique on ``on``) to ``rows`` whose keys are counted.

    A key with n rows is cut into ``ceil(n / hot_rows)`` shares by a hash of
    ``spread_by`` and only such keys are repeated in the lookup, once per share.
    ``counts`` (keys and ``_n``) is at hand where the caller aggregates the rows anyway;
    without it a plain join reads the rows once, and Spark's skew join splits it.
    """
    on = list(on)
    hot = (
        counts.filter(F.col("_n") > hot_rows)
        .select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_shares"))
    )
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    shares = F.when(null_key, NULL_SHARES).otherwise(F.coalesce(F.col("_shares"), F.lit(1)))
    left = (
        rows.join(hot, on, "left")
        .withColumn("_share", F.pmod(F.xxhash64(*spread_by), shares).cast("int"))
        .drop("_shares")
    )
    right = (
        lookup.join(hot, on, "left")
        .withColumn(
            "_share", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_shares"), F.lit(1)) - 1))
        )
        .drop("_shares")
    )
    return left.join(right, [*on, "_share"], how).drop("_share")


def rank_within(rows: DataFrame, key: Sequence[str], position: str, name: str = "rank") -> DataFrame:
    """Exact 1-based rank of ``position`` inside each key, whatever numbers it holds.

    Rows are range partitioned by key and position, so a key of many rows spans several
    partitions of like size. Ranks are taken inside partitions and shifted by the
    rows of the key in earlier ones. Only the first key of a partition can have earlier
    rows, so the shifts are at most one for each partition and are broadcast. The
    ranges are written to the shared folder, since sampled bounds must not change.
    """
    key = list(key)
    ranged = checkpointed(
        rows.repartitionByRange(*key, position).withColumn("_part", F.spark_partition_id())
    )
    before = W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy("_part", *key)
        .agg(F.count("*").alias("_size"))
        .select("_part", *key, F.sum("_size").over(before).alias("_shift"))
        .filter("_shift is not null")
    )
    inside = ranged.withColumn(
        "_inside", F.row_number().over(W.partitionBy("_part", *key).orderBy(position))
    )
    same_key = [F.col(f"i.{k}").eqNullSafe(F.col(f"s.{k}")) for k in ["_part", *key]]
    ranked = inside.alias("i").join(
        F.broadcast(shifts).alias("s"), reduce(lambda a, b: a & b, same_key), "left"
    )
    return ranked.select(
        *[F.col(f"i.{c}") for c in rows.columns],
        (F.col("_inside") + F.coalesce("_shift", F.lit(0))).cast("long").alias(name),
    )


def page_of(
    rows: DataFrame,
    order: Sequence[Column],
    page: int,
    page_size: int,
    deep_page: int = DEEP_PAGE,
) -> DataFrame:
    """One 1-based page of ``rows`` in ``order`` (which must be total).

    Near the top this is Spark's top-k. A page far down would gather everything
    before it in one task, so there the rows are range partitioned, whole
    partitions before the page are skipped by their counts, and only the
    partitions that hold the page are ranked.
    """
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size must be positive")
    offset = (page - 1) * page_size
    if offset + page_size <= deep_page:
        return rows.orderBy(*order).offset(offset).limit(page_size)
    ranged = checkpointed(
        rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (  # one row per range partition
        ranged.groupBy("_part")
        .agg(F.count("*").alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .filter((F.col("_start") < offset + page_size) & (F.col("_start") + F.col("_size") > offset))
    )
    placed = ranged.join(F.broadcast(starts), "_part").withColumn(
        "_rank", F.col("_start") + F.row_number().over(W.partitionBy("_part").orderBy(*order))
    )
    return placed.filter(
        (F.col("_rank") > offset) & (F.col("_rank") <= offset + page_size)
    ).select(*rows.columns)
