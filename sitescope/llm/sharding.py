"""Sharding by proportional stratified interleaving.

The rows of each source are put into a seeded random order. The r-th of a source's n rows has
the fractional rank (r - 1 + u) / n, with a fraction u drawn for each source, as small
sources of one size would else come in clumps. All rows are sorted by it and the sequence is
cut into runs whose lengths differ by one at most, so every shard holds the sources in the
proportions of the whole, and so does every stretch of a shard.

The order of a source is that of MD5 over seed and id, so it does not depend on partitions,
and a new document moves the others only by its place. Ranks are taken in range
partitions and shifted by the rows before them, so a source, a group of equal texts or
a shard may hold any share of the rows; nothing gathers them in one task. Callers
hand in narrow rows where texts need not move.

Defined results: rows without a source are a source of their own; rows that share an id are
rows of their own, in the order of their other ordering columns; a null text has no bytes;
an empty table has no rows; with fewer rows than shards, some shards are empty. Equal texts
are not kept together: a group may be larger than a shard. Columns of other
names pass through; those that the result adds (``shard``, ``slot``) replace older ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.operators.skew import rank_within
from sitescope.session import checkpointed

SHARDS = 16
SEED = 12


def _placed(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows with their place (from 0) in a total sort, and their number.

    Each range partition is sorted by itself and shifted by the rows of those before it.
    """
    names = [F.col(c).asc_nulls_first() for c in order]
    ranged = rows.repartitionByRange(*names).sortWithinPartitions(*names)
    ranged = checkpointed(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()  # one row a partition
    starts, total = [], 0
    for r in sizes:
        starts.append((r["_part"], total))
        total += r["n"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part int, _start long"))
    ranged = ranged.withColumn("_part", part).join(starts, "_part")
    return ranged.withColumn("_place", F.col("_start") + inside).drop("_at", "_part", "_start"), total


def interleave(
    rows: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", source: str = "source", ties: Sequence[str] = ()
) -> DataFrame:
    """Rows with ``shard`` (from 0) and ``slot``, the place in the shard (from 0, no gaps).

    ``ties``: columns that order rows of one id; rows equal in them too change places freely.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    columns = [c for c in rows.columns if c not in ("shard", "slot")]
    digest = lambda c: F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("binary"))
    draw = digest(key)
    drawn = rows.select(F.struct(*columns).alias("_row"), F.col(source).alias("_source"), F.struct(draw, *[F.col(c) for c in (key, *ties)]).alias("_draw"))
    ranked = rank_within(drawn, ["_source"], "_draw", "_rank")
    counts = drawn.groupBy(F.col("_source").alias("_of")).agg(F.count("*").alias("_n"))
    ranked = ranked.join(counts, F.col("_source").eqNullSafe(F.col("_of")))
    offset = F.conv(F.substring(digest("_source"), 1, 12), 16, 10).cast("long") / F.lit(2.0**48)
    ranked = ranked.withColumn("_share", (F.col("_rank") - 1 + offset) / F.col("_n"))
    placed, total = _placed(ranked.select("_row", "_source", "_draw", "_share"), ["_share", "_source", "_draw"])
    placed = placed.select("_row.*", "_place", F.expr(f"cast((_place * {shards}L) div {max(total, 1)}L as int)").alias("shard"))
    start = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.select(*columns, "shard", (F.col("_place") - start).alias("slot"))


def sharded_documents(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, text_crc32, law, shard, slot, grown_shard) of every row; texts do not move."""
    raw = F.encode("text", "utf-8")
    rows = documents.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
    )
    placed = interleave(rows, shards, seed, ties=("size", "text_crc32", "source"))
    return placed.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(documents: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Whole rows as Parquet, a folder for each shard, its rows by slot within files of equal size."""
    placed = interleave(documents, shards, seed, ties=("text",))
    placed = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    placed.write.partitionBy("shard").parquet(folder)
