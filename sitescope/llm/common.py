"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitescope.session import checkpointed


#: Bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def arrow_rows(spark: SparkSession, rows: int = 500) -> None:
    """Bound the rows and the bytes of an Arrow batch, so a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of ``sf_dir``; workers that start in another folder find this package by its path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([root, *filter(None, paths)]))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Edges of a task while components are sought; few edges need no shuffle.
EDGES = 100_000


def widened(frame: DataFrame, **kinds: str) -> StructType:
    """The schema of ``frame`` with more columns; the frame's own is not touched."""
    out = StructType(list(frame.schema.fields))
    for name, kind in kinds.items():
        out = out.add(name, kind)
    return out


def aside(frame: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``frame`` with all columns but ``text`` under names that no operator adds, and those names by the old ones."""
    names = {c: c if c == text else f"_c{i}" for i, c in enumerate(frame.columns)}
    return frame.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def fold(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over ``links``, for every linked node.

    Large-star and small-star rounds in turn until the edges are a forest of stars
    that no round changes; each round is an aggregate and a join, and is written to
    the shared folder. The driver sees one count and one checksum a round. The number of
    tasks follows the number of edges, so small tables are not spread thin.
    No links give an empty table.
    """
    edges = checkpointed(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    )
    parts = 1 + edges.count() // EDGES
    edges, seen = edges.coalesce(parts), None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).coalesce(parts)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = checkpointed(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u != v")
            .coalesce(parts)
            .distinct()
        ).coalesce(parts)
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
