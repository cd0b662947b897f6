"""Keeping keyed tables current: upsert, replace, update, append, delete.

The frame functions are pure and repeatable: running one again with the same input
gives the same table. :class:`KeyedTable` applies them to Parquet at rest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, MapType, StructField, StructType



def stamped(frame: DataFrame, column: str, as_of=None) -> DataFrame:
    """Adds the time of a run: now, or a given time where a run has to be repeatable."""
    time = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return frame.withColumn(column, time)


def upsert_latest(
    existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: str
) -> DataFrame:
    """One row per key: the last incoming row if there is one, else the stored row.

    The rank filter is applied before the shuffle as well, so a key with very many
    versions sends one row per task.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    others = [  # makes the pick among equals repeatable; maps go by their sorted entries
        F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, MapType) else F.col(f.name)
        for f in sorted(existing.schema.fields, key=lambda f: f.name)
        if f.name not in {*key, order}
    ]
    latest = W.partitionBy(*key).orderBy(
        F.desc("_new"), F.desc_nulls_last(order), *[c.desc_nulls_last() for c in others]
    )
    ranked = both.withColumn("_rank", F.row_number().over(latest))
    return ranked.filter("_rank = 1").select(*existing.columns)


def replace_for_keys(
    existing: DataFrame, incoming: DataFrame, keys: DataFrame, key: str
) -> DataFrame:
    """Drop all rows of the given keys, then add the incoming rows.

    ``keys`` may list keys without incoming rows; those end up empty.
    """
    marked = keys.select(key).distinct().withColumn("_gone", F.lit(True))
    kept = existing.join(marked, key, "left").filter("_gone is null")
    return kept.select(*existing.columns).unionByName(incoming.select(*existing.columns))


def update_in_place(
    existing: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], null_clears: bool = False
) -> DataFrame:
    """New values for the keys that have a change; keys are unique.

    NULL in a change means unchanged, or clears the value with ``null_clears``.
    """
    renamed = changes.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])

    def new(c: str):
        if null_clears:
            return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c))
        return F.coalesce(f"_new_{c}", c)

    joined = existing.join(renamed, key, "left")
    return joined.select(*[new(c).alias(c) if c in columns else F.col(c) for c in existing.columns])


def missing_keys(requested: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Requested keys that the table does not have."""
    return requested.select(key).distinct().join(existing.select(key), key, "left_anti")


def append_rows(existing: DataFrame, rows: DataFrame, id_column: str, natural_key: Sequence[str]):
    """Rows added under an id computed from their natural key."""
    with_id = rows.withColumn(id_column, F.xxhash64(*natural_key))
    return existing.unionByName(with_id.select(*existing.columns))


def delete_with_children(
    parents: DataFrame, children: DataFrame, doomed: DataFrame, key: str
) -> tuple[DataFrame, DataFrame]:
    """Parents without the doomed keys, and children without their rows."""
    gone = doomed.select(key).distinct()
    kept = parents.join(gone, key, "left_anti")
    marked = children.join(gone.withColumn("_gone", F.lit(True)), key, "left")
    return kept, marked.filter("_gone is null").select(*children.columns)


@dataclass(frozen=True)
class KeyedTable:
    """A Parquet table in ``buckets`` hash partitions of a key.

    A change rewrites only the partitions its keys fall in, by dynamic partition
    overwrite: Spark writes aside and swaps the partitions when the job commits. Each of
    them gets a marker row, so a bucket that ends up empty is overwritten too.
    """

    spark: SparkSession
    path: str
    key: str
    schema: StructType
    buckets: int = 64

    def read(self) -> DataFrame:
        return self._stored().drop("_bucket")

    def _touched(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys: at most ``buckets`` numbers."""
        return sorted(r[0] for r in self._bucketed(keys.select(self.key)).select("_bucket").distinct().collect())

    def _stored(self) -> DataFrame:
        fields = [*self.schema.fields, StructField("_marker", BooleanType()), StructField("_bucket", IntegerType())]
        return self.spark.read.schema(StructType(fields)).parquet(self.path).filter("_marker is null").drop("_marker")

    def _bucketed(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn("_bucket", F.pmod(F.xxhash64(self.key), self.buckets).cast("int"))

    def create(self) -> "KeyedTable":
        """Make the table if it does not exist; a table that does is left alone."""
        empty = self._bucketed(self.spark.createDataFrame([], self.schema))
        empty.write.mode("ignore").partitionBy("_bucket").parquet(self.path)
        return self

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Apply ``change`` to the stored rows of the buckets that ``keys`` touch."""
        touched = self._touched(keys)
        old = self._stored().filter(F.col("_bucket").isin(touched)).drop("_bucket")
        new = self._bucketed(change(old).select(*self.schema.fieldNames()))
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        marks = self.spark.createDataFrame([(n,) for n in touched], "_bucket int")
        marks = marks.select(*empty, F.lit(True).alias("_marker"), "_bucket")
        new = new.withColumn("_marker", F.lit(None).cast("boolean")).unionByName(marks)
        (
            new.hint("rebalance", "_bucket")  # few files per bucket, large buckets split
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("_bucket")
            .parquet(self.path)
        )

    def replace(self, keys: DataFrame, incoming: DataFrame) -> None:
        """Replace all rows of ``keys`` by ``incoming``."""
        self.rewrite(keys, lambda old: replace_for_keys(old, incoming, keys, self.key))

    def upsert(self, incoming: DataFrame, order: str) -> None:
        """Keep one row per key, the incoming one if there is one."""
        self.rewrite(incoming, lambda old: upsert_latest(old, incoming, [self.key], order))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
