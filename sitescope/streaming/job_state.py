"""Current state of crawl jobs from a stream of lifecycle events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sitescope.operators.jobs import STATE_COLUMNS, fold_events

STATE_TYPES = (
    "state string, attempts int, pages_crawled int, started_at timestamp_ntz, "
    "finished_at timestamp_ntz, illegal long, events long"
)
EVENT_TYPES = "ts timestamp_ntz, event_id long, step string, pages int"


@dataclass(frozen=True)
class JobStateStore:
    """Two Parquet tables by bucket of the job: the events as they came, and the states.

    A micro-batch adds its events and recomputes the jobs they belong to from all of
    their events, so the states equal a fold over everything that has arrived, however
    the events were ordered, split or repeated, and however late one is (a repeat has the id of
    an earlier event of its job; without an id it is another event). Both writes replace
    partitions, hence a replayed batch leaves the same tables.
    """

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    key_types: str
    buckets: int = 64

    def bucketed(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn("_bucket", F.pmod(F.xxhash64(*self.key), self.buckets).cast("int"))

    def _write(self, frame: DataFrame, name: str, *by: str) -> None:
        (
            frame.hint("rebalance", "_bucket")  # few files per bucket, large buckets split
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("_bucket", *by)
            .parquet(f"{self.path}/{name}")
        )

    def _read(self, name: str, types: str) -> DataFrame:
        schema = StructType.fromDDL(f"{self.key_types}, {types}, _bucket int")
        empty = self.spark.createDataFrame([], schema)
        empty.write.mode("ignore").partitionBy("_bucket").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def states(self) -> DataFrame:
        return self._read("states", STATE_TYPES).drop("_bucket")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take in the events of a micro-batch."""
        key = list(self.key)
        fresh = self.bucketed(batch.select(*key, "ts", "event_id", "step", "pages"))
        self._write(fresh.withColumn("_batch", F.lit(number)), "events", "_batch")
        jobs = fresh.select(*key, "_bucket").distinct()
        touched = [r[0] for r in jobs.select("_bucket").distinct().collect()]  # at most `buckets` numbers
        in_touched = F.col("_bucket").isin(touched)
        stored = self._read("events", f"{EVENT_TYPES}, _batch int").filter(in_touched)
        events = stored.join(jobs.drop("_bucket"), key, "left_semi")
        changed = self.bucketed(fold_events(events, key).select(*key, *STATE_COLUMNS))
        others = self._read("states", STATE_TYPES).filter(in_touched).join(jobs.drop("_bucket"), key, "left_anti")
        self._write(others.unionByName(changed), "states")


def start_job_state(events: DataFrame, store: JobStateStore, checkpoint: str) -> StreamingQuery:
    """Fold a stream of job events into ``store``, everything available, then stop."""

    def apply(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # read for the events, the jobs and the buckets
        try:
            store.apply(held, number)
        finally:
            held.unpersist()

    return (
        events.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def job_states(store: JobStateStore, query: StreamingQuery) -> DataFrame:
    """All states once the query has ended."""
    query.awaitTermination()
    return store.states()
