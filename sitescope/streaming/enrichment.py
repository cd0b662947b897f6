"""Incremental enrichment: new captures refresh only the companies they touch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from sitescope.operators.detect import marketing_of, technologies_of
from sitescope.operators.maintenance import KeyedTable, stamped
from sitescope.operators.projection import page_facts, search_projection
from sitescope.operators.seo_scan import profiles_of
from sitescope.sources.capture import page_records


@dataclass(frozen=True)
class EnrichmentStore:
    """Folder layout of the pages, of what was read from each, and of the four derived tables."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64("company_id"), self.buckets).cast("int"))

    def write(self, name: str, batch: int, rows: DataFrame) -> DataFrame:
        """Rows of one micro-batch, as they are read back; a replay overwrites its own folder."""
        folder = f"{self.path}/{name}/batch={batch}"
        self.bucketed(rows).hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
        return self.spark.read.schema(StructType([*rows.schema.fields, StructField("_bucket", IntegerType())])).parquet(folder)

    def facts_of(self, companies: DataFrame, schema: StructType) -> DataFrame:
        """The facts of all pages of some companies; other buckets are not read, and no HTML is."""
        touched = [r[0] for r in self.bucketed(companies).select("_bucket").distinct().collect()]  # at most `buckets` numbers
        places = [StructField(name, IntegerType()) for name in ("_bucket", "batch")]
        stored = self.spark.read.schema(StructType([*schema.fields, *places])).parquet(f"{self.path}/facts")
        return stored.filter(F.col("_bucket").isin(touched)).join(companies, "company_id", "left_semi").drop("_bucket", "batch")

    def table(self, name: str, like: DataFrame) -> KeyedTable:
        stored = KeyedTable(self.spark, f"{self.path}/{name}", "company_id", like.schema, self.buckets)
        return stored.create()


def refresh(
    store: EnrichmentStore, touched: DataFrame, facts: DataFrame, companies: DataFrame, domains: DataFrame, as_of
) -> None:
    """Recompute and replace everything derived for the touched companies, from the facts of their pages."""
    mine = companies.join(touched, "company_id", "left_semi")
    own_domains = domains.join(touched, "company_id", "left_semi")
    stored = {}
    for name, frame in (
        ("technologies", stamped(technologies_of(facts), "detected_at", as_of)),
        ("marketing", stamped(marketing_of(facts), "detected_at", as_of)),
        ("seo_profiles", stamped(profiles_of(facts), "scanned_at", as_of)),
    ):
        table = store.table(name, frame)
        table.replace(touched, frame)
        stored[name] = table.read().join(touched, "company_id", "left_semi")
    documents = search_projection(
        mine,
        own_domains,
        facts,
        stored["technologies"],
        stored["seo_profiles"],
        as_of,
    )
    store.table("documents", documents).replace(touched, documents)


def start_enrichment(
    captures: DataFrame,
    store: EnrichmentStore,
    companies: DataFrame,
    domains: DataFrame,
    checkpoint: str,
    as_of=None,
) -> StreamingQuery:
    """Run over everything the stream of captures has, then stop.

    Every step replaces by key, so a micro-batch that is run again after a failure
    leaves the same tables.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        pages = store.write("pages", batch_id, page_records(batch))
        facts = store.write("facts", batch_id, page_facts(pages, tools=True))  # the only pass over HTML
        touched = facts.select("company_id").distinct()
        stored = store.facts_of(touched, StructType([f for f in facts.schema.fields if f.name != "_bucket"]))
        refresh(store, touched, stored, companies, domains, as_of)

    return (
        captures.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
