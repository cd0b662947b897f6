"""Reading and writing result sets as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_projection(documents: DataFrame, path: str) -> None:
    """Search documents clustered by the columns searches filter on.

    Range partitioning by industry and score gives each Parquet file narrow
    min/max bounds on both, which takes the place of an index.
    """
    (
        documents.repartitionByRange("industry", "seo_score")
        .sortWithinPartitions("industry", "seo_score")
        .write.mode("overwrite")
        .parquet(path)
    )


def write_pages(pages: DataFrame, path: str) -> None:
    """Page records in one folder per day they were fetched."""
    pages.withColumn("fetched_on", F.to_date("fetched_at")).write.mode("append").partitionBy(
        "fetched_on"
    ).parquet(path)


def read_headers(frame: DataFrame, column: str = "headers") -> DataFrame:
    """Headers kept as JSON text become a map."""
    return frame.withColumn(column, F.from_json(column, "map<string,string>"))


def write_headers(frame: DataFrame, column: str = "headers") -> DataFrame:
    """A header map becomes JSON text."""
    return frame.withColumn(column, F.to_json(column))


def write_list(frame: DataFrame, column: str = "technologies") -> DataFrame:
    """A list of names becomes JSON text."""
    return frame.withColumn(column, F.to_json(column))


def read_list(frame: DataFrame, column: str = "technologies") -> DataFrame:
    """A list kept as JSON text becomes an array."""
    return frame.withColumn(column, F.from_json(column, "array<string>"))


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files that arrive under a path, as a stream."""
    return spark.readStream.schema(schema).parquet(path)
