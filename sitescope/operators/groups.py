"""Groups of rows that are linked, directly or over others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.session import checkpointed


def linked_groups(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, group): the smallest node that each linked node can reach.

    Every node takes the smallest label around it and then the label of that label, so
    labels move twice as far in each round; a round is two joins and is written to the
    shared folder. Labels only fall, so their sum tells when none has changed. A node with very
    many links meets its own label only, which Spark's skew join can split.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    ends = checkpointed(ends.union(ends.select("y", "x")).distinct())
    labels = checkpointed(ends.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("group")))
    seen = None
    while True:
        mark = labels.agg(F.sum(F.col("group").cast("decimal(38,0)")), F.count("*")).first()
        if mark == seen:
            return labels
        seen = mark
        around = ends.join(labels.select(F.col("node").alias("y"), "group"), "y").groupBy(F.col("x").alias("node")).agg(F.min("group").alias("near"))
        low = labels.join(around, "node").select("node", F.least("group", "near").alias("via"))
        of_label = labels.select(F.col("node").alias("via"), F.col("group").alias("next"))
        labels = checkpointed(low.join(of_label, "via").select("node", F.least("via", "next").alias("group")))
