"""From raw HTTP captures to page records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.functions import html as H
from sitescope.functions.urls import page_type_of


def page_records(captures: DataFrame, max_characters: int | None = None) -> DataFrame:
    """Normalised page records.

    ``captures``: url, status (NULL when the request failed), headers (map), body,
    and any key columns, which pass through. Header names become lower case (the
    last of equal names wins), the content type loses its parameters, and a body is
    kept only when it is HTML, whole unless ``max_characters`` is given. The title is read from successful HTML only.
    """
    own = {"url", "status", "headers", "body"}
    keys = [c for c in captures.columns if c not in own]
    entries = F.transform(
        F.map_entries("headers"),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
    )
    unique = F.filter(
        "_entries",
        lambda e, i: ~F.exists(
            F.slice(F.col("_entries"), i + 2, F.size("_entries")), lambda later: later["key"] == e["key"]
        ),
    )
    read = captures.select(
        *keys, "url", "status", "body", F.coalesce(entries, F.array()).alias("_entries")
    ).withColumn("headers", F.map_from_entries(unique))
    main_type = F.substring_index(F.element_at("headers", "content-type"), ";", 1)
    typed = read.withColumn("content_type", F.nullif(main_type, F.lit(""))).withColumn(
        "_text",
        F.when(
            F.col("status").isNotNull() & F.col("content_type").startswith("text/html"),
            F.col("body") if max_characters is None else F.substring("body", 1, max_characters),
        ),
    )
    ok_html = F.col("status").between(200, 299) & F.col("content_type").startswith("text/html")
    return typed.select(
        *keys,
        "url",
        page_type_of(F.col("url")).alias("page_type"),
        F.coalesce("status", F.lit(0)).alias("http_status"),
        "content_type",
        F.when(ok_html, H.raw_title(H.visible_markup(F.col("_text")))).alias("title"),
        F.sha2(F.coalesce("_text", F.lit("")), 256).alias("content_hash"),
        F.nullif("_text", F.lit("")).alias("html"),
        "headers",
    )
