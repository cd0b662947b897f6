"""One row for each place, however its address is written, and links from companies to places.

Addresses are brought to a canonical form: lower case, no punctuation, abbreviations
of street words and directions written out. Equal forms are one spelling. Spellings of one country, city
and house number whose streets are one typing error apart are the same place, and so are
spellings that are linked over others. The candidates come from keys that hold only
similar streets, so a city with a third of all addresses is never compared in pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.operators.groups import linked_groups
from sitescope.operators.names import similar_names
from sitescope.session import checkpointed

# Street words and directions, and how they are shortened.
STREET_WORDS = {
    "street": ("st", "str"), "avenue": ("ave", "av"), "road": ("rd",), "boulevard": ("blvd", "boul"), "drive": ("dr",), "lane": ("ln",),
    "court": ("ct",), "place": ("pl",), "square": ("sq",), "highway": ("hwy",), "parkway": ("pkwy",), "terrace": ("ter", "tce"),
    "crescent": ("cres", "cr"), "suite": ("ste",), "floor": ("fl",), "building": ("bldg",), "north": ("n",), "south": ("s",), "east": ("e",), "west": ("w",),
}
PARTS = ("street", "city", "state", "postcode", "country")


def plain_part(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one blank; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def plain_street(text: Column) -> Column:
    """A plain street with its words written out."""
    out = plain_part(text)
    for word, shorts in STREET_WORDS.items():
        out = F.regexp_replace(out, rf"\b(?:{'|'.join(shorts)})\b", word)
    return out


def house_number(street: Column) -> Column:
    """The first number of a plain street, with a letter right behind it; empty without one."""
    return F.regexp_extract(street, r"\b(\d+\p{L}?)\b", 1)


def spellings(addresses: DataFrame) -> DataFrame:
    """Addresses (company_id, street, city, state, postcode, country) in plain form, with the id of their spelling.

    Rows without a street or a city name no place and are left out.
    """
    plain = addresses.select(
        "company_id",
        plain_street(F.col("street")).alias("street"),
        *[plain_part(F.col(c)).alias(c) for c in PARTS[1:]],
    ).where("street is not null and city is not null")
    number = house_number(F.col("street"))
    name = F.trim(F.regexp_replace(F.regexp_replace("street", r"\b\d+\p{L}?\b", " "), " +", " "))
    key = F.concat_ws("|", "street", "city", F.coalesce("postcode", F.lit("")), F.coalesce("country", F.lit("")))
    return plain.withColumns({"number": number, "name": name, "spelling": F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")})


@dataclass(frozen=True)
class Places:
    """``locations``: one row for each place; ``links``: (company_id, location_id, addresses) of companies."""

    locations: DataFrame
    links: DataFrame


def resolve_locations(addresses: DataFrame, edits: int = 1) -> Places:
    """Places of all addresses.

    A place is written as its most frequent spelling does, of equally frequent ones as the smallest id's,
    and that id is the place's, so ids stay when other places come or go.
    A missing postcode is the one that all other spellings of the street have; else it is a code of its own.
    """
    rows = checkpointed(spellings(addresses))
    facts = [*PARTS, "number", "name"]
    each = checkpointed(rows.groupBy("spelling").agg(F.count("*").alias("addresses"), *[F.min(c).alias(c) for c in facts]))
    street = ["in_country", "city", "number", "name"]
    each = each.withColumn("in_country", F.coalesce("country", F.lit("")))
    codes = each.groupBy(*street).agg(F.min("postcode").alias("low"), F.max("postcode").alias("high"))
    codes = codes.select(*street, F.when(F.col("low") == F.col("high"), F.col("low")).alias("only"))
    each = checkpointed(each.join(codes, street).withColumn("code", F.coalesce("postcode", "only", F.lit(""))))
    # One street under one code is one place; its smallest spelling stands for it.
    low = each.groupBy(*street, "code").agg(F.min("spelling").alias("class"))
    each = checkpointed(each.join(low, [*street, "code"]))
    classes = each.select(F.col("spelling").alias("company_id"), "class", F.col("name").alias("plain"), "in_country", "city", "number", "code")
    alike = similar_names(classes, edits, within=("in_country", "city", "number", "code")).select("a", "b")
    grouped = each.join(linked_groups(alike), F.col("class") == F.col("node"), "left")
    grouped = checkpointed(grouped.select("spelling", "addresses", *PARTS, F.coalesce("group", "class").alias("group")))
    best = grouped.groupBy("group").agg(
        F.max(F.struct("addresses", (-F.col("spelling")).alias("first"), *PARTS)).alias("best"), F.count("*").alias("spellings"), F.sum("addresses").alias("addresses")
    )
    best = best.select("group", (-F.col("best.first")).alias("location_id"), *[F.col(f"best.{c}").alias(c) for c in PARTS], "spellings", "addresses")
    placed = rows.select("company_id", "spelling").join(grouped.select("spelling", "group"), "spelling").join(best.select("group", "location_id"), "group")
    links = placed.groupBy("company_id", "location_id").agg(F.count("*").alias("addresses"))
    return Places(best.drop("group"), links)
