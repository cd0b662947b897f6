"""Names that differ by a few typing errors: a similarity join, and lookups of a typed name.

Two names of at least ``short`` characters that are within d edits of each other share one
of the ``3 d + 1`` rarest trigrams of each, as an edit destroys three trigrams at most. A pair
with a shorter name shares a text that is left when up to d characters are deleted
from each. Both kinds of keys find candidates; only those are measured. A trigram that
very many names have among their rarest is no key: names that hold one get deletion keys
as well, so such pairs are found by those. Hence no pair is missed, and no key
gathers names that are not alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.session import checkpointed

Q = 3
#: Names that may share a trigram key; beyond it their deletions are the keys.
KEY_NAMES = 100


def plain_name(name: Column) -> Column:
    """Lower case, other characters than letters and digits as single blanks, trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def trigrams(name: Column) -> Column:
    """The trigrams of a plain name with their number among equal ones, so repeats count."""
    cut = F.transform(F.sequence(F.lit(1), F.length(name) - (Q - 1)), lambda i: F.substring(name, i, F.lit(Q)))
    cut = F.when(F.length(name) >= Q, cut).otherwise(F.array().cast("array<string>"))
    return F.transform(
        cut, lambda g, i: F.struct(g.alias("gram"), F.size(F.filter(F.slice(cut, F.lit(1), i), lambda x: x == g)).alias("nth"))
    )


def deletions(name: Column, edits: int) -> Column:
    """What is left of a name when up to ``edits`` characters are deleted."""
    found = F.array(name)
    for _ in range(edits):
        shorter = F.flatten(
            F.transform(
                found,
                lambda t: F.when(
                    F.length(t) > 0,
                    F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substr(t, i + 1))),
                ).otherwise(F.array().cast("array<string>")),
            )
        )
        found = F.array_distinct(F.concat(found, shorter))
    return found


def name_classes(companies: DataFrame, key: str = "company_id", name: str = "display_name") -> DataFrame:
    """(class, plain name) of every company with a name; a class is the smallest id that has the name."""
    plain = companies.select(F.col(key).alias("company_id"), plain_name(F.col(name)).alias("plain")).where("plain is not null")
    first = plain.groupBy("plain").agg(F.min("company_id").alias("class"))
    return plain.join(first, "plain").select("company_id", "class", "plain")


def similar_names(classes: DataFrame, edits: int = 1, key_names: int = KEY_NAMES, within: Sequence[str] = ()) -> DataFrame:
    """(a, b, distance) for all classes a < b whose names are within ``edits`` edits.

    ``classes``: company_id, class, plain, as from :func:`name_classes`; classes come out as their ids.
    ``within``: columns that must be equal as well; they are part of every key, so rows without one pair with nothing.
    """
    if edits < 1:
        raise ValueError("equal names are one class")
    within = list(within)
    rarest = Q * edits + 1
    short = rarest + Q - 1  # names with fewer trigrams than that may share none
    names = checkpointed(classes.where("company_id = class").select("class", "plain", *within).dropna(subset=["class", "plain", *within]))
    grams = names.where(F.length("plain") >= short).select("class", *within, F.explode(trigrams(F.col("plain"))).alias("g"))
    common = grams.groupBy(*within, "g").agg(F.count("*").alias("names"))
    # Rows of one gram may be a large share; they only meet its count, which Spark's skew join can split.
    counted = grams.join(common, [*within, "g"]).groupBy("class", *within).agg(F.sort_array(F.collect_list(F.struct("names", "g"))).alias("all"))
    keys = counted.select("class", *within, F.explode(F.slice("all", 1, rarest)).alias("k"))
    keys = checkpointed(keys.select("class", F.xxhash64(*within, "k.g.gram", "k.g.nth").alias("key")))
    shared = keys.groupBy("key").agg(F.count("*").alias("sharing"))
    keys = keys.join(shared.where("sharing > 1"), "key")
    by_gram = keys.where(F.col("sharing") <= key_names).select("class", "key")
    crowded = keys.where(F.col("sharing") > key_names).select("class").distinct().withColumn("crowded", F.lit(True))
    # A short name can match one that is longer by the edits, so that gets deletions too.
    cut = names.join(crowded, "class", "left").where((F.length("plain") < short + edits) | F.col("crowded"))
    by_deletion = cut.select("class", *within, F.explode(deletions(F.col("plain"), edits)).alias("rest"))
    by_deletion = by_deletion.select("class", F.xxhash64(F.lit(0), *within, "rest").alias("key"))
    both = by_gram.union(by_deletion).join(names, "class").select("key", "class", "plain", *within, F.length("plain").alias("n"))
    x, y = both.alias("x"), both.alias("y")
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.class") < F.col("y.class")) & (F.abs(F.col("x.n") - F.col("y.n")) <= edits)
    for c in within:
        near &= F.col(f"x.{c}") == F.col(f"y.{c}")
    found = x.join(y, near).select(
        F.col("x.class").alias("a"), F.col("y.class").alias("b"), F.levenshtein("x.plain", "y.plain", edits).alias("distance")
    )
    return found.where("distance >= 0").distinct()


def trigram_set(name: Column) -> Column:
    """Distinct trigrams of each word, with two blanks before it and one behind."""
    words = F.filter(F.split(name, " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(
        F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))
    )


def names_like(companies: DataFrame, typed: str, least: float = 0.3, limit: int = 25) -> DataFrame:
    """(company_id, display_name, similarity) of the names most like a typed one.

    Similarity is the share of trigrams that two names have in common, of all that either has.
    One pass over the names and a top-k; nothing is shuffled but the best rows of each task.
    """
    asked = trigram_set(plain_name(F.lit(typed)))
    own = trigram_set(plain_name(F.col("display_name")))
    both = F.size(F.array_intersect(own, asked))
    similarity = both / (F.size(own) + F.size(asked) - both)
    found = companies.select("company_id", "display_name", F.round(similarity, 6).alias("similarity"))
    return found.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "display_name", "company_id").limit(limit)
