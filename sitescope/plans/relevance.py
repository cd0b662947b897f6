"""Weighted full-text relevance over an inverted index, blended with a business score.

The index is a set of tables. ``postings`` has a row for each term of each document: the
sum of the weights of the fields it stands in, with repeats. ``terms`` has the number of
documents that hold a term, ``corpus`` the number of documents and their length in weights.
``blocks`` has, for each term and block of documents, the most that a posting adds to a
score. Blocks gather documents of like business score, as that is what all queries share.

A document's relevance is BM25 over its weighted term counts, as a sum of whole
millionths, so it does not depend on how rows are dealt. A query bounds every block by the
maxima of its terms, scores the blocks with the highest bounds, and after that only blocks
whose bound reaches the k-th best score found; nothing else is read. Rows are added up by
document, so a term of half of all documents is spread like any other.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitescope.plans.search import SearchSpec, matching
from sitescope.session import checkpointed

# Weights of the fields by their rank in the search projection.
FIELD_WEIGHTS = {"display_name": 1.0, "industry": 0.4, "technologies": 0.2, "text_blob": 0.1}
K1, B = 1.2, 0.75
#: Units of a score.
MILLION = 1_000_000
#: Documents of a block, about.
BLOCK_DOCUMENTS = 1000
#: Ranges of the business score that blocks keep apart.
TIERS = 20


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def query_terms(text: str | None) -> list[str]:
    """The distinct terms of a typed query, as :func:`tokens` reads them."""
    cut = "".join(c if c.isalpha() or c.isnumeric() else " " for c in (text or "").lower())
    return list(dict.fromkeys(cut.split()))


@dataclass(frozen=True)
class Blend:
    """How relevance and business score make one score."""

    business: float = 0.25
    column: str = "seo_score"
    most: float = 100.0


@dataclass(frozen=True)
class RelevanceIndex:
    """The tables of the index; ``corpus`` is one row."""

    postings: DataFrame  # term, company_id, block, weight, length
    terms: DataFrame  # term, documents
    blocks: DataFrame  # term, block, most_weight, least_length, business
    corpus: DataFrame  # documents, length

    TABLES = ("postings", "terms", "blocks", "corpus")

    def write(self, folder: str) -> None:
        """Parquet, postings sorted by term and block, so that a query reads few row groups.

        The one-row ``corpus`` is written last: an index without it is not complete.
        """
        sorted_ = self.postings.repartitionByRange("term", "block", "company_id").sortWithinPartitions("term", "block")
        sorted_.write.mode("overwrite").parquet(f"{folder}/postings")
        self.blocks.repartitionByRange("term", "block").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/blocks")
        self.terms.write.mode("overwrite").parquet(f"{folder}/terms")
        self.corpus.coalesce(1).write.mode("overwrite").parquet(f"{folder}/corpus")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> "RelevanceIndex":
        return cls(*[spark.read.parquet(f"{folder}/{name}") for name in cls.TABLES])


def build_index(
    documents: DataFrame, weights: Mapping[str, float] = FIELD_WEIGHTS, blend: Blend = Blend(), block_documents: int = BLOCK_DOCUMENTS
) -> RelevanceIndex:
    """The index of documents (company_id, the weighted fields, the business score).

    Weights are hundredths in the tables, so their sums are exact. A document's terms
    are added up next to where it is read; only (document, term) rows move.
    """
    fields = dict(documents.dtypes)

    def weighted(field: str, weight: float) -> Column:
        text = F.array_join(field, " ") if fields[field].startswith("array") else F.col(field)
        return F.transform(tokens(text), lambda t: F.struct(t.alias("term"), F.lit(round(100 * weight)).cast("long").alias("weight")))

    business = F.col(blend.column).cast("double")
    tier = F.coalesce(F.floor(F.greatest(F.lit(0.0), F.least(business / blend.most, F.lit(1.0))) * TIERS) + 1, F.lit(0))
    found = documents.select(
        "company_id", tier.cast("int").alias("tier"), business.alias("business"), F.concat(*[weighted(f, w) for f, w in weights.items()]).alias("found")
    )
    found = found.withColumn("length", F.aggregate("found", F.lit(0).cast("long"), lambda s, x: s + x["weight"]))
    corpus = found.agg(F.count("*").alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
    count = corpus.first()["documents"]
    # Each tier is cut by a hash into blocks that would have about that many documents if tiers were even.
    cuts = max(1, math.ceil(count / (block_documents * TIERS)))
    block = F.col("tier").cast("long") * cuts + F.pmod(F.xxhash64("company_id"), F.lit(cuts))
    rows = found.select("company_id", block.alias("block"), "business", "length", F.inline("found"))
    postings = checkpointed(rows.groupBy("company_id", "block", "business", "length", "term").agg(F.sum("weight").alias("weight")))
    terms = postings.groupBy("term").agg(F.count("*").alias("documents"))
    blocks = postings.groupBy("term", "block").agg(
        F.max("weight").alias("most_weight"), F.min("length").alias("least_length"), F.max("business").alias("business")
    )
    return RelevanceIndex(postings.select("term", "company_id", "block", "weight", "length"), terms, blocks, corpus)


def _part(weight: Column, length: Column, idf: Column, mean: float) -> Column:
    """What a term adds, in millionths: it grows with the weight and falls with the length."""
    part = idf * weight * (K1 + 1) / (weight + 100 * K1 * (1 - B + B * length / mean))
    return F.floor(MILLION * part).cast("long")


def relevance(
    index: RelevanceIndex, documents: DataFrame, spec: SearchSpec, blend: Blend = Blend(), every_term: bool = False, report: list | None = None
) -> DataFrame:
    """The best ``spec.page_size`` documents for the text of ``spec`` under its filters.

    Columns: rank, company_id, display_name, relevance (0 to 1, of the most the query can
    reach), score (blended). Documents hold at least one term, or all with ``every_term``. Equal
    scores go by name, then id. ``report``, if given, gets the blocks that hold a term and those scored.
    """
    spark = documents.sparkSession
    asked = query_terms(spec.text)
    found = index.terms.where(F.col("term").isin(asked)).collect() if asked else []  # a row for each term asked for
    corpus = index.corpus.first()
    empty = spark.createDataFrame([], "rank int, company_id long, display_name string, relevance double, score double")
    if not found or every_term and len(found) < len(asked):
        return empty
    idf = {r.term: math.log(1 + (corpus.documents - r.documents + 0.5) / (r.documents + 0.5)) for r in found}
    mean = corpus.length / corpus.documents
    top = sum(math.floor(MILLION * v * (K1 + 1)) for v in idf.values())
    idf_of = reduce(lambda c, t: c.when(F.col("term") == t, F.lit(idf[t])), sorted(idf)[1:], F.when(F.col("term") == min(idf), F.lit(idf[min(idf)])))
    share = 1.0 - blend.business

    def blended(parts: Column, business: Column) -> Column:
        value = F.greatest(F.lit(0.0), F.least(F.coalesce(business.cast("double"), F.lit(0.0)) / blend.most, F.lit(1.0)))
        return F.floor(MILLION * (share * (parts / top) + blend.business * value)).cast("long")

    named = F.col("term").isin(sorted(idf))
    bounds = index.blocks.where(named).groupBy("block").agg(
        F.sum(_part(F.col("most_weight"), F.col("least_length"), idf_of, mean)).alias("parts"),
        F.max("business").alias("business"),
        F.count("*").alias("held"),
    )
    bounds = checkpointed(bounds.where(F.col("held") == len(idf)) if every_term else bounds)
    bounds = bounds.select("block", (blended(F.col("parts"), F.col("business")) + 1).alias("most"))
    chosen = matching(documents, SearchSpec(filters=spec.filters)).select("company_id", "display_name", F.col(blend.column).alias("business"))

    def scored(blocks: DataFrame) -> DataFrame:
        rows = index.postings.where(named).join(blocks.select("block"), "block", "left_semi")
        parts = rows.groupBy("company_id").agg(F.sum(_part(F.col("weight"), F.col("length"), idf_of, mean)).alias("parts"), F.count("*").alias("held"))
        parts = parts.where(F.col("held") == len(idf)) if every_term else parts
        return parts.join(chosen, "company_id").withColumn("score", blended(F.col("parts"), F.col("business")))

    k = spec.page * spec.page_size
    first = scored(bounds.orderBy(F.desc("most"), "block").limit(k))
    least = first.orderBy(F.desc("score")).limit(k).agg(F.min("score"), F.count("*")).first()
    likely = bounds.where(F.col("most") >= least[0]) if least[1] >= k else bounds
    if report is not None:
        report.append((bounds.count(), likely.count()))
    best = scored(likely).orderBy(F.desc("score"), "display_name", "company_id").offset(k - spec.page_size).limit(spec.page_size)
    place = W.orderBy(F.desc("score"), "display_name", "company_id")  # over the rows of one page
    rank = F.row_number().over(place) + (k - spec.page_size)
    return best.select(rank.alias("rank"), "company_id", "display_name", (F.col("parts") / top).alias("relevance"), (F.col("score") / MILLION).alias("score"))
