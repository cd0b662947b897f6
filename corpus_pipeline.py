"""From raw documents to token ids: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sitescope.llm import bpe, decontaminate, language, minhash, pii
from sitescope.llm.common import read
from sitescope.session import shared_dir

TOKENIZER = "byte_bpe_50k.json"


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return language.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def protect(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data."""
    return pii.protect(docs, pii.key_of(spark))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with packed token ids, their number, and the text decoded from them."""
    model = bpe.load(spark, public_tokenizers.path(TOKENIZER))
    return bpe.decode(bpe.encode(docs, model), model)


STAGES = [
    ("language", identify),
    ("near_duplicates", deduplicate),
    ("decontamination", clean),
    ("pseudonyms", protect),
    ("tokens", tokenize),
]
#: No stage but the fourth could be said in SQL, so the result is tested against plain code instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder."""
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
