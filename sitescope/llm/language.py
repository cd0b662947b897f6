"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is the element-wise product
of its letters' vectors, each rotated by its place; a text is the sum of its
trigrams' vectors, and a language the sum of its documents. A document gets the
language whose sum has the largest cosine with its own.

Only letters count (runs of others are one border mark), in lower case. A text that
is null or has no letter, or any text when nothing was learned, is ``und``, score 0.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import arrow_rows, aside, fold, widened

SLOTS = 4096  # letter vectors; slot 0 is the border mark
#: Languages that may be learned; prototypes are broadcast, so more are refused.
MAX_LANGUAGES = 2000


@lru_cache(maxsize=2)
def _tables(dims: int, seed: int):
    letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    slots = np.where(letters, 1 + np.arange(0x110000) % (SLOTS - 1), 0).astype(np.int64)
    first = (np.random.default_rng(seed).integers(0, 2, (SLOTS, dims)) * 2 - 1).astype(np.int8)
    return slots, first, np.roll(first, 1, axis=1), np.roll(first, 2, axis=1)


def trigrams(text: str | None, slots: np.ndarray) -> np.ndarray:
    """Codes of a text's trigrams over letters and border marks; none without a letter."""
    if not text:
        return np.empty(0, np.int64)
    x = slots[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
    x = np.concatenate(([0], x, [0]))
    x = x[(x > 0) | np.concatenate(([True], x[:-1] > 0))]
    if len(x) < 3:
        return np.empty(0, np.int64)
    return (x[:-2] * SLOTS + x[1:-1]) * SLOTS + x[2:]


def bundle(codes: np.ndarray, counts: np.ndarray, tables) -> np.ndarray:
    """Sum of the trigrams' vectors, each as often as it occurs."""
    _, first, second, third = tables
    out = np.zeros(first.shape[1])
    for i in range(0, len(codes), 8192):
        c = codes[i : i + 8192]
        bound = first[c // (SLOTS * SLOTS)] * second[c // SLOTS % SLOTS] * third[c % SLOTS]
        out += counts[i : i + 8192].astype(np.float32) @ bound.astype(np.float32)
    return out


def learn(documents: DataFrame, use: Column, text: str = "text", lang: str = "lang", dims: int = 512, seed: int = 5):
    """Prototype of every non-null ``lang`` among the rows where ``use`` holds: {lang: vector}.

    Each task adds up its rows and hands on one vector a language; the sums are
    aggregated by Spark, and at most ``MAX_LANGUAGES`` vectors reach the driver.
    """
    arrow_rows(documents.sparkSession)
    rows = documents.where(use).where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def run(batches):
        tables, sums = _tables(dims, seed), {}
        for batch in batches:
            by: dict[str, list] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(trigrams(t, tables[0]))
            for name, parts in by.items():
                codes, counts = np.unique(np.concatenate(parts), return_counts=True)
                if len(codes):
                    sums[name] = sums.get(name, 0) + bundle(codes, counts, tables)
        for name, vector in sums.items():
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame({"lang": name, "dim": np.arange(dims, dtype=np.int32), "x": vector}), preserve_index=False
            )

    summed = rows.mapInArrow(run, "lang string, dim int, x double").groupBy("lang", "dim").agg(F.sum("x").alias("x"))
    found = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("v"))
    learned = found.limit(MAX_LANGUAGES + 1).collect()
    if len(learned) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r.lang: np.array([p.x for p in r.v]) for r in sorted(learned, key=lambda r: r.lang)}


def predict(documents: DataFrame, prototypes: dict, text: str = "text", dims: int = 512, seed: int = 5) -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score`` (the cosine, at least 0), from the whole text alone.

    Columns of those names are replaced. Of equal cosines the first language by name wins.
    """
    arrow_rows(documents.sparkSession)
    kept = documents.drop("lang_pred", "score")
    place = kept.columns.index(text)
    names = list(prototypes)
    matrix = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-300) for n in names]).reshape(-1, dims)

    def run(batches):
        tables = _tables(dims, seed)
        for batch in batches:
            langs, scores = [], []
            for t in batch.column(place).to_pylist():
                codes, counts = np.unique(trigrams(t, tables[0]), return_counts=True)
                if not len(codes) or not names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                vector = bundle(codes, counts, tables)
                cosines = matrix @ (vector / max(np.linalg.norm(vector), 1e-300))
                best = int(np.argmax(cosines))
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )

    return kept.mapInArrow(run, widened(kept, lang_pred="string", score="double"))


def predicted_languages(documents: DataFrame) -> DataFrame:
    """Language of every document, learned from those whose fold of four is not 2 (a null id teaches nothing)."""
    rest = fold("doc_id", 4)
    prototypes = learn(documents, rest != 2)
    named = documents.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text")
    return predict(named, prototypes).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(documents: DataFrame) -> DataFrame:
    """The documents whose language can be told, as they are; ``und`` goes."""
    prototypes = learn(documents, fold("doc_id", 4) != 2)
    rows, names = aside(documents)
    told = predict(rows, prototypes).where("lang_pred != 'und'")
    return told.select(*[F.col(n).alias(c) for c, n in names.items()])
