"""Held-out accuracy, and the profiles against a plain computation."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from sitescope.llm import language
from sitescope.llm.queries import QUERIES


def test_held_out_accuracy(spark, documents):
    want = {r.doc_id: r.lang for r in documents.collect()}
    rows = QUERIES["op5_language"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(want)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und" and want[r.doc_id]]
    assert sum(r.lang_pred == want[r.doc_id] for r in held) / len(held) > 0.97


def test_bundles_are_sums_of_bound_vectors():
    tables = language._tables(64, 5)
    slots, letters = tables[0], tables[1].astype(float)
    text = "Aß, b1é"
    marks = [0, *(slots[ord(c)] for c in "aß"), 0, slots[ord("b")], 0, slots[ord("é")], 0]
    want = sum(letters[a] * np.roll(letters[b], 1) * np.roll(letters[c], 2) for a, b, c in zip(marks, marks[1:], marks[2:]))
    codes, counts = np.unique(language.trigrams(text, slots), return_counts=True)
    assert np.array_equal(language.bundle(codes, counts, tables), want)


def test_prototypes_add_up_whatever_the_partitions(spark, documents):
    one = language.learn(documents.coalesce(1), F.lit(True))
    many = language.learn(documents.repartition(7), F.lit(True))
    assert set(one) == set(many) == {"de", "en", "es", "fr"}
    assert all(np.array_equal(one[k], many[k]) for k in one)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, lang_pred int, score string, row int"
    rows = [(1, None, "en", 1, "s", 1), (2, "", None, 1, "s", 1), (3, "123 ###", "en", 1, "s", 1), (None, "the of and", "en", 1, "s", 1), (7, "ß", None, None, None, None)]
    rows += [(i, "the of and " * 9, "en", 1, "s", 1) for i in range(10, 30)] + [(i, "der die und ß", "de", 1, "s", 1) for i in range(30, 50)]
    frame = spark.createDataFrame(rows, schema)
    out = {r.doc_id: r for r in language.predicted_languages(frame).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3, 7)] == ["und", "und", "und", "de"] and out[1].score == 0
    assert out[None].lang_pred == "en" and out[None].held_out is False
    kept = language.keep_identified(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {1, 2, 3}
    assert language.predicted_languages(frame.limit(0)).count() == 0
    unlabelled = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.predicted_languages(unlabelled).collect()} == {"und"}
