"""Against a search for every window in every text."""

import hashlib
import random
import re

import pytest

from sitescope.llm import decontaminate
from sitescope.llm.common import read


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, size=10):
    windows = {}
    for item, text in items:
        words = split(text)
        k = min(size, len(words))
        for i in range(len(words) - k + 1) if words else ():
            windows.setdefault(tuple(words[i : i + k]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for key, text in rows:
        words, hit, named = split(text), set(), set()
        for k in sizes:
            for i in range(len(words) - k + 1):
                found = windows.get(tuple(words[i : i + k]))
                if found:
                    hit |= set(range(i, i + k))
                    named |= found
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((key, len(words), len(hit), len(named), digest, bool(hit)))
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_whole_table(spark, documents, texts):
    benchmark = read(spark, "/root/testdata/sf0.01", "benchmark")
    want = brute(sorted(texts.items()), [tuple(r) for r in benchmark.collect()])
    assert got(decontaminate.contamination(documents, benchmark)) == want
    assert any(w[5] for w in want)


@pytest.mark.parametrize("block", [200_000, 40])
def test_small_alphabet(spark, monkeypatch, block):
    """Few words, so windows overlap, repeat and contain one another; also in blocks of items."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = random.Random(8)
    text = lambda n, k: " ".join(rng.choice("abcdé"[:k]) for _ in range(n))
    items = [(i, text(rng.randint(0, 24), 3)) for i in range(30)] + [(99, None), (100, "a-B c"), (101, "é a é a é"), (102, "a b " * 9)]
    rows = [(i, text(rng.randint(0, 120), rng.randint(2, 5))) for i in range(120)] + [(500, None), (501, ""), (502, "A b, C!")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(decontaminate.contamination(frame, benchmark)) == brute(rows, items)


def test_removed_passages(spark):
    passage = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    long = " ".join(f"word{i}" for i in range(60))
    halves = "alpha beta gamma delta epsilon " + passage + " zeta eta theta iota kappa " + long
    rows = [(1, f"{long}. {passage}, {long}", "x", 7), (2, passage + " tail", "x", 7), (3, long, None, None), (4, None, "x", 7), (5, "", "x", 7), (6, halves, "x", 7), (None, long, "x", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.decontaminate(frame, benchmark).collect()}
    assert set(out) == {1, 3, 4, 5, 6, None}
    assert out[1].text == f"{long}. \n, {long}" and out[1].n_chars == len(out[1].text) and out[1].spans == "x"
    assert (out[3].text, out[3].n_chars, out[4].text, out[4].n_chars, out[5].text) == (long, None, None, 7, "")
    assert out[6].text.split() == long.split()  # the cut brings together another passage, which goes too
    again = decontaminate.contamination(decontaminate.decontaminate(frame, benchmark), benchmark)
    assert not any(r.contaminated for r in again.collect())


def test_empty_tables(spark, documents):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(documents, nothing).where("contaminated").count() == 0
    assert decontaminate.contamination(documents.limit(0), nothing).count() == 0
    assert decontaminate.decontaminate(documents, nothing).count() == documents.count()
