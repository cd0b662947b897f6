"""Against scores of all pairs in Python's integers."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sitescope.llm import balltree
from sitescope.llm.common import read


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, limit=10):
    docs = [(i, Counter(split(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    holding = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            norm = 100 - 75 + (75 * sum(c.values()) * n) // total
            score = 0
            for t in split(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * norm))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored)[:limit], 1)]
    return sorted(out, key=repr)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_whole_table(spark, documents, texts):
    benchmark = read(spark, "/root/testdata/sf0.01", "benchmark")
    report = []
    found = balltree.ranked(documents.select("doc_id", "text").coalesce(1), benchmark, report=report)
    assert got(found) == brute(sorted(texts.items()), [tuple(r) for r in benchmark.collect()])


def test_documents_are_pruned(spark):
    """Most documents of a larger table are never scored."""
    report = []
    documents, benchmark = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "benchmark")
    balltree.ranked(documents.coalesce(2), benchmark, report=report)
    (scored, queries, held), = report
    assert scored < 0.4 * queries * held


@pytest.mark.parametrize("passes", [16_384, 30])
def test_small_vocabulary(spark, monkeypatch, passes):
    """Ties, repeats and copies; in one pass and in several, with small trees."""
    monkeypatch.setattr(balltree, "PASS_TERMS", passes)
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(["Aa", "b", "c9", "é", "日本", "DD", "x-y", "zz"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 12))) for i in range(300)] + [(i, "aa b") for i in range(400, 440)] + [(7, "aa b"), (None, "aa b"), (None, None), (500, ""), (501, "--")]
    items = [(i, text(rng.randint(0, 9))) for i in range(25)] + [(3, "aa b"), (None, "aa b"), (90, None), (91, "unknown"), (92, "aa " * 50)]
    documents = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, item string, score int").repartition(3)
    benchmark = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, rank int")
    assert got(balltree.ranked(documents, benchmark)) == brute(rows, items)


def test_empty(spark):
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for documents, items in ((some.limit(0), asked), (some, asked.limit(0)), (some, asked.where("item_id > 1")), (some.where("text = ''"), asked)):
        found = balltree.ranked(documents, items)
        assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]
    long = spark.createDataFrame([(1, "a " * 400_000), (2, "b")], "doc_id long, text string")
    assert [r.doc_id for r in balltree.ranked(long, asked).collect()] == [1]


def test_bounds_hold():
    """No row below a node scores more than the node's bound."""
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 12, 200)
    index = np.concatenate([np.sort(rng.choice(50, n, replace=False)) for n in counts])
    value = rng.integers(1, 10**9, len(index))
    starts = np.concatenate([[0], np.cumsum(counts)])
    tree = balltree.Tree(starts, index, value, 50)
    dense = np.zeros((200, 50), np.int64)
    dense[np.repeat(np.arange(200), counts), index] = value
    at, times = np.array([1, 5, 7, 30]), np.array([1, 2, 1, 3])
    scores = (dense[:, at] @ times)[tree.order]
    nodes = np.arange(len(tree.low))
    for node, bound in zip(nodes, tree.bounds(nodes, at, times.astype(float)), strict=True):
        low, high = tree.low[node], tree.high[node]
        assert high > low and scores[low:high].max() <= bound
