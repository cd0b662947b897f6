import math
import random
import re
from collections import Counter

import pytest

from sitescope.plans.relevance import Blend, RelevanceIndex, build_index, query_terms, relevance
from sitescope.plans.search import Filter, SearchSpec

SCHEMA = "company_id long, display_name string, industry string, technologies array<string>, text_blob string, seo_score double, has_ssl boolean"
WEIGHTS = {"display_name": 100, "industry": 40, "technologies": 20, "text_blob": 10}


def split(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(rows, text, keep=lambda r: True, every=False, business=0.25):
    """(company_id, score) of all matches in order, by the formula over Python's dicts."""
    weights = {}
    for r in rows:
        found = Counter()
        for field, value in zip(("display_name", "industry", "technologies", "text_blob"), r[1:5], strict=True):
            for t in split(" ".join(value) if isinstance(value, list) else value):
                found[t] += WEIGHTS[field]
        weights[r[0]] = found
    n, mean = len(rows), sum(sum(w.values()) for w in weights.values()) / len(rows)
    holding = Counter(t for w in weights.values() for t in w)
    asked = [t for t in dict.fromkeys(split(text)) if t in holding]
    idf = {t: math.log(1 + (n - holding[t] + 0.5) / (holding[t] + 0.5)) for t in asked}
    top = sum(math.floor(1e6 * v * 2.2) for v in idf.values())
    out = []
    for r in rows:
        w = weights[r[0]]
        held = [t for t in asked if t in w]
        if not held or every and len(held) < len(set(split(text))) or not keep(r):
            continue
        parts = sum(math.floor(1e6 * (idf[t] * w[t] * 2.2 / (w[t] + 120 * (0.25 + 0.75 * sum(w.values()) / mean)))) for t in held)
        score = math.floor(1e6 * ((1 - business) * (parts / top) + business * min(max((r[5] or 0) / 100, 0), 1)))
        out.append((-score, r[1], r[0]))
    return [(i, -s / 1e6) for s, _, i in sorted(out)]


@pytest.fixture(scope="module")
def table():
    """Every row holds "all", half hold "common"; few hold others."""
    rng = random.Random(1)
    some = lambda k: " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "Común", "x9"]) for _ in range(rng.randint(0, k)))
    return [
        (
            i, f"{some(2)} all", rng.choice(["Retail", "Dental care", None]), [f"Tech {i % 9}", "WordPress"][: i % 3],
            ("common " if i % 2 else "") + some(9) * (i % 4), None if i % 10 == 0 else float((i * 37) % 101), i % 3 == 0,
        )
        for i in range(600)
    ]


@pytest.fixture(scope="module")
def frame(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def index(frame):
    return build_index(frame, block_documents=3)


def got(found):
    return [(r.company_id, r.score) for r in sorted(found.collect(), key=lambda r: r["rank"])]


@pytest.mark.parametrize("text", ["common", "alpha all", "COMÚN, x9 dental!", "wordpress 7 beta gamma", "unknown all"])
@pytest.mark.parametrize("every", [False, True])
def test_best_of_all(frame, table, index, text, every):
    spec = SearchSpec(text=text, page_size=15)
    assert got(relevance(index, frame, spec, every_term=every)) == brute(table, text, every=every)[:15]


def test_filters_pages_and_blend(frame, table, index):
    spec = SearchSpec(text="common beta", filters=(Filter("has_ssl", "is_true"),), page=2, page_size=7)
    want = brute(table, "common beta", keep=lambda r: r[6], business=0.6)
    found = relevance(index, frame, spec, Blend(0.6))
    assert got(found) == want[7:14] and [r["rank"] for r in found.orderBy("rank").collect()] == list(range(8, 15))


def test_blocks_below_the_bound_are_not_scored(frame, index):
    report = []
    relevance(index, frame, SearchSpec(text="common", page_size=10), report=report)
    (held, scored), = report
    assert scored < held / 3


def test_written_index(spark, frame, table, index, tmp_path):
    index.write(str(tmp_path / "index"))
    again = RelevanceIndex.read(spark, str(tmp_path / "index"))
    assert got(relevance(again, frame, SearchSpec(text="delta 3", page_size=9))) == brute(table, "delta 3")[:9]


def test_hot_term_is_dealt_by_document(frame, index):
    """Postings of one term are added up by document, so they do not meet in one task."""
    plan = relevance(index, frame, SearchSpec(text="all"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Aggregate [company_id" in plan and "partitionBy" not in plan
    assert not re.search(r"Aggregate \[term", plan)


def test_nothing_found(spark, frame, index):
    for text in (None, "", " ,;", "nowhere"):
        assert relevance(index, frame, SearchSpec(text=text)).collect() == []
    empty = frame.limit(0)
    assert relevance(build_index(empty), empty, SearchSpec(text="all")).collect() == []
    assert query_terms("Dental, CARE dental_x") == ["dental", "care", "x"]
