"""Against plain Lloyd rounds in Python's integers; and the geometry against drawn vectors."""

import hashlib
import math

import numpy as np

from sitescope.llm import centroids
from sitescope.llm.common import read


def brute(rows, k=8, rounds=10, scale=1024, size=64, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and None not in v and all(map(math.isfinite, v))]
    hashed = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    middle = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashed(r[0]), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        place = [min(range(len(middle)), key=lambda j: (square(v, middle[j]), j)) for _, v in kept]
        if turn < rounds:
            for j in range(len(middle)):
                own = [v for (_, v), p in zip(kept, place, strict=True) if p == j]
                if own:
                    middle[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    far = [square(v, middle[p]) for (_, v), p in zip(kept, place, strict=True)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    sums = [sum(d for d, q in zip(far, place, strict=True) if q == j) for j in range(len(middle))]
    return sorted((i if i is not None else -9, p, d, sums[p], sum(far), digest[p]) for (i, _), p, d in zip(kept, place, far, strict=True))


def got(frame):
    return sorted((r.vec_id if r.vec_id is not None else -9, *r[1:]) for r in frame.collect())


def test_whole_table(spark):
    vectors = read(spark, "/root/testdata/sf0.01", "embeddings")
    assert got(centroids.clusters(vectors)) == brute([(r.vec_id, r.embedding) for r in vectors.collect()])


def test_groups_are_skipped(spark, monkeypatch):
    """Vectors in groups: most are settled by their bounds, and the losses are below the drifts."""
    monkeypatch.setattr(centroids, "BLOCK", 50)
    monkeypatch.setattr(centroids, "WRITTEN", 3)
    rng = np.random.default_rng(1)
    heads = rng.normal(size=(8, 64)) * 3
    rows = [(int(i), (heads[i % 8] + rng.normal(size=64) * 0.1).tolist()) for i in range(800)]
    report = []
    found = centroids.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), report=report)
    assert got(found) == brute(rows)
    assert sum(r[0] for r in report[2:]) < 0.5 * 800 * len(report[2:])
    assert any(loss < 0.9 * drift for _, drift, loss in report if drift)


def test_losses_hold():
    """No vector of a sphere comes nearer than its bound says, and many bounds are below the drift."""
    rng = np.random.default_rng(2)
    below = 0
    for _ in range(300):
        old = rng.integers(-400, 400, (4, 3))
        new = old + rng.integers(-60, 60, (4, 3))
        radius = rng.uniform(0, 250, 4)
        loss = centroids.losses(old, new, radius)
        for i in range(4):
            x = rng.normal(size=(400, 3))
            x *= (radius[i] * rng.uniform(0, 1, 400) ** 0.2 / np.linalg.norm(x, axis=1))[:, None]
            x += old[i]
            for j in set(range(4)) - {i}:
                assert (np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)).max() <= loss[i]
            others = [np.linalg.norm(new[j] - old[j]) for j in range(4) if j != i]
            assert loss[i] <= max(others) * (1 + 1e-8) + 1e-5
            below += loss[i] < 0.9 * max(others)
    assert below > 200


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [float(i % 7) / 8 - 0.3 for i in range(64)]
    w = [-x for x in v]
    rows = [
        (1, v, "a"), (1, w, "b"), (2, v, None), (None, w, "n"), (3, None, "x"), (4, [], "x"), (5, v[:63], "x"), (6, v[:63] + [None], "x"),
        (7, v[:63] + [nan], "x"), (8, v[:63] + [inf], "x"), (9, [0.0] * 64, "x"), (-5, v, "x"),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    want = brute([r[:2] for r in rows])
    assert got(centroids.clusters(frame)) == want and len(want) == 6
    assert got(centroids.clusters(frame, k=2)) == brute([r[:2] for r in rows], k=2)
    assert got(centroids.clusters(frame, k=1, rounds=0)) == brute([r[:2] for r in rows], k=1, rounds=0)
    assert centroids.clusters(frame.limit(0)).collect() == []
    assert centroids.clusters(frame.where("vec_id = 8")).collect() == []


def test_large_components(spark):
    """Beyond what floats hold exactly, the arithmetic goes on in Python's integers."""
    rows = [(i, [float((i * 37 + j * 11) % 101 - 50) * 2.0**20 for j in range(64)]) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for got_row, want in zip(got(centroids.clusters(frame, k=3)), brute(rows, k=3), strict=True):
        capped = [min(x, centroids.LONG) if isinstance(x, int) else x for x in want]
        assert list(got_row) == capped
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], "vec_id long, embedding array<double>")
    assert [r.distance for r in centroids.clusters(huge, k=1).collect()] == [centroids.LONG] * 2
