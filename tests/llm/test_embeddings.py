"""Against all pairs."""

import numpy as np

from sitescope.llm import embeddings
from sitescope.llm.common import read


def brute(rows, least):
    n = len(rows)
    ok = [r[1] is not None and r[2] is not None and None not in r[1] and len(r[1]) > 0 and np.isfinite(r[1]).all() and np.any(r[1]) and r[0] is not None for r in rows]
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    groups = {}
    for i in range(n):
        if ok[i]:
            groups.setdefault((rows[i][2], len(rows[i][1])), []).append(i)
    for group in groups.values():
        x = np.array([rows[i][1] for i in group], float)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= least
        for a, b in zip(*np.nonzero(near), strict=True):
            if a != b:
                links[group[a]] += 1
                root[find(group[a])] = find(group[b])
    smallest = {}
    for i in range(n):
        if rows[i][0] is not None:
            smallest[find(i)] = min(rows[i][0], smallest.get(find(i), rows[i][0]))
    return sorted((r[0] if r[0] is not None else -9, links[i], smallest.get(find(i), -9)) for i, r in enumerate(rows))


def got(frame):
    return sorted((r.vec_id if r.vec_id is not None else -9, r.n_links, r.component_id if r.component_id is not None else -9) for r in frame.collect())


def test_whole_table(spark):
    vectors = read(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    for least in (0.93, 0.4):
        want = brute(rows, least)
        assert got(embeddings.near_vectors(vectors, least)) == want
    assert any(w[1] for w in want)


def test_dense_clouds_and_small_sequences(spark, monkeypatch):
    """Chains across many sequences, copies, and a threshold that links much."""
    rng = np.random.default_rng(3)
    rows = []
    for label in (1, 2):
        centre = rng.normal(size=(4, 12))
        for i in range(260):
            v = (centre[i % 4] + rng.normal(size=12) * 0.25).tolist()
            rows.append((label * 10_000 + i, v, label))
    rows += [(30_000 + i, rows[7][1], 1) for i in range(50)] + [(40_000, [x * 7 for x in rows[7][1]], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embeddings, "LENGTH", 48)
    monkeypatch.setattr(embeddings, "LEAF", 16)
    for least in (0.93, 0.97):
        assert got(embeddings.near_vectors(frame, least)) == brute(rows, least)


def test_edges(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, float("nan")], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 0.0], None)]
    rows += [(8, [1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [2.0, 0.0], 1), (10, [0.0, 1.0], 1), (11, [0.0, 3.0], 1), (None, [1.0, 0.0], 1), (12, [1e300, 0.0], 1), (13, [1.0, 0.0], 2)]
    schema = "vec_id long, embedding array<double>, label int, links string, id int, size int"
    frame = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], schema)
    out = got(embeddings.near_vectors(frame))
    want = [(-9, 0, -9), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 2, 8), (9, 0, 9)]
    assert out == want + [(10, 1, 8), (10, 2, 8), (11, 1, 8), (12, 2, 8), (13, 0, 13)]
    assert embeddings.near_vectors(frame.limit(0)).count() == 0
