"""Against all pairs by full sets."""

import itertools
import random
import re

from sitescope.llm import minhash


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        k = min(size, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations([i for i, s in enumerate(sets) if s], 2):
        if 100 * min(len(sets[a]), len(sets[b])) < percent * max(len(sets[a]), len(sets[b])):
            continue
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            root[find(a)] = find(b)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(key, least.get(find(i), key))
    return sorted((key, len(sets[i]), least[find(i)], key == least[find(i)]) for i, (key, _) in enumerate(rows))


def got(frame):
    return sorted(tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_whole_table(spark, documents, texts):
    assert got(minhash.near_duplicates(documents, size=4)) == brute(sorted(texts.items()), 4, 80)


def test_chains_and_borders(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for n in range(120):  # each copy a few words on from the last: chains beyond any one bucket
        words = list(base)
        for k in range(0, n, 9):
            words[k % 120] = f"x{n}-{k}" if k % 2 else f"y{k}"
        rows.append((n * 3, " ".join(words)))
    rows += [(1000 + n, " ".join(base[: 4 + n])) for n in range(40)]
    rows += [(2000 + n, "one two three four") for n in range(50)] + [(2100, "One TWO\tthree\nfour"), (2101, "one two three"), (2102, "one")]
    rows += [(3000, "Ünder  x \x1c y"), (3001, "ünder  x \x1c y"), (3002, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (4, 5):
        assert got(minhash.near_duplicates(frame, size)) == brute(rows, size, 80)


def test_edges(spark):
    schema = "doc_id long, text string, component_id string, kept int, id string"
    rows = [(5, None, "a", 1, "b"), (6, "", "a", 1, "b"), (7, " \n", "a", 1, "b"), (None, "a b c d e", "a", 1, "b"), (9, "a b c d e", None, None, None)]
    rows += [(8, "a b c d e", None, None, None), (9, "other text of nine", None, None, None), (12, "other text of nine", None, None, None)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, schema), 4).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == [
        (0, 0, True), (5, 5, True), (6, 6, True), (7, 7, True), (8, 8, True), (9, 8, False), (9, 8, False), (12, 8, False),
    ]
    empty = spark.createDataFrame([], schema)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.keep_first(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "component_id", "kept", "id"]
    assert {r.doc_id for r in kept.collect()} == {None, 5, 6, 7, 8}


def test_one_row_of_a_group_is_kept(spark):
    rows = [(1, "a b c d e f", i) for i in range(5)] + [(2, "a b c d e f", 0), (3, None, 0), (3, None, 0), (4, "", 0), (4, "x y", 0), (5, "only once", 0), (None, "n", 0), (None, "n", 0)]
    kept = minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    assert kept.columns == ["doc_id", "text", "n"]
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept.collect()) == [(0, "n"), (0, "n"), (1, "a b c d e f"), (3, ""), (4, "x y"), (5, "only once")]


def test_estimate_follows_the_sets():
    import numpy as np

    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8, 0.95):
        errors = []
        for _ in range(40):
            x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2)
            common = int(2000 * share)
            a = np.unique(x[: common + (2000 - common) // 2])
            b = np.unique(np.concatenate((x[:common], x[common + (2000 - common) // 2 :])))
            errors.append(minhash.estimate(minhash.sketch(a)[None], minhash.sketch(b)[None])[0] - share)
        assert abs(np.mean(errors)) < 0.02
        assert max(map(abs, errors)) < minhash.SLACK
