import random

import pytest

from sitescope.operators.names import name_classes, names_like, similar_names


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, name, edits):
    for _ in range(rng.randint(0, edits)):
        i = rng.randint(0, len(name))
        name = rng.choice([name[:i] + rng.choice("abxyz ") + name[i:], name[:i] + name[i + 1 :], name[:i] + rng.choice("abé") + name[i + 1 :]])
    return name


@pytest.mark.parametrize(("edits", "key_names"), [(1, 100), (1, 2), (2, 100), (2, 2)])
def test_recall_is_one(spark, edits, key_names):
    """Short, long and edited names, with a common beginning; also where every trigram is too frequent to be a key."""
    rng = random.Random(edits)
    bases = ["ab", "a b c", "acme", "northern lights", "acme dental practice", "aaaa aaaa aaaa", "acme digital agency of the north", "zzzzzzzz"]
    names = [edited(rng, rng.choice(bases), edits + 1) for _ in range(150)] + [f"company number {i:04d}" for i in range(60)]
    frame = spark.createDataFrame([(i, n.upper() if i % 5 == 0 else n) for i, n in enumerate(names)], "company_id long, display_name string")
    plain = {}
    for i, n in enumerate(names):
        if n.split():
            plain.setdefault(" ".join(n.split()), i)
    classes = sorted((i, n) for n, i in plain.items())
    want = {(a, b, distance(x, y)) for k, (a, x) in enumerate(classes) for b, y in classes[k + 1 :] if abs(len(x) - len(y)) <= edits}
    want = {w for w in want if w[2] <= edits}
    found = similar_names(name_classes(frame), edits, key_names)
    pairs = [tuple(r) for r in found.collect()]
    assert set(pairs) == want and len(pairs) == len(want) and len(want) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_copies_are_members_and_not_pairs(spark):
    rows = [(i, "Same Name") for i in range(50)] + [(60, " same-name! "), (61, None), (62, "..."), (63, "Same Nome")]
    classes = name_classes(spark.createDataFrame(rows, "company_id long, display_name string"))
    assert {(r.company_id, r["class"]) for r in classes.collect()} == {*((i, 0) for i in range(50)), (60, 0), (63, 63)}
    assert [tuple(r) for r in similar_names(classes).collect()] == [(0, 63, 1)]
    assert similar_names(classes.limit(0)).collect() == []
    with pytest.raises(ValueError):
        similar_names(classes, 0)


def test_typed_name(spark):
    rows = [(1, "Acme Dental"), (2, "ACME Dentall"), (3, "Other"), (4, None), (5, "Acme")]
    found = names_like(spark.createDataFrame(rows, "company_id long, display_name string"), "acme dentl", 0.3)
    assert [r.company_id for r in found.collect()] == [1, 2, 5]
    assert found.first().similarity == round(9 / 14, 6)
    assert names_like(spark.createDataFrame(rows, "company_id long, display_name string"), " ", 0.3).collect() == []
