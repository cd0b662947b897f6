import random

from sitescope.operators.groups import linked_groups
from sitescope.operators.locations import resolve_locations

ADDRESS = "company_id long, street string, city string, state string, postcode string, country string"


def places(spark, rows):
    found = resolve_locations(spark.createDataFrame(rows, ADDRESS).repartition(3))
    links = {(r.company_id, r.location_id): r.addresses for r in found.links.collect()}
    return {r.location_id: r for r in found.locations.collect()}, links


def test_spellings_of_one_place(spark):
    rows = [
        (1, "12 King St.", "Sydney", "NSW", "2000", "Australia"), (2, "12, KING street", " sydney ", None, "2000", "AUSTRALIA"),
        (3, "12 Kinng Street", "Sydney", None, None, "Australia"), (3, "12 King St", "Sydney", None, None, "Australia"),
        (4, "13 King Street", "Sydney", None, "2000", "Australia"), (5, "12 King Road", "Sydney", None, "2000", "Australia"),
        (6, "12 King Street", "Perth", None, "2000", "Australia"), (7, "12 King Street", "Sydney", None, "2000", "Canada"),
        (8, None, "Sydney", None, None, None), (9, "12 King St", None, None, None, None), (10, " . ", "Sydney", None, None, None), (1, "12 king st", "sydney", "nsw", "2000", "australia"),
    ]
    locations, links = places(spark, rows)
    by = {}
    for company, location in links:
        by.setdefault(location, set()).add(company)
    # The typing error without a postcode is not that of the coded street: its own street has no code.
    assert sorted(map(sorted, by.values())) == [[1, 2, 3], [3], [4], [5], [6], [7]]
    best = next(locations[k] for k, v in by.items() if v == {1, 2, 3})
    assert (best.street, best.state, best.postcode, best.addresses) == ("12 king street", "nsw", "2000", 4)
    assert links[(1, best.location_id)] == 2


def test_codes(spark):
    """A missing code is the only one that the street has; between several it is none of them."""
    one = [(1, "1 Castle Rd", "C", None, "5", None), (2, "1 Castle Road", "C", None, None, None)]
    assert len(places(spark, one)[0]) == 1
    two = [*one, (3, "1 Castle Rd", "C", None, "6", None)]
    assert len(places(spark, two)[0]) == 3


def test_chains_and_a_large_city(spark):
    """Spellings a step apart each are one place, and a city of very many streets is no group."""
    steps = ["orchard", "orchrd", "orchd", "orcd"]
    rows = [(i, f"5 {s} lane", "Big", None, None, None) for i, s in enumerate(steps)]
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(12)) for _ in range(400)]
    rows += [(100 + i, f"5 {w} Lane", "Big", None, None, None) for i, w in enumerate(words)]
    locations, links = places(spark, rows)
    assert len({k for c, k in links if c < 4}) == 1 and len(locations) == 1 + len(set(words))
    assert resolve_locations(spark.createDataFrame([], ADDRESS)).links.collect() == []


def test_groups(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = {r.node: r.group for r in linked_groups(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: find(n) for a, b in links if a != b for n in (a, b)}
    assert linked_groups(spark.createDataFrame([], "a long, b long")).collect() == []
