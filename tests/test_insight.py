"""Labels, estimates and contacts from small pages."""

import pytest

from sitescope.operators.classify import INDUSTRY_RULES, SIZE_RULES, classify, evidence_table, page_texts
from sitescope.operators.contacts import best_contacts, company_contacts
from sitescope.operators.intelligence import estimates, evidence_of, page_facts

RULES = evidence_table("A | 2 | red, deep red\n B | 3 | blue \n C | 1 | green")


def pages_of(spark, rows):
    """Rows of (company, path, html)."""
    data = [(c, f"https://x.example{p}", "contact" if "contact" in p else "careers" if "careers" in p else "other", h) for c, p, h in rows]
    return spark.createDataFrame(data, "company_id long, url string, page_type string, html string")


def labels(spark, rows, **how):
    return {r.company_id: r for r in classify(page_texts(pages_of(spark, rows)), RULES, **how).collect()}


def test_weights_places_and_repeats(spark):
    found = labels(
        spark,
        [
            (1, "/red-house", "<title>Blue</title><p>Deep, RED! blue</p>"), (1, "/x", "<p>red &amp; green</p>"),
            (2, "/", "<p>red</p>"), (2, "/a", "<p>red</p>"), (2, "/b", "<p>red redder</p>"),
            (3, "/", "<script>blue</script><!-- blue --><p>nothing</p>"), (4, "/", ""), (5, "/", None),
        ],
        least=1.0, lead=0.1,
    )
    # A: red by its url (2 * 2, on two pages 1.5 times) and deep red; B: blue in the title (3 * 4).
    assert (found[1].label, found[1].score, found[1].runner_up) == ("B", 12.0, "A")
    assert found[1].evidence == "blue" and found[1].confidence == round(12 / (12 + 8 + 1 + 1), 6)
    assert (found[2].label, found[2].score, found[2].confidence) == ("A", 3.5, round(3.5 / 4.5, 6))
    assert {k: (found[k].label, found[k].score, found[k].evidence) for k in (3, 4)} == {k: ("unknown", 0.0, None) for k in (3, 4)}
    assert 5 not in found


def test_below_the_least_or_the_lead_is_unknown(spark):
    rows = [(1, "/", "<p>red blue</p>"), (2, "/", "<p>green</p>")]
    found = labels(spark, rows, least=2.0, lead=0.5)
    assert [found[k].label for k in (1, 2)] == ["unknown", "unknown"]
    assert found[1].score == 3.0 and found[1].runner_up == "A" and found[1].confidence == 0.0
    assert labels(spark, rows, least=2.0, lead=0.3)[1].label == "B"


def test_own_rules(spark):
    rows = [(1, "/dental-clinic", "<title>Smile Dental Clinic</title><p>Your dentist. Family owned.</p>"), (2, "/", "<p>Investor relations, offices worldwide</p>")]
    texts = page_texts(pages_of(spark, rows))
    assert {r.company_id: r.label for r in classify(texts, INDUSTRY_RULES).collect()} == {1: "Dentistry", 2: "unknown"}
    assert {r.company_id: r.label for r in classify(texts, SIZE_RULES, least=3.0).collect()} == {1: "1-10", 2: "201+"}


def test_estimates_merge_independent_signals(spark):
    rows = [(1, f"/p{i}", "<p>x</p>") for i in range(4)] + [(1, "/careers/a", "<p>We are hiring</p>"), (1, "/careers/b", "<p>Copyright 2001-2024. Founded in 1995 by us</p>")]
    rows += [(2, "/", "<p>&copy; 2022 since 2022 we sell</p>"), (3, "/", None)]
    tools = spark.createDataFrame([(1, 5)], "company_id long, technologies long")
    evidence = evidence_of(page_facts(pages_of(spark, rows)), tools, 2024)
    found = {(r.company_id, r.attribute): (r.value, r.confidence, r.signals) for r in estimates(evidence).collect()}
    assert found[(1, "employee_range")] == ("11-50", round(1 - 0.75 * 0.7 * 0.75, 6), 3)
    assert found[(1, "hiring_status")] == ("hiring", round(1 - 0.5 * 0.4, 6), 2)
    assert found[(1, "company_age")] == ("20+", round(1 - 0.2 * 0.6, 6), 2)
    assert found[(1, "revenue_range")] == ("1M-20M", 0.25, 1)
    assert found[(2, "company_age")] == ("0-4", round(1 - 0.2 * 0.6, 6), 2) and found[(2, "hiring_status")] == ("not hiring", 0.4, 1)
    assert (3, "company_age") not in found and found[(3, "employee_range")][0] == "1-10"
    seen = {(r.signal, r.observed) for r in evidence.where("company_id = 1 and attribute = 'company_age'").collect()}
    assert seen == {("founding year", "1995"), ("copyright year", "2001")}
    assert estimates(evidence.limit(0)).collect() == []


def test_contacts(spark):
    rows = [
        (1, "/contact", '<a href="mailto:Info@Shop.example?subject=hi">m</a> info@shop.example <a href="tel:+61%202%205550%201234">call</a> Ring +61 2 5550 1234'),
        (1, "/a", "INFO@shop.example, logo@2x.png, a..b@c.example and 2024-01-01, 1234567"), (1, "/b", "info@shop.example (020) 555-1234"),
        (1, "/c", '<a href="https://www.facebook.com/shop/">f</a><a href="https://facebook.com/sharer?u=1">s</a><a href="https://de.linkedin.com/company/shop">l</a><a href="https://x.com/">x</a>'),
        (2, "/", '<script>var m = "no@no.example"</script><!-- no@no.example --><a href="mailto:noreply@shop.example">n</a>'), (3, "/", None),
    ]
    found = {(r.kind, r.value): (r.confidence, r.pages) for r in company_contacts(pages_of(spark, rows)).collect()}
    assert found == {
        ("mail", "info@shop.example"): (round(1 - 0.3 * 0.4 * 0.65**2, 6), 4),
        ("phone", "+61255501234"): (round(1 - 0.3 * 0.4, 6), 2),
        ("phone", "0205551234"): (0.35, 1),
        ("facebook", "https://facebook.com/shop"): (0.7, 1),
        ("linkedin", "https://linkedin.com/company/shop"): (0.7, 1),
    }
    best = {r.kind: r.value for r in best_contacts(company_contacts(pages_of(spark, rows))).collect()}
    assert best["phone"] == "+61255501234"


def test_repetition_counts_three_times_at_most(spark):
    rows = [(1, f"/{i}", "me@a.example") for i in range(9)]
    found = company_contacts(pages_of(spark, rows)).collect()
    assert [(r.confidence, r.pages) for r in found] == [(pytest.approx(1 - 0.65**3, abs=1e-6), 9)]
