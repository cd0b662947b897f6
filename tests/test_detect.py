import random
import re

from conftest import rows
from sitescope.functions.rules import (
    GENERATOR_PATTERN,
    marketing_rules,
    required_literals,
    technology_rules,
)
from sitescope.operators import detect

PAGES = "company_id long, domain_id long, page_id long, html string, headers map<string,string>"

SNIPPETS = [
    '<meta name="generator" content="WordPress 6.1">',
    '<meta name="generator" content="WordPress">',
    "<meta name='generator' content='Drupal 9.5.1 (https://drupal.example)'>",
    '<link href="/WP-CONTENT/x.css">',
    "woocommerce",
    "cdn.shopify.com Shopify.theme",
    "cdnXshopifyXcom",
    'ng-version="12.3.4"',
    'ng-app ng-version=""',
    "data-v-0a1b2c3d",
    "data-v-xyz",
    "vue.min.js",
    "vueXjs",
    "hs-analytics",
    "UA-12345-1",
    "UA-12-1",
    "gtag/js?id=G-ABC gtag/js?id=AW-99",
    "bg-primary",
    "GTM-AB12 googletagmanager.com/gtm.js",
    "connect.facebook.net/en_US/fbevents.js",
    "connect.facebook.net/\n/fbevents.js",
    "fbq('init', '1')",
    '<input class="x" type="email">',
    "name='email'",
    "WhatsApp://send wa.me/1",
    "tawK.to embed.tawk.to",
    "marKeting.example hubſpot hſ-analytics",
    "plain text",
    "csrf-token",
]
HEADERS = [
    {},
    {"cf-ray": "1"},
    {"Server": "cloudflare"},
    {"server": "nginx"},
    {"Set-Cookie": "laravel_session=1"},
    {"set-cookie": "sid=1"},
]


def search(pattern, text):
    return re.search(pattern, text, re.IGNORECASE)


def model(pages, rules):
    """Detection by hand: page by page, company by company."""
    found = {}
    by_company = {}
    for page in sorted(pages, key=lambda p: (p[1], p[2])):
        by_company.setdefault(page[0], []).append(page)
    for company, own in by_company.items():
        headers, generator = {}, ""
        for page in own:
            for key, value in page[4].items():
                headers.setdefault(key.lower(), value)
            m = search(GENERATOR_PATTERN, page[3] or "")
            generator = generator or (m.group(1) if m else "")
        for rule in rules:
            if rule.kind == "html":
                ms = [m for m in (search(rule.pattern, p[3]) for p in own if p[3]) if m]
                m = ms[0] if ms else None
                if not any(p[3] for p in own):
                    m = search(rule.pattern, "")
            elif rule.kind == "meta_gen":
                m = search(rule.pattern, generator)
            else:
                m = search(rule.pattern, headers[rule.header]) if rule.header in headers else None
            if not m:
                continue
            entry = found.setdefault((company, rule.name), [0.0, "", None])
            if rule.confidence > entry[0]:
                entry[0], entry[1] = rule.confidence, rule.evidence
            if entry[2] is None:
                entry[2] = m.groupdict().get("version") or None
    return {k: tuple(v) for k, v in found.items() if v[0] > 0}


def random_pages(seed, companies=12):
    rng = random.Random(seed)
    pages = []
    for page_id in range(60):
        text = " ".join(rng.sample(SNIPPETS, rng.randint(0, 6)))
        pages.append(
            (
                rng.randrange(companies),
                rng.randrange(3),
                page_id,
                rng.choice([text, text, text, None, ""]),
                rng.choice(HEADERS),
            )
        )
    return pages


def test_technologies_agree_with_a_model(spark):
    pages = random_pages(1) + [(99, 1, 1000 + i, t, {}) for i, t in enumerate(SNIPPETS)]
    frame = spark.createDataFrame(pages, PAGES)
    got = {
        (r.company_id, r.technology): (r.confidence, r.evidence, r.version)
        for r in detect.detect_technologies(frame).collect()
    }
    assert got == model(pages, technology_rules())


def test_marketing_agrees_with_a_model(spark):
    pages = random_pages(2)
    frame = spark.createDataFrame(pages, PAGES)
    want = {}
    for rule in marketing_rules():
        for page in pages:
            if page[3] and search(rule.pattern, page[3]):
                want.setdefault((page[0], rule.name), (rule.position, rule.category, rule.pattern))
                best = want[page[0], rule.name]
                want[page[0], rule.name] = min(best, (rule.position, rule.category, rule.pattern))
    got = {
        (r.company_id, r.tool_name): (r.category, r.evidence)
        for r in detect.detect_marketing(frame).collect()
    }
    assert got == {k: v[1:] for k, v in want.items()}


def test_replaced_rules_and_patterns_that_match_nothing(spark):
    text = """
    Any | X | html | | 0.3 | z*
    Any | X | meta_gen | | 0.2 | ^$
    Ver | X | html | | 0.9 | v(?P<version>\\d)?
    Zero | X | html | | 0.0 | .
    Dup | Y | html | | 0.5 | same
    Dup2 | Y | html | | 0.6 | same
    Head | Y | header | X-A | 0.7 | ^b$
    """
    rules = technology_rules(text)
    pages = [
        (1, 1, 1, "v same", {"x-a": "b"}),
        (1, 1, 2, "v7", {"X-A": "c"}),
        (2, 1, 3, None, {}),
        (3, 1, 4, '<meta name="generator" content="G">', {"X-a": "c"}),
        (3, 2, 5, "v3", {"x-a": "b"}),
    ]
    got = {
        (r.company_id, r.technology): (r.confidence, r.evidence, r.version)
        for r in detect.detect_technologies(spark.createDataFrame(pages, PAGES), rules).collect()
    }
    assert got == model(pages, rules)
    assert got[1, "Ver"][2] is None  # the first page decides, even without a number
    assert (1, "Dup") in got and (1, "Dup2") in got and (1, "Zero") not in got


def test_required_literals_are_required():
    rng = random.Random(3)
    texts = SNIPPETS + ["".join(rng.choice("abGTMua-=_.?/\"'(1") for _ in range(30)) for _ in range(500)]
    for rule in technology_rules() + marketing_rules():
        literals = required_literals(rule.pattern)
        for text in texts:
            if literals and text.isascii() and search(rule.pattern, text):
                assert any(t in text.lower() for t in literals), rule.pattern
    assert required_literals("colou?r") == ["colo"]
    assert required_literals("ab|c+d") is None
    assert required_literals("foo|bar.baz") == ["foo", "bar"] or required_literals("foo|bar.baz") == ["foo", "baz"]
    assert required_literals(r"\x41bc") is None


def test_rule_sets_have_their_size():
    assert (len(technology_rules()), len({r.name for r in technology_rules()})) == (47, 26)
    assert (len(marketing_rules()), len({r.name for r in marketing_rules()})) == (34, 23)


def test_catalog_keeps_known_categories(spark):
    found = spark.createDataFrame(
        [(2, 1, "New", "B"), (1, 5, "New", "A"), (1, 0, "Old", "Z")],
        "company_id long, ord int, technology string, category string",
    )
    old = spark.createDataFrame([("Old", "First", "V")], "technology string, category string, vendor string")
    once = detect.technology_catalog(found, old)
    assert rows(once) == [
        {"technology": "New", "category": "A", "vendor": None},
        {"technology": "Old", "category": "First", "vendor": "V"},
    ]
    assert rows(detect.technology_catalog(found, once)) == rows(once)
