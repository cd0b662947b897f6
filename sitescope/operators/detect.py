"""Technology and marketing detection.

Every pattern is evaluated where the page is read. What leaves the scan is a few
narrow rows per page (pattern number, version text, generator, header value),
pre-aggregated per company on the map side, so neither HTML nor a popular site is
ever gathered in one place.

Patterns are searched page by page. A match that would run across the border of
two pages of a company does not count.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.functions.html import sql_string
from sitescope.functions.rules import (
    GENERATOR,
    GENERATOR_PATTERN,
    HEADER,
    HTML,
    RulePattern,
    java_regex,
    marketing_rules,
    required_literals,
    technology_rules,
)

# Letters outside ASCII that ignore-case matching folds to i, k or s.
_FOLDING_LETTERS = "[İıſK]"


def _literal_array(values: Sequence, kind: str) -> Column:
    literals = [sql_string(v) if isinstance(v, str) else str(v) for v in values]
    return F.expr(f"cast(array({', '.join(literals)}) as array<{kind}>)")


def _version(text: str, rule: RulePattern) -> str:
    if not rule.has_version:
        return "cast(null as string)"
    regex = sql_string(java_regex(rule.pattern))
    return f"nullif(regexp_extract({text}, {regex}, {rule.version_group}), '')"


def _hits(text: str, rules: Sequence[tuple[int, RulePattern]], guard=None) -> Column:
    """Array of (number, version) for the patterns found in the SQL value ``text``.

    ``guard`` gives a SQL test per rule that is made before the regular expression.
    Written as SQL text, so that a rule set becomes one expression at once.
    """
    tests = []
    for number, rule in rules:
        found = f"rlike({text}, {sql_string(java_regex(rule.pattern))})"
        if guard is not None:
            found = f"({guard(rule)}) and {found}"
        hit = f"named_struct('number', {number}, 'version', {_version(text, rule)})"
        tests.append(f"case when {found} then {hit} end")
    return F.expr(f"array_compact(array({', '.join(tests)}))")


def _with_lower(pages: DataFrame) -> DataFrame:
    """Adds the lower-cased page, and whether it holds letters lower() treats apart."""
    folded = reduce(lambda a, b: a | b, [F.col("html").contains(c) for c in _FOLDING_LETTERS])
    return pages.withColumn("_lower", F.lower("html")).withColumn("_folded", folded)


def _may_match(pattern: str) -> str:
    """Cheap necessary test: some required literal stands in the lower-cased page."""
    literals = required_literals(pattern)
    if literals is None:
        return "true"
    return " or ".join(["_folded", *[f"contains(_lower, {sql_string(t)})" for t in literals]])


def _html_hits(rules: Sequence[RulePattern]) -> Column:
    """Hits of all HTML patterns of a rule set; equal patterns are searched once."""
    numbered = [(n, r) for n, r in enumerate(rules) if r.kind == HTML]
    same: dict[str, list[tuple[int, RulePattern]]] = {}
    for number, rule in numbered:
        same.setdefault(rule.pattern, []).append((number, rule))
    once = [group[0] for group in same.values()]
    found = _hits("html", once, lambda r: _may_match(r.pattern))
    if len(once) == len(numbered):
        return found

    def repeated(hit: Column) -> Column:
        numbers = F.array(hit["number"])
        for group in same.values():
            if len(group) > 1:
                copies = _literal_array([n for n, _ in group], "int")
                numbers = F.when(hit["number"] == group[0][0], copies).otherwise(numbers)
        return F.transform(
            numbers, lambda n: F.struct(n.alias("number"), hit["version"].alias("version"))
        )

    return F.flatten(F.transform(found, repeated))


def page_matches(pages: DataFrame, rules: Sequence[RulePattern]) -> DataFrame:
    """HTML pattern hits per page: company_id, domain_id, page_id, number, version.

    ``number`` indexes ``rules``. Row-local.
    """
    return _with_lower(pages).select(
        "company_id", "domain_id", "page_id", F.inline(_html_hits(rules))
    )


def _first_page(value: str) -> Column:
    """Value on the first page of a company, domains and pages in id order."""
    return F.min_by(value, F.struct("domain_id", "page_id"))


def merged_headers(pages: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One value per company and lower-cased header: the first page that has it.

    ``names`` limits the result to some headers, which keeps the shuffle small.
    """
    entries = F.map_entries("headers")
    if names is not None:
        wanted = [n.lower() for n in names]
        entries = F.filter(entries, lambda e: F.lower(e["key"]).isin(wanted))
    spread = pages.select(
        "company_id", "domain_id", "page_id", F.posexplode(entries).alias("_pos", "_entry")
    )
    return (
        spread.groupBy("company_id", F.lower("_entry.key").alias("header"))
        .agg(F.min_by("_entry.value", F.struct("domain_id", "page_id", "_pos")).alias("value"))
    )


def _generator() -> Column:
    return F.regexp_extract("html", java_regex(GENERATOR_PATTERN), 1)


def generators(pages: DataFrame) -> DataFrame:
    """First generator named by the pages of each company."""
    # inline() keeps the HTML out of the aggregate's map-side sort.
    named = pages.select(
        "company_id",
        "domain_id",
        "page_id",
        F.inline(F.array(F.struct(_generator().alias("generator")))),
    )
    return (
        named.filter(F.col("generator") != "")
        .groupBy("company_id")
        .agg(_first_page("generator").alias("generator"))
    )


def _matches_nothing(rules: Sequence[tuple[int, RulePattern]]) -> list[tuple[int, RulePattern]]:
    """Patterns that an empty text satisfies."""
    return [(n, r) for n, r in rules if re.search(r.pattern, "", re.IGNORECASE)]


def _empty_text_hits(
    pages: DataFrame, with_text: DataFrame, rules: Sequence[tuple[int, RulePattern]]
) -> DataFrame:
    """Hits on the empty text for companies that have no text of the kind."""
    without = pages.select("company_id").distinct().join(with_text, "company_id", "left_anti")
    return without.select("company_id", F.inline(_hits("''", rules)))


def _header_value(name: str) -> Column:
    same = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == name)
    return F.get(same, F.lit(0))["value"]


def _header_slots(rules: Sequence[RulePattern]) -> dict[str, int]:
    """Slots of the headers some rule asks for, after those of the patterns and the generator."""
    headers = sorted({r.header for r in rules if r.kind == HEADER})
    return {h: len(rules) + 1 + i for i, h in enumerate(headers)}


def with_hits(pages: DataFrame, rules: Sequence[RulePattern] | None = None) -> DataFrame:
    """Adds what a rule set finds on a page: ``has_text`` and ``hits``.

    The HTML hits, the generator and the headers some rule asks for travel together as
    (number, version), where numbers below ``len(rules)`` are those of patterns. Row-local.
    """
    rules = technology_rules() if rules is None else tuple(rules)
    by_generator = any(r.kind == GENERATOR for r in rules)
    generator_slot, slots = len(rules), _header_slots(rules)

    def slot(number: int, value: Column) -> Column:
        return F.struct(F.lit(number).alias("number"), value.alias("version"))

    extra = [F.when(_header_value(h).isNotNull(), slot(n, _header_value(h))) for h, n in slots.items()]
    if by_generator:
        named = F.when(F.expr(_may_match(GENERATOR_PATTERN)), _generator())
        extra.append(F.when(named != "", slot(generator_slot, named)))
    hits = F.coalesce(_html_hits(rules), F.array().cast("array<struct<number:int,version:string>>"))
    if extra:
        hits = F.concat(hits, F.array_compact(F.array(*extra)))
    has_text = F.coalesce(F.col("html") != "", F.lit(False))
    return _with_lower(pages).select(*pages.columns, has_text.alias("has_text"), hits.alias("hits"))


def _company_matches(found: DataFrame, rules: Sequence[RulePattern]) -> DataFrame:
    """company_id, number, version over all three kinds of pattern.

    ``found`` are narrow rows of ``with_hits``; the first page of a company wins per slot.
    """
    numbered = list(enumerate(rules))
    by_html = [(n, r) for n, r in numbered if r.kind == HTML]
    by_generator = [(n, r) for n, r in numbered if r.kind == GENERATOR]
    by_header = [(n, r) for n, r in numbered if r.kind == HEADER]
    generator_slot, slots = len(rules), _header_slots(rules)
    # Not inline("hits"): for a plain column Spark adds tests of it, which repeat all patterns.
    first = (
        found.select("company_id", "domain_id", "page_id", F.inline(F.array_compact("hits")))
        .groupBy("company_id", "number")
        .agg(_first_page("version").alias("version"))
    )
    number, value = F.col("number"), F.col("version")
    hits = F.when(number < generator_slot, F.array(F.struct(number, value)))
    if by_generator:
        hits = hits.when(number == generator_slot, _hits("version", by_generator))
    if by_header:
        hits = hits.when(
            number > generator_slot, _hits("version", by_header, lambda r: f"number = {slots[r.header]}")
        )
    matches = first.select("company_id", F.inline(hits))

    on_empty = _matches_nothing(by_html)
    if on_empty:
        with_text = found.filter("has_text").select("company_id")
        matches = matches.unionByName(_empty_text_hits(found, with_text, on_empty))
    on_empty = _matches_nothing(by_generator)
    if on_empty:
        named = found.filter(F.exists("hits", lambda h: h["number"] == generator_slot))
        matches = matches.unionByName(_empty_text_hits(found, named.select("company_id"), on_empty))
    return matches


def detect_technologies(
    pages: DataFrame, rules: Sequence[RulePattern] | None = None
) -> DataFrame:
    """Technologies per company with confidence, evidence and version.

    ``pages`` needs company_id, domain_id, page_id, html and headers; domain and
    page ids give the page order. The strongest pattern wins, the earlier one on a
    tie; the version comes from the first pattern that captured one.
    """
    return technologies_of(with_hits(pages, rules).drop("html", "headers"), rules)


def technologies_of(found: DataFrame, rules: Sequence[RulePattern] | None = None) -> DataFrame:
    """``detect_technologies`` from rows that ``with_hits`` made, without their HTML."""
    rules = technology_rules() if rules is None else tuple(rules)
    number = F.col("number")

    def of(values: Sequence, kind: str) -> Column:
        return F.element_at(_literal_array(values, kind), number + 1)

    scored = _company_matches(found, rules).select(
        "company_id",
        "version",
        number,
        of([r.rule for r in rules], "int").alias("rule"),
        of([r.confidence for r in rules], "double").alias("confidence"),
    )
    best = scored.groupBy("company_id", "rule").agg(
        F.max("confidence").alias("confidence"),
        F.min(F.struct((-F.col("confidence")).alias("c"), number)).alias("_best"),
        F.min(F.when(F.col("version").isNotNull(), F.struct(number, "version"))).alias("_version"),
    )
    number = F.col("_best.number")
    return best.filter(F.col("confidence") > 0).select(
        "company_id",
        F.col("rule").alias("ord"),
        of([r.name for r in rules], "string").alias("technology"),
        of([r.category for r in rules], "string").alias("category"),
        "confidence",
        of([r.evidence for r in rules], "string").alias("evidence"),
        F.col("_version.version").alias("version"),
    )


def with_tools(pages: DataFrame, rules: Sequence[RulePattern] | None = None) -> DataFrame:
    """Adds ``tools``, the numbers of the marketing patterns that a page holds. Row-local."""
    rules = marketing_rules() if rules is None else tuple(rules)
    numbers = F.transform(_html_hits(rules), lambda h: h["number"])
    return _with_lower(pages).select(*pages.columns, F.coalesce(numbers, F.array().cast("array<int>")).alias("tools"))


def detect_marketing(pages: DataFrame, rules: Sequence[RulePattern] | None = None) -> DataFrame:
    """Marketing tools per company; evidence is the first pattern that is present."""
    rules = marketing_rules() if rules is None else tuple(rules)
    return _tools_of(page_matches(pages, rules), rules)


def marketing_of(found: DataFrame, rules: Sequence[RulePattern] | None = None) -> DataFrame:
    """``detect_marketing`` from rows that ``with_tools`` made, without their HTML."""
    rules = marketing_rules() if rules is None else tuple(rules)
    return _tools_of(found.select("company_id", F.explode("tools").alias("number")), rules)


def _tools_of(matches: DataFrame, rules: Sequence[RulePattern]) -> DataFrame:
    found = matches.groupBy("company_id", "number").agg(F.lit(1).alias("_"))
    rule_of = F.element_at(_literal_array([r.rule for r in rules], "int"), F.col("number") + 1)
    first = found.groupBy("company_id", rule_of.alias("ord")).agg(F.min("number").alias("number"))

    def of(values: Sequence[str]) -> Column:
        return F.element_at(_literal_array(values, "string"), F.col("number") + 1)

    return first.select(
        "company_id",
        "ord",
        of([r.name for r in rules]).alias("tool_name"),
        of([r.category for r in rules]).alias("category"),
        of([r.pattern for r in rules]).alias("evidence"),
    )


def rule_table(spark: SparkSession, rules: Sequence[RulePattern]) -> DataFrame:
    """A rule set as rows, one per pattern; ``number`` is the one in the matches."""
    data = [
        (n, r.rule, r.name, r.category, r.kind, r.header or None, r.confidence, r.pattern)
        for n, r in enumerate(rules)
    ]
    return spark.createDataFrame(
        data,
        "number int, ord int, name string, category string, kind string, header string, "
        "confidence double, pattern string",
    )


def companies_by_technology(company_technologies: DataFrame) -> DataFrame:
    """How many companies use each technology."""
    return company_technologies.groupBy("technology").agg(
        F.count_distinct("company_id").alias("companies")
    )


def technology_catalog(
    company_technologies: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """Catalog of technology names; a known name keeps its row, a new one takes the
    category of its first detection (company, then rule order)."""
    new = company_technologies.groupBy("technology").agg(
        F.min_by("category", F.struct("company_id", "ord")).alias("category")
    )
    new = new.withColumn("vendor", F.lit(None).cast("string"))
    if existing is None:
        return new
    return existing.select("technology", "category", "vendor").unionByName(
        new.join(existing, "technology", "left_anti")
    )
