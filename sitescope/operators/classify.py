"""Labels of companies from weighted evidence on their pages: industries, size buckets.

A rule is a phrase that speaks for a label with some weight. On a page it counts once, by the
most telling place it stands in. Pages with the same phrase add up to twice the weight of
one at most, each further page half of what the last one added. The label with the
highest sum wins if the sum and its lead are large enough; else the label is unknown.
Pages are read once and in place; what moves is a row for each company and phrase.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.functions import html as H
from sitescope.functions.urls import raw_path_of

#: What a phrase counts by its place.
PLACES = {"title": 4, "url": 2, "text": 1}
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Evidence:
    label: str
    phrase: str
    weight: int


def evidence_table(text: str) -> list[Evidence]:
    """Rules from lines of ``label | weight | phrase, phrase, ...``; phrases are plain lower-case words."""
    rules = []
    for line in filter(str.strip, text.splitlines()):
        label, weight, phrases = (part.strip() for part in line.split("|"))
        rules += [Evidence(label, " ".join(p.lower().split()), int(weight)) for p in phrases.split(",")]
    return rules


INDUSTRY_RULES = evidence_table(
    """
    Dentistry | 4 | dentist, dental clinic, orthodontics, teeth whitening
    Dentistry | 2 | root canal, oral hygiene
    Healthcare | 3 | medical centre, general practitioner, physiotherapy, patients
    Legal | 4 | law firm, solicitors, attorney at law
    Legal | 2 | litigation, conveyancing
    Accounting | 4 | chartered accountants, bookkeeping, tax returns
    Real Estate | 3 | real estate agency, property management, open homes
    Construction | 3 | builders, renovations, civil construction, roofing
    Hospitality | 3 | restaurant, book a table, our menu, hotel rooms
    Retail | 2 | add to cart, free shipping, gift cards
    Retail | 3 | online store
    Software | 3 | software as a service, api documentation, free trial
    Education | 3 | enrolments, our school, tutoring
    Automotive | 3 | car dealership, vehicle servicing, test drive
    Fitness | 3 | personal training, gym membership, pilates
    Beauty | 3 | hair salon, beauty therapy, day spa
    """
)
SIZE_RULES = evidence_table(
    """
    1-10 | 3 | sole trader, family owned, owner operated
    11-50 | 2 | our small team, local team of
    51-200 | 3 | our departments, regional offices
    201+ | 4 | offices worldwide, investor relations, annual report
    201+ | 2 | global leader, subsidiaries
    """
)


def plain_words(text: Column) -> Column:
    """Lower-case words with single blanks between, before and behind them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def page_texts(pages: DataFrame) -> DataFrame:
    """(company_id, title, url, text) as plain words of pages with HTML. ``pages``: company_id, url, html."""
    marked = pages.where("html is not null").select("company_id", F.col("url").alias("_url"), H.visible_markup(F.col("html")).alias("_markup"))
    text = H.decode_entities(F.regexp_replace(F.regexp_replace("_markup", H.TEMPLATE, " "), H.ANY_TAG, " "))
    return marked.select(
        "company_id",
        plain_words(H.raw_title(F.col("_markup"))).alias("title"),
        plain_words(raw_path_of(F.col("_url"))).alias("url"),
        plain_words(text).alias("text"),
    )


def gather_evidence(texts: DataFrame, rules: Sequence[Evidence]) -> DataFrame:
    """(company_id, label, phrase, points, pages) for each phrase found; a company without any has one row of nulls."""

    def hit(number: int, rule: Evidence) -> Column:
        place = None
        for name, factor in PLACES.items():
            found = F.col(name).contains(f" {rule.phrase} ")
            place = F.when(found, F.lit(factor)) if place is None else place.when(found, F.lit(factor))
        return F.struct(F.lit(number).alias("rule"), place.alias("factor"))

    hits = F.filter(F.array(*[hit(i, r) for i, r in enumerate(rules)]), lambda h: h["factor"].isNotNull())
    rows = texts.select("company_id", F.explode_outer(hits).alias("h")).select("company_id", "h.rule", "h.factor")
    found = rows.groupBy("company_id", "rule").agg(F.max("factor").alias("factor"), F.count("factor").alias("pages"))
    facts = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.phrase).alias("phrase"), F.lit(r.weight).alias("weight")) for r in rules])
    found = found.withColumn("r", F.get(facts, F.col("rule")))
    # Sums of halves of whole numbers are exact, in any order.
    points = F.col("r.weight") * F.col("factor") * (2 - F.pow(F.lit(2.0), 1 - F.least("pages", F.lit(20))))
    return found.select("company_id", "r.label", "r.phrase", points.alias("points"), "pages")


def classify(texts: DataFrame, rules: Sequence[Evidence], least: float = 4.0, lead: float = 0.2) -> DataFrame:
    """(company_id, label, confidence, score, runner_up, evidence) of every company with pages.

    ``least`` is the smallest sum that counts and ``lead`` the share of it that the runner-up must
    stay behind. Confidence is the share of the best label in all points and ``least`` more.
    ``evidence`` lists the phrases of the best label, the strongest first.
    """
    evidence = gather_evidence(texts, rules)
    sums = evidence.groupBy("company_id", "label").agg(
        F.sum("points").alias("points"), F.sort_array(F.collect_list(F.struct((-F.col("points")).alias("p"), "phrase"))).alias("phrases")
    )  # lists no longer than the rules
    ranked = sums.groupBy("company_id").agg(F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), F.struct((-F.col("points")).alias("p"), "label", "phrases")))).alias("all"))
    best, second = F.get("all", F.lit(0)), F.get("all", F.lit(1))
    score, behind = -best["p"], F.coalesce(-second["p"], F.lit(0.0))
    total = F.aggregate("all", F.lit(0.0), lambda s, x: s - x["p"])
    sure = (score >= least) & (score - behind >= lead * score)
    return ranked.select(
        "company_id",
        F.when(sure, best["label"]).otherwise(UNKNOWN).alias("label"),
        F.when(sure, F.round(score / (total + least), 6)).otherwise(0.0).alias("confidence"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
        second["label"].alias("runner_up"),
        F.when(sure, F.array_join(F.transform(best["phrases"], lambda x: x["phrase"]), ", ")).alias("evidence"),
    )
