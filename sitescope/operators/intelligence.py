"""Estimates about companies from public signals, each with a confidence and its evidence.

A signal speaks for one value of an attribute with a probability. Independent signals for
one value are merged by noisy-or: the value is wrong only if all of them are. The value with
the highest confidence is the estimate; the evidence rows tell what it rests on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.operators.classify import page_texts

# Phrases and year patterns that the signals look for.
HIRING = ("we are hiring", "open positions", "apply now", "join our team", "current vacancies")
COPYRIGHT = r"(?:©|&copy;|\(c\)|copyright)[^0-9]{0,20}((?:19|20)\d\d)"
FOUNDED = r"(?:founded in|established in|established|since|est) ((?:19|20)\d\d) "


def page_facts(pages: DataFrame) -> DataFrame:
    """One row for each company: pages, careers pages, hiring pages, the first copyright and founding years.

    ``pages``: company_id, url, page_type, html. Pages are read once; numbers are added up before they move.
    """
    narrow = pages.select("company_id", "url", "html", (F.col("page_type") == "careers").cast("int").alias("careers"))
    counted = narrow.groupBy("company_id").agg(F.count("*").alias("pages"), F.sum("careers").alias("careers"))
    shown = F.nullif(F.regexp_extract(F.lower("html"), COPYRIGHT, 1), F.lit("")).cast("int")
    years = narrow.where("html is not null").select("company_id", shown.alias("shown")).groupBy("company_id").agg(F.min("shown").alias("copyright"))
    hiring = None
    for phrase in HIRING:
        test = F.col("text").contains(f" {phrase} ")
        hiring = test if hiring is None else hiring | test
    texts = page_texts(narrow).select("company_id", hiring.alias("hiring"), F.nullif(F.regexp_extract("text", FOUNDED, 1), F.lit("")).cast("int").alias("year"))
    said = texts.groupBy("company_id").agg(F.count_if("hiring").alias("hiring"), F.min("year").alias("founded"))
    return counted.join(years, "company_id", "left").join(said, "company_id", "left")


def _steps(number: Column, *steps: tuple[int, str, float]) -> tuple[Column, Column]:
    """Value and probability of the first step that a number reaches; the last step is for all others."""
    value, p = None, None
    for least, label, share in steps:
        test = number >= least
        value = F.when(test, label) if value is None else value.when(test, label)
        p = F.when(test, F.lit(share)) if p is None else p.when(test, F.lit(share))
    return value, p


def evidence_of(facts: DataFrame, technologies: DataFrame, year: int) -> DataFrame:
    """(company_id, attribute, value, signal, observed, probability): a row for each signal that speaks.

    ``technologies``: company_id and number of technologies.
    """
    known = facts.join(technologies.select("company_id", "technologies"), "company_id", "left")

    def signal(attribute: str, name: str, observed: Column, value: Column, p: Column) -> Column:
        return F.struct(
            F.lit(attribute).alias("attribute"), value.alias("value"), F.lit(name).alias("signal"), observed.cast("string").alias("observed"), p.cast("double").alias("probability")
        )

    pages, careers, tools = F.col("pages"), F.coalesce("careers", F.lit(0)), F.coalesce("technologies", F.lit(0))
    hiring, ages = F.coalesce("hiring", F.lit(0)), {c: F.lit(year) - F.col(c) for c in ("founded", "copyright")}
    eras = ((20, "20+"), (10, "10-19"), (5, "5-9"), (0, "0-4"))
    volume = _steps(pages, (30, "201+", 0.3), (12, "51-200", 0.3), (5, "11-50", 0.25), (1, "1-10", 0.25))
    jobs = _steps(careers, (3, "51-200", 0.4), (1, "11-50", 0.3))
    footprint = _steps(tools, (8, "51-200", 0.3), (4, "11-50", 0.25), (1, "1-10", 0.2))
    money = _steps(tools, (8, "20M+", 0.25), (4, "1M-20M", 0.25), (1, "under 1M", 0.2))
    earned = _steps(pages, (30, "20M+", 0.25), (12, "1M-20M", 0.25), (1, "under 1M", 0.2))
    rows = [
        signal("employee_range", "page volume", pages, *volume),
        signal("employee_range", "careers pages", careers, *jobs),
        signal("employee_range", "technologies", tools, *footprint),
        signal("revenue_range", "technologies", tools, *money),
        signal("revenue_range", "page volume", pages, *earned),
        signal("hiring_status", "careers pages", careers, *_steps(careers, (3, "hiring", 0.7), (1, "hiring", 0.5), (0, "not hiring", 0.4))),
        signal("hiring_status", "phrases", hiring, *_steps(hiring, (2, "hiring", 0.7), (1, "hiring", 0.6))),
        signal("company_age", "founding year", F.col("founded"), *_steps(ages["founded"], *[(n, v, 0.8) for n, v in eras])),
        signal("company_age", "copyright year", F.col("copyright"), *_steps(ages["copyright"], *[(n, v, 0.4) for n, v in eras])),
    ]
    return known.select("company_id", F.inline(F.array(*rows))).where("value is not null")


def estimates(evidence: DataFrame) -> DataFrame:
    """(company_id, attribute, value, confidence, signals): the likeliest value of each attribute; equal ones by name.

    A signal counts once for a value. Lists are no longer than the signals are many.
    """
    once = evidence.groupBy("company_id", "attribute", "value", "signal").agg(F.max("probability").alias("p"))
    merged = once.groupBy("company_id", "attribute", "value").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    wrong = F.aggregate("ps", F.lit(1.0), lambda w, p: w * (1 - p))
    merged = merged.select("company_id", "attribute", "value", F.round(1 - wrong, 6).alias("confidence"), F.size("ps").alias("signals"))
    best = merged.groupBy("company_id", "attribute").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "value", "signals")).alias("b"))
    return best.select("company_id", "attribute", "b.value", (-F.col("b.c")).alias("confidence"), "b.signals")
