"""Contacts of companies from their pages: mail addresses, phones and social profiles.

Found in links (``mailto:``, ``tel:``, profile urls) and in the visible text, validated, brought
to one form and merged over pages. The confidence follows from where a contact stands and
how often: each place is right with some probability, up to three pages of a place count,
and a contact is wrong only if all of them are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.functions import html as H
from sitescope.functions.urls import host_of, raw_path_of

# Patterns, hosts of profiles, places and their probabilities.
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"\+[0-9][0-9 ().-]{6,20}[0-9]|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
NOT_MAIL = r"(?i)\.(?:png|jpe?g|gif|svg|webp|css|js)$|^(?:noreply|no-reply|you|name|user)@"
PROFILES = {
    "facebook.com": "facebook", "instagram.com": "instagram", "linkedin.com": "linkedin", "twitter.com": "twitter", "x.com": "twitter",
    "youtube.com": "youtube", "tiktok.com": "tiktok", "pinterest.com": "pinterest", "wa.me": "whatsapp",
}
NOT_PROFILE = r"(?i)^/(?:share|sharer|intent|home|login|hashtag)\b"
PROBABILITY = {"link": 0.7, "contact page": 0.6, "text": 0.35}
REPEATS = 3


def phone_number(text: Column) -> Column:
    """Digits, with a plus if it was written; null unless there are 8 to 15, or 10 without a plus."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    plus = F.trim(text).startswith("+")
    return F.when(plus & F.length(digits).between(8, 15), F.concat(F.lit("+"), digits)).when(~plus & (F.length(digits) == 10), digits)


def mail_address(text: Column) -> Column:
    """Lower case; null for file names, placeholders and parts over 64 characters."""
    mail = F.lower(F.trim(text))
    good = mail.rlike(f"^{MAIL}$") & ~mail.rlike(NOT_MAIL) & ~mail.contains("..") & (F.length(F.substring_index(mail, "@", 1)) <= 64)
    return F.when(good, mail)


def _entry(kind: Column, value: Column, place: Column) -> Column:
    return F.struct(kind.alias("kind"), value.alias("value"), place.alias("place"))


def _of_link(href: Column) -> Column:
    """The contact of a link; its value is null for other links."""
    target = F.regexp_replace(F.substring_index(F.regexp_replace(href, r"(?i)^(?:mailto|tel):", ""), "?", 1), "%20", " ")
    scheme = F.lower(F.substring_index(href, ":", 1))
    host = F.regexp_replace(host_of(href), r"^(?:m|[a-z]{2})\.", "")
    network = None
    for name, kind in PROFILES.items():
        network = F.when(host == name, kind) if network is None else network.when(host == name, kind)
    path = F.regexp_replace(raw_path_of(href), "/+$", "")
    profile = F.when((path != "") & ~path.rlike(NOT_PROFILE), F.concat(F.lit("https://"), host, path))
    kind = F.when(scheme == "mailto", "mail").when(scheme == "tel", "phone").otherwise(network)
    value = F.when(scheme == "mailto", mail_address(target)).when(scheme == "tel", phone_number(target)).when(network.isNotNull(), profile)
    return _entry(kind, value, F.lit("link"))


def page_contacts(pages: DataFrame) -> DataFrame:
    """(company_id, kind, value, place): contacts of each page, once each. ``pages``: company_id, page_type, html."""
    marked = pages.where("html is not null").select("company_id", "page_type", H.visible_markup(F.col("html")).alias("_markup"))
    text = H.decode_entities(F.regexp_replace(F.regexp_replace("_markup", H.TEMPLATE, " "), H.ANY_TAG, " "))
    read = marked.select("company_id", "page_type", H.hrefs(F.col("_markup")).alias("_hrefs"), text.alias("_text"))
    place = F.when(F.col("page_type") == "contact", "contact page").otherwise("text")
    mails = F.transform(F.regexp_extract_all("_text", F.lit(MAIL), F.lit(0)), lambda m: _entry(F.lit("mail"), mail_address(m), place))
    phones = F.transform(F.regexp_extract_all("_text", F.lit(PHONE), F.lit(0)), lambda p: _entry(F.lit("phone"), phone_number(p), place))
    found = F.concat(F.transform("_hrefs", _of_link), mails, phones)
    found = F.array_distinct(F.filter(found, lambda c: c["value"].isNotNull()))
    return read.select("company_id", F.inline(found))


def company_contacts(pages: DataFrame) -> DataFrame:
    """(company_id, kind, value, confidence, pages): a row for each contact of a company.

    A contact that stands in two places of a page counts for both; ``pages`` adds up over places.
    """
    counted = page_contacts(pages).groupBy("company_id", "kind", "value", "place").agg(F.count("*").alias("n"))
    wrong = None
    for place, p in PROBABILITY.items():
        test = F.col("place") == place
        wrong = F.when(test, F.lit(1 - p)) if wrong is None else wrong.when(test, F.lit(1 - p))
    wrong = F.pow(wrong, F.least("n", F.lit(REPEATS)))
    merged = counted.groupBy("company_id", "kind", "value").agg(F.sort_array(F.collect_list(wrong)).alias("w"), F.sum("n").alias("pages"))
    right = 1 - F.aggregate("w", F.lit(1.0), lambda a, w: a * w)  # at most one factor a place
    return merged.select("company_id", "kind", "value", F.round(right, 6).alias("confidence"), "pages")


def best_contacts(contacts: DataFrame) -> DataFrame:
    """The surest contact of each kind for each company; equal ones by their text."""
    best = contacts.groupBy("company_id", "kind").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "value")).alias("b"))
    return best.select("company_id", "kind", "b.value", (-F.col("b.c")).alias("confidence"))
