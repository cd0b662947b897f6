"""URL filters: rules first, then logistic regression on hashed character n-grams.

Spark expressions and Spark's own learner only. Host and path n-grams are hashed into
one feature space and a model is fitted on a small labelled table of urls; where a
rule fits a url, the longest one decides, else the model.

A null url, or one without ``://``, has an empty host and path; it fits no rule and
the model judges it. Repeated rows are judged alike; without labelled rows, or with
rows of one verdict only, that verdict (``allow`` if there is none) holds for all.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the labelled table that are used at most, chosen by a hash of the url.
MAX_LABELLED = 20_000
FEATURES = 1 << 14
#: The model blocks a url from this probability on.
SURE = 0.7
ALLOW, BLOCK = "allow", "block"

#: The rules of the query: (verdict, host, start of the path).
RULES = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)

#: Words of the small labelled table: hosts built of the first are blocked, of the second allowed.
UNWANTED = (
    "ads adult bets bonus bride cams casino cheap click crack dating deals escort farm free fake gamble hack hookup jackpot "
    "keygen loans lottery malware nude payday phish pills poker popup porn prize promo replica rich scam sex slots spam "
    "spy torrent track traffic viagra warez win xxx"
).split()
WANTED = (
    "archive art bakery book bridge castle church city clinic coast college cooking county dance design family field forum "
    "garden green harbor health history home house journal kitchen lake language library light market math meadow museum "
    "music nature news north ocean paper park people physics river road school science season shore south stone street "
    "student studio summer theater town travel valley village water weather west winter wood"
).split()


def host(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    name = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lower = F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.locate("://", url) > 0, lower).otherwise("")


def path(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(name: Column, way: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null.

    A rule fits its host and all hosts below it, where the path starts with the rule's.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((name == domain) | name.endswith("." + domain)) & way.startswith(start)
        out = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(text: Column, mark: str, sizes=(3, 4, 5)) -> Column:
    """The n-grams of ``text`` between border marks, each with the mark of its part; all digits count as one."""
    x = F.concat(F.lit("^"), F.translate(text, "123456789", "000000000"), F.lit("$"))

    def of(n):
        places = F.sequence(F.lit(1), F.length(x) - n + 1)
        found = F.transform(places, lambda i: F.concat(F.lit(mark), F.substring(x, i, F.lit(n))))
        return F.when(F.length(x) >= n, found).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in sizes])


def _features(frame: DataFrame) -> DataFrame:
    grams = F.concat(_grams(F.col("host"), "h:"), _grams(F.col("path"), "p:"))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(frame.withColumn("grams", grams))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table (url, verdict): hosts of two words each, with the same paths on both sides."""
    rows = []
    for verdict, terms in ((BLOCK, UNWANTED), (ALLOW, WANTED)):
        for i, a in enumerate(terms):
            for j, shape in enumerate(("{a}-{b}", "{a}{b}", "{a}.{b}", "{a}")):
                b = terms[(i * 7 + j * 5 + 1) % len(terms)]
                sub = ("", "www.", "blog.", "m.")[(i + j) % 4]
                end = ("com", "net", "org")[(i + j) % 3]
                way = ("/en/", "/de/", "/fr/", "/es/")[(i + j) % 4] + str(1000 + 37 * i) + ("", ".html", "/")[(i + j) % 3]
                rows.append((f"http://{sub}{shape.format(a=a, b=b)}.example.{end}{way}", verdict))
    return spark.createDataFrame(rows, "url string, verdict string")


def learn(labelled: DataFrame):
    """A fitted model, or the one verdict there is."""
    rows = labelled.where(F.col("verdict").isin(ALLOW, BLOCK)).select("url", "verdict")
    rows = rows.orderBy(F.xxhash64("url"), "url", "verdict").limit(MAX_LABELLED)
    rows = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url")), "label": (F.col("verdict") == BLOCK).cast("double")})
    seen = [r.verdict for r in rows.select("verdict").distinct().collect()]
    if len(seen) < 2:
        return seen[0] if seen else ALLOW
    return LogisticRegression(maxIter=40, regParam=0.01, threshold=SURE).fit(_features(rows))


def judge(pages: DataFrame, model, rules=RULES, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``.

    Columns of those names are replaced; all others stay.
    """
    rows = pages.select(F.struct("*").alias("row"), F.col(url).alias("url"))
    rows = rows.withColumns({"host": F.coalesce(host(F.col("url")), F.lit("")), "path": F.coalesce(path(F.col("url")), F.lit(""))})
    rows = rows.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    if isinstance(model, str):
        rows = rows.withColumn("judged", F.lit(model))
    else:
        rows = model.transform(_features(rows)).withColumn("judged", F.when(F.col("prediction") == 1, BLOCK).otherwise(ALLOW))
    own = ("host", "path", "rule", "verdict")
    return rows.select(
        *[F.col("row")[c].alias(c) for c in pages.columns if c not in own],
        "host",
        "path",
        F.col("ruled.rule").alias("rule"),
        F.coalesce("ruled.verdict", "judged").alias("verdict"),
    )


def judged_pages(pages: DataFrame) -> DataFrame:
    """Verdict on the url of every page."""
    return judge(pages.select("page_id", "url"), learn(labelled_urls(pages.sparkSession))).drop("url")
