"""The model's tables derived from the generic test tables.

Raw test pages carry no marketing tags, images, canonical links or headers, so a
fixed decoration chosen by ids is spliced in. All of it is row-local: the company
and domain ids are digests of names, hence no shuffle happens before an operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.functions.seo import seo_grade
from sitescope.functions.urls import host_of, scheme_of
from sitescope.sources.capture import page_records

# Spliced before </head>, chosen by company.
HEAD_SNIPPETS = (
    '<meta name="generator" content="WordPress 6.4.2"><link rel="stylesheet" href="/wp-content/t/style.css">',
    '<script src="https://cdn.shopify.com/s/files/x.js"></script><script>Shopify.theme={}</script>',
    '<meta name="description" content="A trusted local business serving the whole community every day."><link rel="shortcut canonical" href="https://{host}/"><meta property="og:title" content="x &amp; y">',
    '<script src="https://www.googletagmanager.com/gtm.js?id=GTM-ABCDE"></script><script src="https://connect.facebook.net/en_US/fbevents.js"></script>',
    '<meta name="robots" content="NoIndex, follow"><script type="application/ld+json">{"@type":"Thing"}</script><meta name="twitter:card" content="summary">',
    '<meta name="generator" content="Drupal (https://www.drupal.org)"><script src="/sites/default/files/a.js"></script>',
    '<meta name=\'description\' content=\'Short text\'><link href="https://{host}/x?a=1&amp;b=2" rel=canonical><script src="https://static.hotjar.com/c/h.js"></script>',
    '<script src="https://www.googletagmanager.com/gtag/js?id=G-ABC123XYZ"></script><script>gtag("config","AW-1234567")</script><!-- <meta name="robots" content="noindex"> -->',
    '<script id="__NEXT_DATA__" src="/_next/static/a.js"></script><script src="https://widget.intercom.io/w/1"></script><script src="https://cdn.cookielaw.org/o.js"></script>',
    '<meta name="generator" content="Joomla! - Open Source"><link rel="stylesheet" href="/media/jui/css/a.css"><script>fbq(\'init\',\'1\');_linkedin_partner_id=1;</script>',
    '<meta name="csrf-token" content="t"><script src="/js/vue.min.js"></script><script src="https://js.hs-scripts.com/1.js"></script><script src="https://chimpstatic.com/m.js"></script>',
    "",
)
# Spliced after <body>, chosen by page.
BODY_SNIPPETS = (
    '<img src="a.png" alt="team"><img src="b.png"><img src="c.png" alt=" ">',
    '<a href="/about-us">About</a><a href="https://external.example/x">Ext</a><a href="https://{host}/contact#top">C</a><a href="/about-us#team">Again</a>',
    '<h2>s</h2><form><input type="email" name="email"></form><a href="https://wa.me/61400000000">W</a><a href="mailto:a@b.example">M</a>',
    '<app ng-version="17.{id}.1"></app><div data-v-0a1b2c3d>x</div><a href="https://calendly.com/x">Book</a>',
    '<h1 class="t">Second</h1><h2>a</h2><h2>b</h2><a href="//cdn.example/x">cdn</a><a href=" /careers ">Jobs</a><a href="">none</a>',
    '<div data-reactroot=""></div><script>var s="<a href=/no>";ga("create","UA-12345-6")</script><a HREF=\'/terms\'>T</a><a href="javascript:void(0)">J</a>',
    '<a href="?page=2">Next</a><a href="sub/page">Sub</a><a href="#x">X</a><img alt=\'ok\' src=d.png>',
    "",
)
# Path by page number modulo 11; None keeps the original URL.
PATHS = (
    "/",
    "/about-us",
    "/contact",
    "/blog/post-1",
    "/careers/engineer",
    "/privacy-policy",
    "/terms",
    "/photos",
    "/Who-We-Are/;v=1?x=1",
    None,
    None,
)
ROBOTS_TEXT = (
    "# generated\nUser-agent: *\nDisallow: /privacy-policy\nAllow: /terms\nDisallow: /te\nCrawl-delay: 2\n"
    "\nUser-agent: otherbot\nDisallow: /\n"
)
ROBOTS_TEXT_AGENT = (
    "User-agent: *\nDisallow: /\n\nUser-agent: sitescope\nUser-agent: friend\nDisallow:\nCrawl-delay: 0\n"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id_of(text: Column) -> Column:
    """A 60-bit id from a name."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _choose(number: Column, options: tuple) -> Column:
    chosen = None
    for i, option in enumerate(options):
        value = F.lit(option).cast("string")
        test = F.pmod(number, F.lit(len(options))) == i
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    return chosen


def spread(frame: DataFrame) -> DataFrame:
    """Cut a frame that sits in fewer partitions than there are cores.

    A large table already has more splits than cores and is left as it is.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores, "page_id") if frame.rdd.getNumPartitions() < cores else frame


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw captures: company_id, domain_id, host, page_id, url, status, headers, body."""
    return captures_from(spread(table(spark, sf_dir, "pages")))


def captures_from(pages: DataFrame) -> DataFrame:
    """Captures over a batch or a stream of raw pages (page_id, url, html)."""
    page_id = F.col("page_id")
    host = host_of(F.col("url"))
    base = (
        pages.select("page_id", "url", "html", host.alias("host"))
        .withColumn(
            "company_id", _id_of(F.regexp_extract("host", r"([^.]+)\.example\.", 1))
        )
        .withColumn("domain_id", _id_of(F.col("host")))
    )
    path = _choose(page_id, PATHS)
    url = F.coalesce(F.concat(scheme_of(F.col("url")), F.lit("://"), F.col("host"), path), F.col("url"))
    fill = lambda text: F.replace(
        F.replace(text, F.lit("{host}"), F.col("host")), F.lit("{id}"), page_id.cast("string")
    )
    head = fill(_choose(F.col("company_id"), HEAD_SNIPPETS))
    body = fill(_choose(page_id, BODY_SNIPPETS))
    html = F.replace(
        F.replace(F.col("html"), F.lit("</head>"), F.concat(head, F.lit("</head>"))),
        F.lit("<body>"),
        F.concat(F.lit("<body>"), body),
    )
    failed = F.pmod(page_id, F.lit(29)) == 7
    pdf = F.pmod(page_id, F.lit(31)) == 9
    status = F.when(failed, F.lit(None).cast("int")).when(
        F.pmod(page_id, F.lit(17)) == 3, 404
    ).otherwise(200)
    company = F.col("company_id")
    server = (
        F.when(F.pmod(company, F.lit(5)) == 0, F.struct(F.lit("CF-RAY"), F.concat(F.lit("ray-"), page_id.cast("string"))))
        .when(F.pmod(company, F.lit(5)) == 1, F.struct(F.lit("Server"), F.lit("Cloudflare")))
        .when(F.pmod(company, F.lit(5)) == 2, F.struct(F.lit("Set-Cookie"), F.lit("laravel_session=abc; path=/")))
        .otherwise(F.struct(F.lit("Server"), F.lit("nginx")))
    )
    content_type = F.when(pdf, "application/pdf").otherwise("text/html; charset=utf-8")
    return base.select(
        "company_id",
        "domain_id",
        "host",
        "page_id",
        url.alias("url"),
        status.alias("status"),
        F.when(failed, F.create_map().cast("map<string,string>"))
        .otherwise(
            F.map_from_arrays(
                F.array(F.lit("Content-Type"), server["col1"]), F.array(content_type, server["col2"])
            )
        )
        .alias("headers"),
        F.when(~failed, html).alias("body"),
    )


def crawled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page records; columns nobody selects (title, hash) are never computed."""
    return page_records(captures(spark, sf_dir))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per host: company_id, domain_id, host, is_primary = lowest domain id."""
    hosts = captures(spark, sf_dir).select("company_id", "domain_id", "host").distinct()
    first = hosts.groupBy("company_id").agg(F.min("domain_id").alias("first_domain"))
    return hosts.join(first, "company_id").select(
        "company_id", "domain_id", "host", (F.col("domain_id") == F.col("first_domain")).alias("is_primary")
    )


def site_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per company that owns a host; a quarter has no industry."""
    hosts = captures(spark, sf_dir).select("company_id", "host").distinct()
    name = F.regexp_extract("host", r"([^.]+)\.example\.", 1)
    company = F.col("company_id")
    return hosts.groupBy("company_id").agg(F.min(name).alias("name")).select(
        company,
        F.concat(F.lit("Site "), "name").alias("display_name"),
        F.when(company % 4 != 0, F.concat(F.lit("Industry "), (company % 4).cast("string"))).alias(
            "industry"
        ),
        F.when(company % 2 == 0, "1-10").otherwise("11-50").alias("size_bucket"),
    )


def site_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir).withColumnRenamed("host", "hostname")


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, txt for two thirds of the hosts."""
    hosts = captures(spark, sf_dir).select("domain_id", "host").distinct()
    third = F.pmod("domain_id", F.lit(3))
    return hosts.filter(third < 2).select(
        "host", F.when(third == 0, ROBOTS_TEXT).otherwise(ROBOTS_TEXT_AGENT).alias("txt")
    )


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search documents over customers.

    The technologies of a customer are the distinct brands of its order lines
    (there are few brands, so the list is short for any customer).
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    brands = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select("l_orderkey", "p_brand")
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(F.sort_array(F.collect_set("p_brand")).alias("technologies"))
    )
    flags = orders.groupBy("o_custkey").agg(
        F.max(F.col("o_orderpriority") == "1-URGENT").alias("has_contact_page"),
        F.max(F.col("o_orderpriority") == "2-HIGH").alias("has_careers_page"),
        F.max(F.col("o_orderpriority") == "3-MEDIUM").alias("has_blog"),
        F.max(F.col("o_orderstatus") == "F").alias("has_privacy"),
        F.max(F.col("o_orderstatus") == "P").alias("has_terms"),
        F.max("o_orderdate").alias("indexed_at"),
    )
    nation = F.broadcast(table(spark, sf_dir, "nation"))  # 25 rows at every scale
    region = F.broadcast(table(spark, sf_dir, "region"))  # 5 rows at every scale
    key = F.col("c_custkey")
    score = F.when(key % 10 != 0, ((key * 37) % 101).cast("double"))
    joined = (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(brands.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
        .join(flags.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    )
    technologies = F.coalesce("technologies", F.array().cast("array<string>"))
    return joined.select(
        key.alias("company_id"),
        F.col("c_name").alias("display_name"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit(".example.com")).alias(
            "primary_domain"
        ),
        F.col("c_mktsegment").alias("industry"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("state"),
        F.concat(F.lit("City "), (key % 7).cast("string")).alias("city"),
        F.when(F.col("c_acctbal") < 0, "1-10")
        .when(F.col("c_acctbal") < 3000, "11-50")
        .when(F.col("c_acctbal") < 6000, "51-200")
        .otherwise("201+")
        .alias("size_bucket"),
        score.alias("seo_score"),
        seo_grade(score).alias("seo_grade"),
        technologies.alias("technologies"),
        (key % 2 == 0).alias("has_ssl"),
        *[
            F.coalesce(flag, F.lit(False)).alias(flag)
            for flag in (
                "has_contact_page",
                "has_careers_page",
                "has_blog",
                "has_privacy",
                "has_terms",
            )
        ],
        F.lower(
            F.concat_ws(" ", "c_name", F.nullif("c_mktsegment", F.lit("")), technologies)
        ).alias("text_blob"),
        F.coalesce("indexed_at", F.to_timestamp_ntz(F.lit("1990-01-01 00:00:00"))).alias(
            "indexed_at"
        ),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies over customers; about a tenth has no legal name."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("company_id"),
        F.col("c_name").alias("display_name"),
        F.when(key % 9 != 0, F.concat(F.col("c_name"), F.lit(" Ltd"))).alias("legal_name"),
        F.when(key % 13 == 0, "enriched").otherwise("discovered").alias("status"),
        F.col("c_mktsegment").alias("industry"),
        F.when(F.col("c_acctbal") < 0, "1-10").otherwise("11-50").alias("size_bucket"),
        F.timestamp_add("DAY", (key * 7 % 1000).cast("int"), F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00"))).alias(
            "created_at"
        ),
    )


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two domains per customer, none for every eleventh."""
    key = F.col("c_custkey")
    name = F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))
    numbers = F.when(key % 11 == 0, F.array().cast("array<int>")).when(
        key % 3 == 0, F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0)))
    return (
        table(spark, sf_dir, "customer")
        .select(key, name.alias("name"), F.explode(numbers).alias("i"))
        .select(
            (key * 2 + F.col("i")).alias("domain_id"),
            key.alias("company_id"),
            F.concat(F.when(F.col("i") == 1, "shop.").otherwise(""), "name", F.lit(".example.com")).alias(
                "hostname"
            ),
            (F.col("i") == 0).alias("is_primary"),
            F.when(key % 5 == 0, "crawled").otherwise("pending").alias("crawl_status"),
        )
    )


def crawl_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl jobs over orders, on the first domain of the ordering customer."""
    status = (
        F.when(F.col("o_orderpriority") == "5-LOW", "failed")
        .when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "pending")
        .otherwise("running")
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        (F.col("o_custkey") * 2).alias("domain_id"),
        status.alias("status"),
        F.when(status == "pending", 0).otherwise(1).alias("attempts"),
        F.when(status == "failed", F.lit("TimeoutError: read")).alias("error"),
        F.col("o_orderdate").alias("created_at"),
    )


def job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per job over order lines."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.col("l_linenumber").alias("page_no"),
        F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example.com/p"), F.col("l_partkey").cast("string")).alias("url"),
        F.when(F.col("l_linenumber") == 1, "home").otherwise("other").alias("page_type"),
        F.when(F.col("l_returnflag") == "R", 404).otherwise(200).alias("http_status"),
        F.col("l_shipdate").alias("fetched_at"),
    )


def company_technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections over order lines: the brand of a part, seen with a confidence."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    # One row an order is kept in memory by a task; the lines, which are many, are streamed past it and not sorted.
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").hint("shuffle_hash")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_discount")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("company_id"), F.col("p_brand").alias("technology"))
        .agg(F.max(F.round(1 - F.col("l_discount"), 2)).alias("confidence"))
    )


def technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog over the brands of parts; the category is the smallest part type."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("technology")).agg(
        F.min("p_type").alias("category")
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle events: a job is a user's day; some completions report -1 pages."""
    return job_events_from(table(spark, sf_dir, "events"))


def job_events_from(events: DataFrame) -> DataFrame:
    step = (
        F.when(F.col("event_type") == "view", "start")
        .when(F.col("event_type") == "purchase", "complete")
        .when(F.col("event_type") == "error", "fail")
        .otherwise("enqueue")
    )
    return events.select(
        "user_id",
        F.to_date("ts").alias("day"),
        "ts",
        "event_id",
        step.alias("step"),
        (F.col("event_id") % 9 - 1).cast("int").alias("pages"),
    )


def named_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers (even ids) and suppliers (odd ids); a third of those is written like a customer's, with an error."""
    name = F.when(F.col("s_suppkey") % 3 == 0, F.replace("s_name", F.lit("Supplier"), F.lit("Custmer"))).otherwise(F.col("s_name"))
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("company_id"), F.col("c_name").alias("display_name"))
    return customers.unionByName(
        table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("company_id"), name.alias("display_name"))
    )


def industry_leaf() -> Column:
    """The finest industry of a customer: its segment, nation and kind of balance."""
    kind = F.when(F.col("c_acctbal") < 0, "small").otherwise("large")
    return F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string"), kind)


def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """industry_id, parent_id: segments under one root, nations under segments, kinds under nations."""
    leaf = table(spark, sf_dir, "customer").select(industry_leaf().alias("leaf")).distinct()
    part = lambda n: F.substring_index("leaf", "/", n)
    nodes = F.array(*[F.struct(part(n).alias("industry_id"), (part(n - 1) if n > 1 else F.lit("ALL")).alias("parent_id")) for n in (1, 2, 3)])
    root = spark.range(1).select(F.lit("ALL").alias("industry_id"), F.lit(None).cast("string").alias("parent_id"))
    return leaf.select(F.inline(nodes)).distinct().unionByName(root)


def company_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company_id, industry_id: two in seven stand under a nation or a segment only, one in eleven under none."""
    key, leaf = F.col("c_custkey"), industry_leaf()
    placed = F.when(key % 7 == 0, F.substring_index(leaf, "/", 2)).when(key % 7 == 1, F.col("c_mktsegment")).otherwise(leaf)
    return table(spark, sf_dir, "customer").select(key.alias("company_id"), F.when(key % 11 != 5, placed).alias("industry_id"))


STREETS = ("Harbour View", "King", "Old Mill", "Station", "Victoria Park", "Church Hill", "Long Meadow", "Bridge Gate", "Castle", "Green Valley", "Orchard")
KINDS = (("Street", "St.", "str"), ("Road", "Rd", "RD."), ("Avenue", "Ave.", "av"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of customers and suppliers as people write them: short forms, punctuation, errors, missing postcodes."""

    def written(key: Column, nation: Column) -> list[Column]:
        number, street, kind = key % 7 + 1, key % len(STREETS), key % len(KINDS)
        spelled = F.when(key % 5 == 1, 1).when(key % 5 == 3, 2).otherwise(0)
        names = F.element_at(F.array(*[F.lit(x) for x in STREETS]), (street + 1).cast("int"))
        kinds = F.array(*[F.array(*[F.lit(x) for x in k]) for k in KINDS])
        kinds = F.element_at(F.element_at(kinds, (kind + 1).cast("int")), (spelled + 1).cast("int"))
        wrong = F.when(key % 13 == 4, F.concat(F.substring(names, 1, 2), F.substring(names, 4, 40))).otherwise(names)
        line = F.concat(number.cast("string"), F.when(key % 4 == 2, ", ").otherwise(" "), wrong, F.lit(" "), kinds)
        city = F.concat(F.lit("City "), (nation % 6).cast("string"))
        return [
            F.when(key % 6 == 5, F.upper(line)).otherwise(line).alias("street"),
            F.when(key % 9 == 0, F.concat(F.lit(" "), city, F.lit("."))).otherwise(city).alias("city"),
            F.lit(None).cast("string").alias("state"),
            F.when(key % 8 != 3, (10000 + nation * 10 + street % 2).cast("string")).alias("postcode"),
            F.concat(F.lit("Nation "), (nation % 5).cast("string")).alias("country"),
        ]

    customers = table(spark, sf_dir, "customer")
    suppliers = table(spark, sf_dir, "supplier")
    return customers.select((F.col("c_custkey") * 2).alias("company_id"), *written(F.col("c_custkey"), F.col("c_nationkey"))).unionByName(
        suppliers.select((F.col("s_suppkey") * 2 + 1).alias("company_id"), *written(F.col("s_suppkey") * 3 + 1, F.col("s_nationkey")))
    )


# Spliced before </body>, chosen by page: what visitors are told about the business.
BUSINESS_SNIPPETS = (
    '<p>Copyright 1998 - 2024. Established in 1987 by two brothers.</p><a href="tel:+61 2 5550 {id}">Call</a>',
    '<p>We are hiring! See our open positions.</p><a href="mailto:Jobs@{host}?subject=x%20y">Jobs</a> or write to info@{host}, logo@2x.png',
    '<footer>&copy; 2019 All rights reserved</footer><a href="https://www.facebook.com/{host}/">f</a><a href="https://x.com/share?u=1">s</a>',
    '<p>Phone (020) 555-1234 or +44 20 7946 0{id}. Ring 020-555-1234!</p><a href="https://au.linkedin.com/company/c{id}?x=1">in</a>',
    '<p>Since 2021 on this site. Join our team: apply now.</p><p>INFO@{host}</p><a href="mailto:noreply@{host}">no</a>',
    "",
)


def business_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company_id, url, page_type, html of all pages, with a snippet about the business."""
    pages = crawled_pages(spark, sf_dir)
    said = F.replace(
        F.replace(_choose(F.col("page_id"), BUSINESS_SNIPPETS), F.lit("{host}"), F.col("host")), F.lit("{id}"), F.lpad((F.col("page_id") % 1000).cast("string"), 4, "0")
    )
    return pages.select("company_id", "url", "page_type", F.replace("html", F.lit("</body>"), F.concat(said, F.lit("</body>"))).alias("html"))
