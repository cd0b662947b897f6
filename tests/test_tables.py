import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sitescope.operators import maintenance as M
from sitescope.operators import projection, quality
from sitescope.operators.stats import queue_depth
from sitescope.plans.search import Filter, SearchSpec, search, suggest
from sitescope.sources.capture import page_records
from sitescope.sources.files import read_headers, write_headers, write_pages, write_projection


def test_upsert_keeps_one_row_and_is_repeatable(spark):
    shape = "company_id long, score double, scanned_at long"
    old = spark.createDataFrame([(1, 5.0, 100), (2, 6.0, 100)], shape)
    new = spark.createDataFrame([(1, 7.0, 50), (1, 8.0, 60), (3, 9.0, 1)], shape)
    once = M.upsert_latest(old, new, ["company_id"], "scanned_at")
    assert [(r["company_id"], r["score"]) for r in rows(once)] == [(1, 8.0), (2, 6.0), (3, 9.0)]
    assert rows(M.upsert_latest(once, new, ["company_id"], "scanned_at")) == rows(once)


def test_rows_that_differ_in_a_map_are_picked_by_its_entries(spark):
    shape = "company_id long, facts map<string,int>, scanned_at long"
    new = [(1, {"b": 1, "a": 2}, 5), (1, {"a": 3}, 5), (1, None, 5), (1, {"a": 2, "b": 9}, 5)]
    old = spark.createDataFrame([], shape)
    for order in (new, new[::-1], new[2:] + new[:2]):
        got = M.upsert_latest(old, spark.createDataFrame(order, shape).repartition(3), ["company_id"], "scanned_at")
        assert [r["facts"] for r in rows(got)] == [{"a": 3}]


def test_waiting_jobs(spark):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    events = [(1, at(0), "enqueue"), (1, at(5), "start"), (1, at(6), "complete"), (2, at(1), "enqueue"), (3, at(5), "start"), (4, at(9), "enqueue"), (4, at(11), "start"), (4, at(12), "start")]
    frame = spark.createDataFrame(events, "job_id long, ts timestamp_ntz, step string")
    found = queue_depth(frame, ["job_id"], "4 hours").orderBy("window_start").collect()
    assert [(r.window_start.hour, r.came, r.started, r.waiting) for r in found] == [(0, 2, 0, 2), (4, 1, 2, 1), (8, 1, 1, 1)]
    assert queue_depth(frame.limit(0), ["job_id"]).collect() == []


def test_replace_is_repeatable_and_can_empty_a_key(spark):
    shape = "company_id long, tool string"
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], shape)
    keys = spark.createDataFrame([(1,), (2,), (1,)], "company_id long")
    new = spark.createDataFrame([(1, "z")], shape)
    once = M.replace_for_keys(old, new, keys, "company_id")
    assert [tuple(r.values()) for r in rows(once)] == [(1, "z"), (3, "d")]
    assert rows(M.replace_for_keys(once, new, keys, "company_id")) == rows(once)


def test_update_missing_append_and_cascade(spark):
    domains = spark.createDataFrame([(1, 10, "pending"), (2, 10, "pending"), (3, 20, "failed")], "domain_id long, company_id long, crawl_status string")
    changes = spark.createDataFrame([(1, "crawled"), (3, None), (9, "crawled")], "domain_id long, crawl_status string")
    got = {r.domain_id: r.crawl_status for r in M.update_in_place(domains, changes, "domain_id", ["crawl_status"]).collect()}
    assert got == {1: "crawled", 2: "pending", 3: "failed"}
    assert [r.domain_id for r in M.missing_keys(changes, domains, "domain_id").collect()] == [9]
    companies = spark.createDataFrame([(10,), (20,)], "company_id long")
    left, kept = M.delete_with_children(companies, domains, spark.createDataFrame([(10,)], "company_id long"), "company_id")
    assert (left.count(), [r.domain_id for r in kept.collect()]) == (1, [3])
    added = M.append_rows(companies, spark.createDataFrame([("x",), ("y",)], "name string"), "company_id", ["name"])
    assert added.distinct().count() == 4


def test_keyed_table_at_rest(spark, tmp_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("company_id", LongType()), StructField("tool", StringType())])
    table = M.KeyedTable(spark, str(tmp_path / "t"), "company_id", schema, buckets=4).create()
    assert table.read().count() == 0
    first = spark.createDataFrame([(i, f"t{i}") for i in range(40)], schema)
    for _ in range(2):  # the second run changes nothing
        table.replace(first.select("company_id"), first)
        assert table.read().count() == 40
    keys = spark.createDataFrame([(1,), (2,)], "company_id long")
    for _ in range(2):
        table.replace(keys, spark.createDataFrame([(1, "new"), (1, "newer")], schema))
        got = rows(table.read())
        assert len(got) == 40
        assert [r["tool"] for r in got if r["company_id"] in (1, 2)] == ["new", "newer"]
    table.upsert(spark.createDataFrame([(1, "one"), (77, "more")], schema), "tool")
    assert [r["tool"] for r in rows(table.read()) if r["company_id"] in (1, 77)] == ["one", "more"]
    # Replaced by nothing: also where a key was the only one of its bucket.
    table.replace(first.select("company_id"), first.limit(0))
    assert [r["company_id"] for r in rows(table.read())] == [77]
    table.replace(spark.createDataFrame([(77,)], "company_id long"), first.limit(0))
    assert table.read().count() == 0


def test_integrity_report(spark):
    companies = spark.createDataFrame([(1, "A", "enriched"), (2, " ", "discovered"), (3, "C", "enriched")], "company_id long, display_name string, status string")
    domains = spark.createDataFrame(
        [(10, 1, "a.example", True), (11, 1, "WWW.a.example", True), (12, 2, "nodot", False), (13, 9, "z.example", False), (14, 2, "z.example", False)],
        "domain_id long, company_id long, hostname string, is_primary boolean",
    )
    detections = spark.createDataFrame([(1, "X", 0.5), (1, "X", 1.5), (2, "Gone", None)], "company_id long, technology string, confidence double")
    catalog = spark.createDataFrame([("X",), ("X",)], "technology string")
    profiles = spark.createDataFrame([(1, 101.0), (2, 50.0), (2, 60.0)], "company_id long, score double")
    got = {(r.rule, r.key): r.rows for r in quality.integrity_report(companies, domains, detections, catalog, profiles).collect()}
    assert got == {
        ("blank_display_name", "2"): 1,
        ("invalid_hostname", "12"): 1,
        ("hostname_twice_in_company", "1|a.example"): 2,
        ("several_primaries", "1"): 2,
        ("hostname_not_unique", "a.example"): 2,
        ("hostname_not_unique", "z.example"): 2,
        ("confidence_out_of_range", "1"): 1,
        ("confidence_out_of_range", "2"): 1,
        ("score_out_of_range", "1"): 1,
        ("technology_twice_in_company", "1|X"): 2,
        ("technology_name_not_unique", "X"): 2,
        ("several_seo_profiles", "2"): 2,
        ("domain_without_company", "9"): 1,
        ("detection_without_technology", "Gone"): 1,
        ("enriched_without_domain", "3"): 1,
    }


def test_captures_become_records(spark):
    long_body = "<title> T </title>" + "x" * 2_000_100
    captures = spark.createDataFrame(
        [
            (1, "https://a.example/", 200, {}, long_body),
            (2, "https://a.example/contact", 404, {"content-type": "text/html"}, "<title>gone</title>"),
            (3, "https://a.example/f", 200, {"Content-Type": "application/pdf"}, "%PDF"),
            (4, "https://a.example/x", None, {}, None),
            (5, "https://a.example/y", 200, {"Content-Type": "text/html"}, "<title> </title>"),
            (6, "https://a.example/z", 503, None, "oops"),
        ],
        "page_id long, url string, status int, headers map<string,string>, body string",
    )
    twice = F.expr("map('Content-Type', 'text/html; charset=utf-8', 'X-A', '1', 'x-a', '2')")
    captures = captures.withColumn("headers", F.when(F.col("page_id") == 1, twice).otherwise(F.col("headers")))
    got = {r.page_id: r for r in page_records(captures).collect()}
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert (got[1].title, len(got[1].html), got[1].content_type, got[1].headers["x-a"]) == ("T", len(long_body), "text/html", "2")
    assert (got[2].title, got[2].html, got[2].page_type, got[2].http_status) == (None, "<title>gone</title>", "contact", 404)
    assert (got[3].html, got[3].content_hash, got[3].content_type) == (None, empty, "application/pdf")
    assert (got[4].http_status, got[4].content_type, got[4].html) == (0, None, None)
    assert (got[5].title, got[6].html) == ("", None)


def test_first_domain_becomes_primary(spark):
    data = [(1, 5, False), (1, 3, False), (2, 9, False), (2, 11, True), (3, 1, True)]
    frame = spark.createDataFrame([(c, d, p, f"h{d}") for c, d, p in data], "company_id long, domain_id long, is_primary boolean, hostname string")
    restored = projection.with_primary(frame)
    assert restored.count() == 5
    got = {r.company_id: r.primary_domain for r in projection.primary_domains(restored).collect()}
    assert got == {1: "h3", 2: "h11", 3: "h1"}


def small_site(spark):
    """Three companies: one with two tools, one with one, one with nothing but a name."""
    pages = [
        (1, 10, 100, "https://kiln.example/", "home", 200, "<title>Kiln</title>"),
        (1, 10, 101, "https://kiln.example/contact", "contact", 200, "<p>x</p>"),
        (2, 20, 200, "https://loom.example/", "home", 200, "<title>Loom</title>"),
        (2, 20, 201, "https://loom.example/news", "blog", 200, None),
    ]
    names = "company_id long, domain_id long, page_id long, url string, page_type string, http_status int, html string"
    return {
        "companies": spark.createDataFrame(
            [(1, "Kiln Pottery", "Crafts", "1-10"), (2, "Loom Weavers", "Crafts", "11-50"), (3, "Mill", None, None)],
            "company_id long, display_name string, industry string, size_bucket string",
        ),
        "domains": spark.createDataFrame(
            [(10, 1, "kiln.example", True), (20, 2, "loom.example", True)],
            "domain_id long, company_id long, hostname string, is_primary boolean",
        ),
        "pages": spark.createDataFrame(pages, names),
        "technologies": spark.createDataFrame(
            [(1, 1, "Shopify"), (1, 0, "WordPress"), (2, 0, "WordPress")], "company_id long, ord int, technology string"
        ),
        "seo_profiles": spark.createDataFrame([(1, True, 95.0), (2, False, 41.5)], "company_id long, has_ssl boolean, score double"),
    }


def test_flow_from_tables_to_search(spark, tmp_path):
    t = small_site(spark)
    built = projection.search_projection(t["companies"], t["domains"], t["pages"], t["technologies"], t["seo_profiles"], "2024-01-01 00:00:00")
    write_projection(built, str(tmp_path / "docs"))
    documents = spark.read.parquet(str(tmp_path / "docs"))
    assert rows(documents) == rows(built) and documents.count() == 3
    kiln = documents.filter("company_id = 1").first()
    assert kiln.technologies == ["WordPress", "Shopify"]
    assert kiln.text_blob == "kiln pottery crafts wordpress shopify"
    assert (kiln.seo_grade, kiln.has_ssl, kiln.has_contact_page, kiln.has_blog) == ("A", True, True, False)
    spec = SearchSpec(filters=(Filter("technology", "contains", ("wordpress",)),), facets=("industry", "technology"))
    result = search(documents, spec)
    assert [r.display_name for r in result.items.collect()] == ["Kiln Pottery", "Loom Weavers"]
    assert {(r.value, r["count"]) for r in result.facets.collect()} == {("Crafts", 2), ("WordPress", 2), ("Shopify", 1)}
    assert [r.display_name for r in suggest(documents, " lo").collect()] == ["Loom Weavers"]


def test_update_in_place_keeps_or_clears(spark):
    old = spark.createDataFrame([(1, "failed", "late"), (2, "failed", "late")], "job_id long, status string, error string")
    new = spark.createDataFrame([(1, "completed", None)], "job_id long, status string, error string")
    got = lambda **how: [tuple(r.values()) for r in rows(M.update_in_place(old, new, "job_id", ["status", "error"], **how))]
    assert got() == [(1, "completed", "late"), (2, "failed", "late")]
    assert got(null_clears=True) == [(1, "completed", None), (2, "failed", "late")]


def test_company_without_anything_still_gets_a_document(spark):
    t = {k: v.limit(0) for k, v in small_site(spark).items()}
    lone = spark.createDataFrame([(9, "Lone", None, None)], "company_id long, display_name string, industry string, size_bucket string")
    doc = projection.search_projection(lone, t["domains"], t["pages"], t["technologies"], t["seo_profiles"]).first()
    assert (doc.technologies, doc.has_ssl, doc.seo_grade, doc.text_blob, doc.primary_domain) == ([], False, None, "lone", None)


def test_page_and_header_files(spark, tmp_path):
    pages = small_site(spark)["pages"].withColumn("fetched_at", F.lit("2024-02-03 10:00:00").cast("timestamp"))
    write_pages(pages, str(tmp_path / "pages"))
    back = spark.read.parquet(str(tmp_path / "pages")).filter("fetched_on = date'2024-02-03'")
    assert back.count() == pages.count()
    one = spark.createDataFrame([({"a": "1"},)], "headers map<string,string>")
    assert rows(read_headers(write_headers(one))) == rows(one)
    with pytest.raises(ValueError):
        from sitescope.operators.skew import page_of

        page_of(pages, [F.asc("page_id")], 0, 10)
