import datetime
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sitescope.operators import entities, jobs, relations
from sitescope.operators.skew import attach


def clean(host):
    host = host.strip().lower()
    if not host or "." not in host or "/" in host or " " in host:
        return None
    return host.removeprefix("www.")


def register_by_hand(candidates, owned):
    owned, accepted, reasons = set(owned), {}, {}
    for request, name, domains in sorted(candidates):
        reason, hosts, primary = None, [], False
        if not name.strip():
            reason = "blank display name"
        for raw, flag in domains:
            if reason:
                break
            host = clean(raw)
            if host is None:
                reason = "invalid hostname"
            elif host in hosts:
                reason = "duplicate hostname"
            elif flag and primary:
                reason = "second primary domain"
            hosts.append(host)
            primary = True
        if not reason and owned & set(hosts):
            reason = "domain already owned"
        if reason:
            reasons[request] = reason
        else:
            accepted[request] = hosts
            owned |= set(hosts)
    return accepted, reasons


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_registration_agrees_with_one_by_one(spark, seed):
    rng = random.Random(seed)
    pool = [f"h{i}.example" for i in range(14)] + ["WWW.h1.example", " H2.example ", "bad", "x y.example"]
    candidates = [
        (i, rng.choice(["A", "A", "A", " ", "B "]), [(rng.choice(pool), rng.random() < 0.2) for _ in range(rng.randint(0, 3))])
        for i in range(60)
    ] + [(100 + i, "Chain", [(f"c{i}.example", False), (f"c{i + 1}.example", False)]) for i in range(9)]
    frame = spark.createDataFrame(candidates, "request_id long, display_name string, domains array<struct<hostname:string,is_primary:boolean>>")
    owned = ["h3.example", "h9.example"]
    made = entities.register_companies(frame, spark.createDataFrame([(h,) for h in owned], "hostname string"))
    accepted, reasons = register_by_hand(candidates, owned)
    assert {r.company_id for r in made.companies.collect()} == set(accepted)
    assert {r.request_id: r.reason for r in made.rejects.collect()} == reasons
    got = {}
    for r in made.domains.orderBy("company_id", "pos").collect():
        assert r.is_primary == (r.pos == 0)
        got.setdefault(r.company_id, []).append(r.hostname)
    assert got == {k: v for k, v in accepted.items() if v}


def test_crawl_requests(spark):
    asked = [(1, "WWW.Acme.Example"), (2, "acme.example"), (3, "unknown.example"), (4, "bad"), (5, None)]
    requests = spark.createDataFrame(asked, "request_id long, hostname string")
    domains = spark.createDataFrame([("acme.example", 7)], "hostname string, domain_id long")
    made, rejects = entities.request_crawls(requests, domains)
    assert [(r.job_id, r.domain_id, r.status) for r in made.orderBy("job_id").collect()] == [(1, 7, "pending"), (2, 7, "pending")]
    assert {r.request_id: r.reason for r in rejects.collect()} == {
        3: "no company owns this domain",
        4: "invalid hostname",
        5: "invalid hostname",
    }


def test_attach_with_hot_and_missing_keys(spark):
    data = [(i, "hot" if i % 3 else None) for i in range(3000)] + [(5000 + i, f"k{i}") for i in range(50)]
    left = spark.createDataFrame(data, "id long, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("unused", 3)], "k string, v int")
    for how in ("left", "inner"):
        plain = left.join(right, "k", how).select("id", "k", "v")
        counts = left.groupBy("k").agg(F.count("*").alias("_n"))
        assert rows(attach(left, right, ["k"], ["id"], counts, how, hot_rows=100).select("id", "k", "v")) == rows(plain)


STEPS = ["start", "complete", "fail", "enqueue"]


def walk(events, states=None):
    states = dict(states or {})
    for job, ts, event_id, step, pages in sorted(events, key=lambda e: (e[1], e[2])):
        s = dict(states.get(job) or {"state": "pending", "attempts": 0, "pages_crawled": 0, "started_at": None, "finished_at": None, "illegal": 0, "events": 0})
        s["events"] += 1
        if s["state"] == "pending" and step == "start":
            s.update(state="running", attempts=s["attempts"] + 1, started_at=ts)
        elif s["state"] == "running" and step == "fail":
            s.update(state="failed", finished_at=ts)
        elif s["state"] == "running" and step == "complete" and pages >= 0:
            s.update(state="completed", finished_at=ts, pages_crawled=pages)
        elif not (s["state"] == "pending" and step == "enqueue"):
            s["illegal"] += 1
        states[job] = s
    return states


EVENTS = "job_id long, ts timestamp_ntz, event_id long, step string, pages int"


def random_events(seed, n=400, days=3):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    return [
        (rng.choice([1, 1, 1, *range(2, 60)]), start + datetime.timedelta(minutes=rng.randrange(days * 1440)), i, rng.choice(STEPS), rng.randint(-1, 8))
        for i in range(n)
    ]


@pytest.mark.parametrize("hot_rows", [1_000_000, 10])
def test_job_fold_agrees_with_a_walk(spark, hot_rows):
    events = random_events(4)
    got = jobs.fold_events(spark.createDataFrame(events, EVENTS), ["job_id"], hot_rows=hot_rows)
    assert {r.pop("job_id"): r for r in rows(got)} == walk(events)


def test_job_fold_continues_from_earlier_states(spark):
    events = sorted(random_events(6), key=lambda e: (e[1], e[2]))
    states, expected = None, {}
    for part in (events[:150], events[150:160], events[160:]):
        changed = jobs.fold_events(spark.createDataFrame(part, EVENTS), ["job_id"], states)
        expected = walk(part, expected)
        done = {r.pop("job_id"): r for r in rows(changed)}
        assert done == {job: expected[job] for job in {e[0] for e in part}}
        data = [(job, *[expected[job][c] for c in jobs.STATE_COLUMNS]) for job in expected]
        states = spark.createDataFrame(data, "job_id long, state string, attempts int, pages_crawled int, started_at timestamp_ntz, finished_at timestamp_ntz, illegal long, events long")


def test_listings(spark):
    day = datetime.datetime(2024, 1, 1)
    data = [(i, i % 4, "pending" if i % 2 else "failed", day + datetime.timedelta(days=i // 3)) for i in range(30)]
    frame = spark.createDataFrame(data, "job_id long, domain_id long, status string, created_at timestamp_ntz")
    newest = sorted(data, key=lambda d: (d[3], d[0]), reverse=True)
    assert [r.job_id for r in relations.list_jobs(frame, None, 2, 7).collect()] == [d[0] for d in newest[7:14]]
    pending = [d[0] for d in newest if d[2] == "pending"]
    envelope = relations.listing(frame, [F.asc("job_id")], 3, 7)
    assert ([r.job_id for r in envelope.items.collect()], envelope.total.first().total) == (list(range(14, 21)), 30)
    with pytest.raises(ValueError):
        relations.list_jobs(frame, None, 1, 201)
    assert [r.job_id for r in relations.pending_jobs(frame, 5).collect()] == pending[:5]
    pages = spark.createDataFrame([(1, 1, "u"), (1, 2, "v"), (3, 1, "w"), (99, 1, "orphan")], "job_id long, page_no int, url string")
    detail = relations.job_detail(frame, pages)
    assert detail.count() == 31
    assert sorted(r.url for r in relations.job_detail(frame, pages, 1).collect()) == ["u", "v"]
    assert [r.url for r in relations.job_detail(frame, pages, 2).collect()] == [None]
    assert [r.url for r in relations.facts_in_order(pages, "job_id", "page_no", 1).collect()] == ["u", "v"]
    assert [r.url for r in relations.facts_in_order(pages, "job_id", "page_no").collect()] == ["u", "v", "w", "orphan"]
    counts = {r.job_id: r.pages_crawled for r in relations.pages_per_job(frame, pages).collect()}
    assert (counts[1], counts[2], counts[3]) == (2, 0, 1)


def test_lookup_by_hostname(spark):
    companies = spark.createDataFrame([(1, "A"), (2, "B")], "company_id long, display_name string")
    domains = spark.createDataFrame([(10, 1, "a.example"), (11, 1, "b.example"), (12, 2, "c.example")], "domain_id long, company_id long, hostname string")
    found = entities.companies_by_hostname(companies, domains, "B.Example").collect()
    assert [(r.company_id, r.hostname) for r in found] == [(1, "b.example")]
    assert entities.companies_by_hostname(companies, domains).count() == 3
