import datetime

from conftest import rows
from sitescope.checks.queries import AS_OF
from sitescope.operators.detect import detect_marketing, detect_technologies
from sitescope.operators.jobs import fold_events
from sitescope.operators.maintenance import stamped
from sitescope.operators.projection import search_projection
from sitescope.operators.seo_scan import seo_scan
from sitescope.sources import bindings as B
from sitescope.sources.capture import page_records
from sitescope.streaming.enrichment import EnrichmentStore, start_enrichment
from sitescope.streaming.job_state import JobStateStore, job_states, start_job_state
from test_entities_and_jobs import EVENTS, random_events, walk


def batches(spark, path):
    """A stream that reads one file per micro-batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_job_states_over_many_batches_with_repeats_and_replay(spark, tmp_path):
    events = random_events(8, n=300)  # in no order of time, so some come days late
    source = str(tmp_path / "events")
    store = JobStateStore(spark, str(tmp_path / "state"), ("job_id",), "job_id long", buckets=4)
    seen = []
    for i in range(0, 300, 100):
        part = events[i : i + 100]
        again = seen[-10:]  # delivered a second time
        spark.createDataFrame(part + again, EVENTS).coalesce(1).write.mode("append").parquet(source)
        query = start_job_state(batches(spark, source), store, str(tmp_path / "checkpoint"))
        got = job_states(store, query)
        seen += part
        assert {r.pop("job_id"): r for r in rows(got)} == walk(seen)
    again = start_job_state(batches(spark, source), store, str(tmp_path / "lost"))
    assert {r.pop("job_id"): r for r in rows(job_states(store, again))} == walk(seen)


def test_shared_null_and_repeated_ids_in_any_split(spark, tmp_path):
    """Two jobs with the same ids, events without one, a start delivered three times: as the batch fold."""
    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)
    events = [
        (1, at(1), 1, "start", 0), (2, at(2), 1, "start", 0), (1, at(1), 1, "start", 0), (2, at(9), 2, "complete", 4), (1, at(9), 2, "fail", 0),
        (3, at(1), None, "enqueue", 0), (3, at(2), None, "start", 0), (3, at(3), None, "start", 0), (4, at(5), None, "start", 0), (4, at(6), None, "complete", 1),
        (1, at(1), 1, "start", 0),
    ]
    fold = rows(fold_events(spark.createDataFrame(events, EVENTS), ["job_id"]))
    facts = {r["job_id"]: (r["state"], r["illegal"], r["events"]) for r in fold}
    assert facts == {1: ("failed", 0, 2), 2: ("completed", 0, 2), 3: ("running", 1, 3), 4: ("completed", 0, 2)}
    for size in (1, 4, 11):
        source = str(tmp_path / f"events-{size}")
        for i in range(0, len(events), size):
            spark.createDataFrame(events[i : i + size], EVENTS).coalesce(1).write.mode("append").parquet(source)
        store = JobStateStore(spark, str(tmp_path / f"state-{size}"), ("job_id",), "job_id long", buckets=2)
        query = start_job_state(batches(spark, source), store, str(tmp_path / f"checkpoint-{size}"))
        assert rows(job_states(store, query)) == fold


def test_enrichment_equals_batch_and_survives_a_replay(spark, tmp_path, sf_dir):
    raw = B.table(spark, sf_dir, "pages")
    source = str(tmp_path / "pages")
    raw.repartition(2, "page_id").write.parquet(source)
    companies, domains = B.site_companies(spark, sf_dir), B.site_domains(spark, sf_dir)
    store = EnrichmentStore(spark, str(tmp_path / "tables"), buckets=4)

    def run(checkpoint):
        stream = B.captures_from(batches(spark, source))
        start_enrichment(stream, store, companies, domains, str(tmp_path / checkpoint), AS_OF).awaitTermination()

    pages = page_records(B.captures_from(raw))
    detected, profiles = detect_technologies(pages), seo_scan(pages)
    documents = search_projection(companies, domains, pages, detected, profiles, AS_OF)
    want = {
        "technologies": stamped(detected, "detected_at", AS_OF),
        "marketing": stamped(detect_marketing(pages), "detected_at", AS_OF),
        "seo_profiles": stamped(profiles, "scanned_at", AS_OF),
        "documents": documents,
    }
    run("checkpoint")
    for name, frame in want.items():
        assert rows(store.table(name, frame).read()) == rows(frame), name
    # The same files again from a lost checkpoint: every batch is replayed.
    run("fresh-checkpoint")
    for name, frame in want.items():
        assert rows(store.table(name, frame).read()) == rows(frame), name
