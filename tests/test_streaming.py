"""Streams: resume, replay and late arrivals."""

import datetime
import json

import pytest

from cvegrid.sources.tables import VersionedTable
from cvegrid.streaming import ingest, usage


def page(tmp_path, name, *records):
    wrappers = [{"cve": r} for r in records]
    (tmp_path / "pages").mkdir(exist_ok=True)
    (tmp_path / "pages" / name).write_text(json.dumps({"vulnerabilities": wrappers}))


def record(cve_id, text):
    return {"id": cve_id, "published": "2024-01-01T00:00:00", "descriptions": [{"lang": "en", "value": text}]}


@pytest.fixture
def store(spark, tmp_path):
    return ingest.vuln_store(spark, str(tmp_path / "vulns"), parts=4)


def load(spark, tmp_path):
    deltas = ingest.vuln_deltas(spark, str(tmp_path / "deltas"))
    records = ingest.stream_pages(spark, str(tmp_path / "pages"), files_per_batch=1)
    ingest.stream_vuln_ingest(records, deltas, str(tmp_path / "progress")).awaitTermination()
    return deltas


def test_pages_are_loaded_once_and_the_last_arrival_counts(spark, tmp_path, store):
    page(tmp_path, "1.json", record("CVE-1", "a"), record("CVE-2", "a"), record("CVE-1", "b"))
    deltas = load(spark, tmp_path)
    assert ingest.fold_vulns(store, deltas).new == 2
    assert {r.cve_id: r.description for r in store.read().collect()} == {"CVE-1": "b", "CVE-2": "a"}

    page(tmp_path, "2.json", record("CVE-2", "c"), record("CVE-3", "c"))
    load(spark, tmp_path)
    assert deltas.read().count() == 5  # the first page was not read again
    ingest.fold_vulns(store, deltas)
    assert {r.cve_id: r.description for r in store.read().collect()} == {"CVE-1": "b", "CVE-2": "c", "CVE-3": "c"}


def test_replayed_batch_replaces_itself(spark, tmp_path):
    deltas = usage.usage_deltas(spark, str(tmp_path / "d"))
    assert deltas.read().count() == 0
    day = datetime.date(2024, 1, 1)
    rows = spark.createDataFrame([("a", day, 1, 2, 3)], deltas.schema)
    for _ in range(2):
        deltas.put(rows, 4)
    assert [tuple(r) for r in deltas.read().collect()] == [("a", day, 1, 2, 3, 4)]


def test_late_usage_still_counts(spark, tmp_path):
    schema = "user_identifier string, ts timestamp_ntz, event_id long, input_tokens long, output_tokens long"

    def land(*events):
        spark.createDataFrame(list(events), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "events"))
        deltas = usage.usage_deltas(spark, str(tmp_path / "deltas"))
        usage.stream_usage_daily(stream, deltas, str(tmp_path / "progress")).awaitTermination()
        return {(r.user_identifier, r.query_date.day): r.query_count for r in usage.current_usage(None, deltas).collect()}

    day = datetime.datetime(2024, 1, 20, 10)
    land(("a", day, 1, 1, 1), ("a", day, 2, 1, 1), ("b", day, 3, 1, 1))
    assert run() == {("a", 20): 2, ("b", 20): 1}
    land(("a", day - datetime.timedelta(days=15), 4, 1, 1), ("a", day, 5, 1, 1))
    assert run() == {("a", 5): 1, ("a", 20): 3, ("b", 20): 1}
    assert run() == {("a", 5): 1, ("a", 20): 3, ("b", 20): 1}


def test_windowed_usage_drops_and_reports_what_is_too_late(spark, tmp_path):
    schema = "user_identifier string, ts timestamp, event_id long, input_tokens long, output_tokens long"
    deltas = usage.usage_deltas(spark, str(tmp_path / "deltas"))

    def run(*events):
        spark.createDataFrame(list(events), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "events"))
        query = usage.stream_usage_windows(stream, deltas, str(tmp_path / "progress"), "2 days")
        query.awaitTermination()
        rows = {(r.user_identifier, r.query_date.day): r.query_count for r in usage.latest_usage(deltas).collect()}
        return rows, usage.events_seen(query)

    at = lambda day, number, user="a": (user, datetime.datetime(2024, 1, day, 10), number, 1, 1)
    assert run(at(20, 1), at(20, 2), at(19, 3, "b")) == ({("a", 20): 2, ("b", 19): 1}, 3)
    # The 18th is still open at a watermark of the 18th at ten o'clock, the 17th is not.
    assert run(at(18, 4), at(17, 5), at(20, 6)) == ({("a", 20): 3, ("b", 19): 1, ("a", 18): 1}, 3)
    assert run(at(25, 7)) == ({("a", 20): 3, ("b", 19): 1, ("a", 18): 1, ("a", 25): 1}, 1)
    assert run(at(20, 8)) == ({("a", 20): 3, ("b", 19): 1, ("a", 18): 1, ("a", 25): 1}, 1)


def test_new_listings_read_no_earlier_batches(spark, tmp_path):
    stored = spark.createDataFrame([("CVE-1",)], "cve_id string")
    deltas = ingest.listing_deltas(spark, str(tmp_path / "deltas"))
    deltas.read = None  # reading what earlier batches put out would fail
    for ids in (["CVE-1", "CVE-2"], ["CVE-2", "CVE-3"], ["CVE-3", "CVE-3", "CVE-4"]):
        spark.createDataFrame([(i,) for i in ids], "cve_id string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("cve_id string").parquet(str(tmp_path / "in"))
        ingest.stream_new_listings(stream, stored, deltas, str(tmp_path / "progress")).awaitTermination()
    found = ingest.listing_deltas(spark, deltas.path).read().orderBy("cve_id").collect()
    assert [r.cve_id for r in found] == ["CVE-2", "CVE-3", "CVE-4"]


def test_new_listings_are_reported_once(spark, tmp_path):
    stored = spark.createDataFrame([("CVE-1",)], "cve_id string")
    deltas = ingest.listing_deltas(spark, str(tmp_path / "deltas"))

    def run(*ids):
        spark.createDataFrame([(i,) for i in ids], "cve_id string").coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in")
        )
        stream = spark.readStream.schema("cve_id string").parquet(str(tmp_path / "in"))
        ingest.stream_new_listings(stream, stored, deltas, str(tmp_path / "progress")).awaitTermination()
        return sorted(r.cve_id for r in deltas.read().collect())

    assert run("CVE-1", "CVE-2", "CVE-2") == ["CVE-2"]
    assert run("CVE-2", "CVE-3") == ["CVE-2", "CVE-3"]


def test_the_latest_revision_counts_whatever_arrives_last(spark, tmp_path, store):
    revised = lambda moment, text: record("CVE-1", text) | {"lastModified": moment}

    def described():
        return [r.description for r in store.read().collect()]

    page(tmp_path, "1.json", revised("2024-03-01T10:00:00", "new"))
    page(tmp_path, "2.json", revised("2023-03-01T10:00:00", "old"))
    deltas = load(spark, tmp_path)
    ingest.fold_vulns(store, deltas)
    assert described() == ["new"]
    assert ingest.fold_vulns(store, deltas) is None

    # Of one day the later hour counts, whichever fold brings it; an offset is taken into account.
    for name, moment, text, kept in (
        ("3.json", "2024-03-01T18:00:00", "evening", "evening"),
        ("4.json", "2024-03-01T09:00:00.000", "morning", "evening"),
        ("5.json", "2024-03-01T12:00:00-08:00", "noon in the west", "noon in the west"),
        ("6.json", "2024-03-01T19:00:00Z", "earlier", "noon in the west"),
    ):
        page(tmp_path, name, revised(moment, text))
        load(spark, tmp_path)
        ingest.fold_vulns(store, deltas)
        assert described() == [kept]

    # A fold that is repeated because the ledger was not written changes nothing.
    again = ingest.DeltaFolder(spark, deltas.path, deltas.schema)
    again.folded = lambda: -1
    ingest.fold_vulns(store, again)
    assert described() == ["noon in the west"]


def test_status_and_presence_are_stored(spark, tmp_path, store):
    held = record("CVE-1", "a") | {"vulnStatus": "Rejected", "metrics": {"ssvcV203": [{"ssvcData": {"options": []}}]}}
    page(tmp_path, "1.json", held, record("CVE-2", "b"))
    ingest.fold_vulns(store, load(spark, tmp_path))
    rows = {r.cve_id: (r.status, r.has_ssvc) for r in store.read().collect()}
    assert rows == {"CVE-1": ("Rejected", True), "CVE-2": (None, False)}


def test_usage_is_folded_once(spark, tmp_path):
    deltas = usage.usage_deltas(spark, str(tmp_path / "d"))
    table = VersionedTable(spark, str(tmp_path / "usage"))
    rows = spark.createDataFrame([("a", datetime.date(2024, 1, 1), 1, 2, 3)], deltas.schema)
    for batch, total in ((0, 1), (1, 2)):
        deltas.put(rows, batch)
        for _ in range(2):
            usage.fold_usage(table, deltas)
            assert [r.query_count for r in table.read().collect()] == [total]
    deltas.put(rows, 2)
    assert [r.query_count for r in usage.current_usage(table.read(), deltas).collect()] == [3]


def test_folded_deltas_go(spark, tmp_path, store):
    page(tmp_path, "1.json", record("CVE-1", "a"), record("CVE-2", "a"))
    deltas = load(spark, tmp_path)
    assert deltas.expire() == []  # nothing is folded yet
    ingest.fold_vulns(store, deltas)
    page(tmp_path, "2.json", record("CVE-2", "b"))
    load(spark, tmp_path)
    assert deltas.expire() == [0]
    assert [r.cve_id for r in deltas.read().collect()] == ["CVE-2"]
    ingest.fold_vulns(store, deltas)
    store.expire(1)
    assert deltas.expire() == [1] and deltas.read().count() == 0 and ingest.fold_vulns(store, deltas) is None
    assert {r.cve_id: r.description for r in store.read().collect()} == {"CVE-1": "a", "CVE-2": "b"}
