"""Merges, incremental loads and stored tables."""

import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from cvegrid.operators import merge, sync
from cvegrid.sources.keyed import KeyedStore
from cvegrid.sources.tables import VersionedTable, save_bucketed, shared_folder

SCORES = """cve_id string, probability decimal(6,5), percentile decimal(6,5), scored_at date, model_version string,
    previous_probability decimal(6,5), previous_scored_at date"""
PUBLISHED = "cve_id string, probability decimal(6,5), percentile decimal(6,5), scored_at date, model_version string"


def day(n):
    return datetime.date(2033, 11, n)


def publication(spark, n, **scores):
    rows = [(i, D(p), D("0.5"), day(n), f"v{n}") for i, p in scores.items()]
    return spark.createDataFrame(rows, PUBLISHED)


def published(spark, store, n, **scores):
    return merge.merge_score_publication(store, publication(spark, n, **scores), ["cve_id"])


@pytest.fixture
def first(spark, broadcast_limit):
    return published(spark, spark.createDataFrame([], SCORES), 4, X="0.125", Y="0.75")


def by_id(frame):
    return {r.cve_id: (r.probability, r.scored_at, r.previous_probability, r.previous_scored_at) for r in frame.collect()}


def test_a_first_publication_has_nothing_before_it(first):
    assert by_id(first) == {"X": (D("0.125"), day(4), None, None), "Y": (D("0.75"), day(4), None, None)}


@pytest.mark.parametrize(
    ("n", "value", "before"),
    [
        (4, "0.125", (None, None)),  # the same day again
        (4, "0.5", (None, None)),  # a correction of the same day
        (9, "0.5", (D("0.125"), day(4))),  # a later day
        (9, "0.125", (D("0.125"), day(4))),  # a later day with the same value
        (2, "0.5", (None, None)),  # an older day still replaces the current value
    ],
)
def test_only_a_later_day_moves_the_stored_score(spark, first, n, value, before):
    second = published(spark, first, n, X=value, Z="0.25")
    expected = {"X": (D(value), day(n), *before), "Y": (D("0.75"), day(4), None, None), "Z": (D("0.25"), day(n), None, None)}
    assert by_id(second) == expected
    # Loading the publication once more changes nothing.
    assert by_id(published(spark, second, n, X=value, Z="0.25")) == expected


def test_an_older_day_leaves_the_previous_columns(spark, first):
    third = published(spark, published(spark, first, 9, X="0.5"), 6, X="0.375")
    assert by_id(third)["X"] == (D("0.375"), day(6), D("0.125"), day(4))


def test_threshold_keeps_the_boundary(spark):
    from cvegrid.catalog import Catalog
    from cvegrid.plans import library

    scores = publication(spark, 5, P="0.9", Q="0.89999", R="0.90001")
    found = library.threshold_exact(Catalog(kev=None, nvd=None, epss=scores)).collect()
    assert sorted(r.cve_id for r in found) == ["P", "R"]


@pytest.fixture(params=["-1", "10MB"])
def broadcast_limit(spark, request):
    """Both shapes of a merge: batch too large to broadcast, and small."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_overwrite_and_kept_vector(spark, broadcast_limit):
    schema = "cve_id string, note string, embedding array<float>"
    store = spark.createDataFrame([("A", "old", [1.0]), ("B", "old", [2.0])], schema)
    batch = spark.createDataFrame([("B", None, None), ("C", "new", None), ("A", "new", [3.0])], schema)
    plain = {r.cve_id: (r.note, r.embedding) for r in merge.merge_overwrite(store, batch, ["cve_id"]).collect()}
    assert plain == {"A": ("new", [3.0]), "B": (None, None), "C": ("new", None)}
    kept = {r.cve_id: (r.note, r.embedding) for r in merge.merge_keep_vector(store, batch, ["cve_id"]).collect()}
    assert kept == {"A": ("new", [3.0]), "B": (None, [2.0]), "C": ("new", None)}
    assert merge.merge_counts(store, batch, ["cve_id"]).first().asDict() == {"new": 1, "modified": 2}


def test_update_ignores_unknown_keys(spark):
    store = spark.createDataFrame([("A", [1.0]), ("B", None)], "cve_id string, embedding array<float>")
    batch = spark.createDataFrame([("B", [2.0]), ("Z", [9.0])], "cve_id string, embedding array<float>")
    found = {r.cve_id: r.embedding for r in merge.update_from_batch(store, batch, ["cve_id"], "embedding").collect()}
    assert found == {"A": [1.0], "B": [2.0]}


def windows(spark, start, now, zone="UTC"):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = spark.createDataFrame([(start, now)], "s date, n timestamp_ntz")
        return [
            (r.window_start, r.window_end)
            for r in frame.select(F.inline(sync.sync_windows(F.col("s"), F.col("n")))).collect()
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_windows_share_endpoints_and_stop_now(spark, zone):
    start, now = datetime.date(2024, 1, 1), datetime.datetime(2024, 12, 1, 6, 30)
    expected, at = [], datetime.datetime(2024, 1, 1)
    while at < now:
        end = min(at + datetime.timedelta(days=120), now)
        expected.append((at, end))
        at = end
    assert windows(spark, start, now, zone) == expected


def test_windows_at_the_edges(spark):
    midnight = datetime.datetime(2024, 4, 30)
    assert len(windows(spark, datetime.date(2024, 1, 1), midnight)) == 1
    assert len(windows(spark, datetime.date(2024, 1, 1), midnight + datetime.timedelta(microseconds=1))) == 2
    assert windows(spark, midnight.date(), midnight) == []
    assert windows(spark, datetime.date(2024, 5, 1), midnight) == []


STORE = "cve_id string, published date, last_modified date, description string, embedding array<float>"


def feed(spark, *rows):
    data = [
        (i, datetime.date.fromisoformat(p[:10]), datetime.date.fromisoformat(m[:10]), "new", None,
         datetime.datetime.fromisoformat(p), datetime.datetime.fromisoformat(m))
        for i, p, m in rows
    ]
    return spark.createDataFrame(data, f"{STORE}, published_at timestamp_ntz, modified_at timestamp_ntz")


def test_incremental_sync_counts_both_phases(spark):
    store = spark.createDataFrame(
        [("A", datetime.date(2024, 1, 1), datetime.date(2024, 2, 1), "old", [1.0])], STORE
    )
    arrived = feed(
        spark,
        ("A", "2024-01-01T00:00:00", "2024-03-01T10:00:00"),  # both phases: published on the mark itself
        ("B", "2024-04-30T00:00:00", "2024-04-30T00:00:00"),  # on a shared endpoint of phase one
        ("C", "2023-01-01T00:00:00", "2024-01-31T23:59:59"),  # modified before the mark
        ("D", "2024-09-01T00:00:00", "2024-09-01T00:00:00"),  # after now
        ("E", "2023-01-01T00:00:00", "2024-05-31T00:00:00"),  # on a shared endpoint of phase two
    )
    now = F.lit(datetime.datetime(2024, 7, 1)).cast("timestamp_ntz")
    result = sync.incremental_sync(store, arrived, now)
    assert result.counts.first().asDict() == {"new": 3, "modified": 4, "distinct_synced": 3, "synced": 7}
    rows = {r.cve_id: (r.description, r.embedding) for r in result.table.collect()}
    assert rows == {"A": ("new", [1.0]), "B": ("new", None), "E": ("new", None)}
    again = sync.incremental_sync(result.table, arrived, now, since=F.lit(datetime.date(2023, 1, 1)))
    assert again.counts.first().distinct_synced == 4


def test_store_sync_reads_the_feed_once_and_keeps_other_parts(spark, tmp_path):
    held = KeyedStore(spark, str(tmp_path / "store"), STORE, parts=32)
    held.replace(
        spark.createDataFrame(
            [(f"S{n}", datetime.date(2024, 1, 1), datetime.date(2024, 2, 1), "old", [1.0]) for n in range(60)], STORE
        )
    )
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        reads.add(1)
        return text

    rows = feed(
        spark,
        ("S1", "2024-01-01T00:00:00", "2024-03-01T10:00:00"),
        ("B", "2024-04-30T00:00:00", "2024-04-30T00:00:00"),
        ("C", "2023-01-01T00:00:00", "2024-01-31T23:59:59"),
    )
    now = F.lit(datetime.datetime(2024, 7, 1)).cast("timestamp_ntz")
    done = sync.sync_store(held, rows.withColumn("description", counted("description")), now)
    assert (done.new, done.modified, done.synced, done.distinct_synced) == (3, 2, 5, 2)
    assert (done.merge.new, done.merge.modified) == (1, 1) and len(done.merge.parts) <= 2
    assert reads.value <= 3
    found = {r.cve_id: (r.description, r.embedding) for r in held.read().collect()}
    assert len(found) == 61 and found["S1"] == ("new", [1.0]) and found["B"] == ("new", None) and found["S2"] == ("old", [1.0])
    empty = KeyedStore(spark, str(tmp_path / "empty"), STORE, parts=4)
    assert sync.sync_store(empty, rows, now).synced == 0 and empty.version() is None
    with pytest.raises(ValueError, match="no columns"):
        sync.sync_store(held, rows.withColumn("extra", F.lit(1)), now)


def test_incremental_sync_of_an_empty_store_does_nothing(spark):
    store = spark.createDataFrame([], STORE)
    arrived = feed(spark, ("A", "2024-01-01T00:00:00", "2024-03-01T10:00:00"))
    now = F.lit(datetime.datetime(2024, 7, 1)).cast("timestamp_ntz")
    for since in (None, F.lit(datetime.date(2023, 1, 1))):
        result = sync.incremental_sync(store, arrived, now, since=since)
        assert result.counts.first().asDict() == {"new": 0, "modified": 0, "distinct_synced": 0, "synced": 0}
        assert result.table.count() == 0
    assert sync.phase_windows(store, now).count() == 0


def test_versions_swap_only_when_complete(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.write(spark.range(3)) == 3
    reader = table.read()
    assert table.write(spark.range(5)) == 5
    assert (reader.count(), table.read().count(), table.version()) == (3, 5, 2)
    (tmp_path / "t" / "v0000000003").mkdir()  # a job that died before finishing
    assert table.version() == 2
    table.write(spark.range(1))
    assert table.version() == 4
    assert table.expire(keep=2) == [1]
    assert table.read().count() == 1 and not (tmp_path / "t" / "v0000000001").exists()
    with pytest.raises(ValueError, match="must be kept"):
        table.expire(keep=0)


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS buckets LOCATION '{tmp_path / 'db'}'")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = spark.range(1000).select(F.concat(F.lit("CVE-"), "id").alias("cve_id"), "id")
        save_bucketed(ids, "buckets.a", 8)
        save_bucketed(ids, "buckets.b", 8)
        joined = merge.merge_overwrite(spark.table("buckets.a"), spark.table("buckets.b"), ["cve_id"])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP DATABASE buckets CASCADE")


class Context:
    """The parts of a Spark context the folder choice looks at."""

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = f"file:{folder}/x"


class Session:
    def __init__(self, context, **settings):
        self.sparkContext, self.conf = context, settings


def test_shared_folder_is_the_sessions():
    named = {"spark.checkpoint.dir": "hdfs://shared/place"}
    assert shared_folder(Session(Context("yarn"), **named)) == "hdfs://shared/place"
    assert shared_folder(Session(Context("yarn", "hdfs://set/later"))) == "hdfs://set/later"
    with pytest.raises(ValueError, match="shared by all executors"):
        shared_folder(Session(Context("yarn")))
    local = Session(Context("local[2]"))
    assert shared_folder(local) == shared_folder(local) == local.sparkContext.folder


def test_a_batch_may_repeat_keys(spark):
    store = spark.createDataFrame([("A", 1, [1.0])], "cve_id string, n int, embedding array<float>")
    batch = spark.createDataFrame(
        [("A", 2, None, 1), ("A", 3, None, 2), ("B", 9, None, 2), ("B", 8, [2.0], 1)],
        "cve_id string, n int, embedding array<float>, seen int",
    )
    merged = merge.merge_keep_vector(store, batch, ["cve_id"], position="seen")
    assert sorted(map(tuple, merged.collect())) == [("A", 3, [1.0]), ("B", 9, None)]
    assert merge.merge_overwrite(store, batch.drop("seen"), ["cve_id"]).count() == 2
    assert tuple(merge.merge_counts(store, batch, ["cve_id"]).first()) == (1, 1)
    updated = merge.update_from_batch(store, batch, ["cve_id"], "n", position="seen")
    assert [tuple(r) for r in updated.collect()] == [("A", 3, [1.0])]


def test_unknown_columns_are_refused(spark):
    store = spark.createDataFrame([("A", 1)], "cve_id string, n int")
    with pytest.raises(ValueError, match="extra"):
        merge.merge_overwrite(store, store.selectExpr("*", "1 AS extra"), ["cve_id"])


def test_older_rows_can_be_left_out(spark):
    store = spark.createDataFrame([("A", 5, None), ("B", 5, None)], "cve_id string, day int, embedding array<float>")
    batch = spark.createDataFrame([("A", 4, [1.0]), ("B", 6, [1.0]), ("C", 1, None)], store.schema)
    merged = merge.merge_keep_vector(store, batch, ["cve_id"], not_before="day")
    assert sorted((r.cve_id, r.day) for r in merged.collect()) == [("A", 5), ("B", 6), ("C", 1)]


def test_a_merge_has_one_shape_whatever_the_sizes(spark):
    small = spark.range(3).selectExpr("CAST(id AS STRING) AS cve_id", "id AS n")
    large = spark.range(300_000).selectExpr("CAST(id AS STRING) AS cve_id", "id AS n")
    for batch in (small, large):
        plan = merge.merge_overwrite(large, batch, ["cve_id"])._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and "Join FullOuter" in plan
