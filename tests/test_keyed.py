"""Stores by key hash: which files a merge and a look-up touch, versions, families; the risk snapshot's two orders."""

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cvegrid.operators import merge
from cvegrid.operators.risk import RiskSnapshot
from cvegrid.sources import keyed
from cvegrid.sources.keyed import MARKER, KeyedStore

SCHEMA = "cve_id string, note string, changed date, body string, embedding array<float>"
FAMILIES = {"narrow": ["note", "changed"], "wide": ["body", "embedding"]}
OLD, NEW = datetime.date(2030, 1, 1), datetime.date(2030, 2, 1)


@pytest.fixture
def store(spark, tmp_path):
    made = KeyedStore(spark, str(tmp_path / "store"), SCHEMA, FAMILIES, parts=8)
    rows = [(f"CVE-{n}", "old", OLD, f"body {n}", [float(n)]) for n in range(200)]
    made.replace(spark.createDataFrame(rows, SCHEMA))
    return made


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def contents(store, version=None):
    return {r.cve_id: (r.note, r.body, r.embedding) for r in store.read(version=version).collect()}


def part_files(store, version):
    return {p.parent.relative_to(store.path) for p in Path(store.path).glob(f"v{version:010d}/*/*/*.parquet")}


def test_a_small_merge_reads_and_writes_only_its_parts(spark, store):
    before = contents(store)
    rows = [(f"CVE-{n}", "new", NEW, None, None) for n in (3, 4, 500)]
    report = merge.merge_into(store, batch(spark, *rows), merge.keep_vector())
    touched = set(store.parts_of(batch(spark, *rows)))
    assert (report.new, report.modified, set(report.parts)) == (1, 2, touched) and len(touched) < 4
    # Only the touched parts have files in the new version, in both families.
    assert {(p.parts[1], p.parts[2]) for p in part_files(store, report.version)} == {
        (family, f"key_part={n}") for family in FAMILIES for n in touched
    }
    expected = before | {f"CVE-{n}": ("new", None, [float(n)]) for n in (3, 4)} | {"CVE-500": ("new", None, None)}
    assert contents(store) == expected
    assert contents(store, report.version - 1) == before
    # What the merge opens are the same parts.
    opened = store.family("wide", touched, report.version - 1).inputFiles()
    assert {p.split("key_part=")[1].split("/")[0] for p in opened} == {str(n) for n in touched}


def test_a_family_without_incoming_columns_stays(spark, store):
    before = contents(store)
    rows = spark.createDataFrame([("CVE-7", "seen")], "cve_id string, note string")
    report = merge.merge_into(store, rows)
    assert {p.parts[1] for p in part_files(store, report.version)} == {"narrow"}
    assert contents(store) == before | {"CVE-7": ("seen", "body 7", [7.0])}
    fresh = spark.createDataFrame([("CVE-7", [1.0]), ("CVE-900", [2.0])], "cve_id string, embedding array<float>")
    report = merge.merge_into(store, fresh, known_only=True)
    assert (report.new, report.modified) == (0, 1) and contents(store)["CVE-7"] == ("seen", "body 7", [1.0])
    assert "CVE-900" not in contents(store)


def test_older_rows_and_empty_batches_change_nothing(spark, store):
    before, version = contents(store), store.version()
    older = batch(spark, ("CVE-1", "older", datetime.date(2029, 1, 1), "x", [0.0]))
    assert merge.merge_into(store, older, not_before="changed").modified == 0
    assert merge.merge_into(store, older.where("false")).parts == ()
    assert merge.merge_into(store, batch(spark, (None, "no key", NEW, "x", None))).new == 0
    assert store.version() == version and contents(store) == before
    same = batch(spark, ("CVE-1", "same day", OLD, "x", [0.0]))
    assert merge.merge_into(store, same, not_before="changed").modified == 1
    with pytest.raises(ValueError, match="no columns"):
        merge.merge_into(store, same.withColumn("extra", F.lit(1)))


def test_repeated_keys_go_by_position(spark, store):
    rows = batch(spark, ("CVE-1", "b", NEW, "x", None), ("CVE-1", "a", NEW, "y", None)).withColumn(
        "at", F.when(F.col("note") == "a", 2).otherwise(1)
    )
    merge.merge_into(store, rows, merge.keep_vector(), position="at")
    assert contents(store)["CVE-1"] == ("a", "y", [1.0])


def test_unfinished_and_competing_versions(spark, store):
    before = contents(store)
    # A load that died before its marker was there.
    merge.merge_into(store, batch(spark, ("CVE-1", "lost", NEW, "x", None)))
    (Path(store.path) / f"v{store.version():010d}" / MARKER).unlink()
    again = KeyedStore(spark, store.path, SCHEMA, FAMILIES, parts=8)
    assert contents(again) == before
    base = again.version()
    report = merge.merge_into(again, batch(spark, ("CVE-1", "kept", NEW, "x", None)))
    assert report.version > base + 1 and contents(again)["CVE-1"][0] == "kept"
    with pytest.raises(RuntimeError, match="has changed"):
        again.rewrite({"narrow": again.family("narrow", [0])}, base)


def test_expired_parts_are_those_no_kept_version_shows(spark, store):
    for note in ("one", "two", "three"):
        merge.merge_into(store, batch(spark, ("CVE-1", note, NEW, "x", [1.0])))
    kept = contents(store, store.version() - 1)
    gone = store.expire(keep=2)
    assert len(gone) == 4 and contents(store, store.version() - 1) == kept
    assert len(contents(store)) == 200 and contents(store)["CVE-1"][0] == "three"
    with pytest.raises(ValueError, match="must be kept"):
        store.expire(0)


def test_look_ups_open_only_their_parts(spark, store):
    ids = spark.createDataFrame([("CVE-5",), ("CVE-5",), ("CVE-x",), (None,)], "cve_id string")
    found = store.look_up(ids, ["note"])
    assert [tuple(r) for r in found.collect()] == [("CVE-5", "old")]
    files = [f for f in found.inputFiles() if "/narrow/" in f or "/wide/" in f]
    assert files and all("/narrow/" in f for f in files) and len(files) <= 2


def test_narrow_columns_do_not_open_the_wide_family(store):
    assert all("/narrow/" in f for f in store.read(["cve_id", "note"]).inputFiles())
    assert sorted(store.read().columns) == sorted(SCHEMA.replace(" array<float>", " x").split(" ")[::2])


def test_replacing_empties_parts_without_rows(spark, store):
    store.replace(batch(spark, ("CVE-1", "alone", NEW, "x", None)))
    assert set(contents(store)) == {"CVE-1"}
    store.replace(batch(spark).where("false"))
    assert contents(store) == {}


def test_a_column_belongs_to_one_family(spark, tmp_path):
    with pytest.raises(ValueError, match="exactly one family"):
        KeyedStore(spark, str(tmp_path / "s"), SCHEMA, {"narrow": ["note"], "wide": ["body", "note"]})


@pytest.fixture
def risk(spark):
    return spark.range(1000).select(
        F.concat(F.lit("CVE-"), "id").alias("cve_id"),
        (F.col("id") % 100 / 2).cast("decimal(5,1)").alias("risk_score"),
        F.lit("x").alias("other"),
    )


def test_snapshot_top_opens_leading_files_only(spark, risk, tmp_path):
    snapshot = RiskSnapshot(spark, str(tmp_path / "risk"), parts=4)
    with pytest.raises(FileNotFoundError):
        snapshot.read()
    assert snapshot.refresh(risk, files=10) == 1000
    files = len(snapshot.read().inputFiles())
    assert files >= 8
    ranked = sorted(risk.collect(), key=lambda r: (-r.risk_score, r.cve_id))
    for limit, most in ((1, 1), (20, 2), (150, 4), (5000, files)):
        top = snapshot.top(limit)
        assert [r.cve_id for r in top.collect()] == [r.cve_id for r in ranked[:limit]]
        assert len(top.inputFiles()) <= most
    assert snapshot.read().exceptAll(risk).count() == 0 and snapshot.read().count() == 1000


def test_snapshot_look_up_and_refresh(spark, risk, tmp_path):
    snapshot = RiskSnapshot(spark, str(tmp_path / "risk"), parts=4)
    snapshot.refresh(risk)
    ids = spark.createDataFrame([("CVE-5",), ("CVE-nope",)], "cve_id string")
    found = snapshot.look_up(ids)
    assert [r.cve_id for r in found.collect()] == ["CVE-5"]
    assert 1 <= len({f for f in found.inputFiles() if "by_id" in f}) <= 2
    reader = snapshot.read()
    assert snapshot.refresh(risk.where("risk_score > 40")) == risk.where("risk_score > 40").count()
    assert reader.count() == 1000 and snapshot.look_up(ids).count() == 0
    snapshot.refresh(risk.where("false"))
    assert snapshot.read().count() == snapshot.top(5).count() == snapshot.look_up(ids).count() == 0


def test_large_batches_are_merged_by_portions(spark, tmp_path, monkeypatch):
    """A query writes few parts at once, leaves no shuffle files, and the merge is as with one query."""
    rows = [(f"CVE-{n}", f"note {n}", NEW, "{}", [float(n)]) for n in range(60)]
    changed = [(f"CVE-{n}", "changed", NEW, None, None) for n in range(30, 90)] + [(None, "lost", NEW, None, None)]
    held, written = {}, []
    write = KeyedStore._write

    def counted(self, number, family, frame):
        write(self, number, family, frame)
        written.append((family, frame.select(self.part_of(self.key)).distinct().count()))

    monkeypatch.setattr(KeyedStore, "_write", counted)
    for together in (1_000_000, 1):
        monkeypatch.setattr(keyed, "ROWS_TOGETHER", together)
        made = KeyedStore(spark, str(tmp_path / f"s{together}"), SCHEMA, FAMILIES, parts=4)
        made.replace(spark.createDataFrame(rows, SCHEMA))
        written.clear()
        report = merge.merge_into(made, spark.createDataFrame(changed, SCHEMA))
        assert (report.new, report.modified) == (30, 30)
        assert sorted(written) == sorted((family, 4 if together > 1 else 1) for family in FAMILIES for _ in range(1 if together > 1 else 4))
        held[together] = sorted(map(str, made.read().collect()))
    assert held[1] == held[1_000_000] and len(held[1]) == 90


def test_portions_hold_all_parts():
    assert KeyedStore.portions([1, 3, 4], 10) == [[1, 3, 4]]
    assert KeyedStore.portions([1, 3, 4], 2 * keyed.ROWS_TOGETHER) == [[1], [3], [4]]
    assert KeyedStore.portions([1, 3, 4, 5, 6], 2 * keyed.ROWS_TOGETHER) == [[1, 3], [4, 5], [6]]
    assert KeyedStore.portions([], 0) == []
