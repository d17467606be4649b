"""Physical plans: what reaches the scan, what moves, what stays in the JVM."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from checks.registry import Tables
from cvegrid.catalog import Catalog
from cvegrid.functions import shaping
from cvegrid.operators import knn, merge, metering
from cvegrid.operators.risk import universe
from cvegrid.plans import library
from cvegrid.sources.tables import save_bucketed
from cvegrid.streaming import ingest

SF_DIR = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def read_schemas(text: str) -> list[str]:
    return re.findall(r"ReadSchema: (.*)", text)


@pytest.fixture(scope="module", autouse=True)
def whole_plans(spark):
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    yield
    spark.conf.set("spark.sql.maxMetadataStringLength", old)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The catalog as a load leaves it: wide Parquet tables."""
    tables = Tables(spark, SF_DIR)
    folder = tmp_path_factory.mktemp("stored")
    frames = {}
    wide = {
        "nvd": tables.shaped,
        "kev": tables.catalog.kev.withColumn("content", F.lit("text")),
        "epss": tables.catalog.epss,
        "cwe": tables.catalog.cwe,
    }
    for name, frame in wide.items():
        frame.write.parquet(str(folder / name))
        frames[name] = spark.read.parquet(str(folder / name))
    return Catalog(**frames)


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_filters_reach_the_scan(stored):
    assert "GreaterThanOrEqual(published,1998-01-01)" in plan(library.critical_in_year(stored, 1998))
    assert "GreaterThanOrEqual(probability,0.90000)" in plan(library.threshold_exact(stored))
    assert "EqualTo(ssvc_exploitation,active)" in plan(library.patch_now_ssvc(stored))
    assert "EqualTo(cve_id,CVE-1)" in plan(library.lookup_cve(stored, "CVE-1"))


def test_json_filters_read_stored_columns(spark, stored, tmp_path):
    store = ingest.vuln_store(spark, str(tmp_path / "vulns"), 4)
    store.replace(shaping.stored_row(Tables(spark, SF_DIR).parsed))
    for frame, pushed in (
        (library.json_path_exists(store.read()), "EqualTo(has_ssvc,true)"),
        (library.json_status_filter(store.read(), "Rejected"), "EqualTo(status,Rejected)"),
    ):
        text = plan(frame)
        assert pushed in text and not any("raw_json" in s for s in read_schemas(text))


def test_blend_never_reads_documents_or_vectors(stored):
    schemas = read_schemas(plan(stored.risk))
    assert schemas and not any(w in s for s in schemas for w in ("raw_json", "content", "embedding", "description"))


def test_rankings_keep_k_rows_per_task(stored):
    for frame in (library.patch_first(stored), library.biggest_movers(stored), library.newest_listed(stored)):
        assert "TakeOrderedAndProject" in plan(frame)


def test_counts_are_summed_before_they_move(stored):
    text = plan(library.top_weaknesses(stored))
    assert text.index("partial_count") > text.index("Exchange")


def test_popular_keys_can_be_split(stored, no_broadcast):
    """A join on the key alone, over exchanges that adaptive execution may split where they are skewed."""
    for frame in (library.resolve_weakness(stored), library.listed_in_weakness_class(stored)):
        text = plan(frame)
        assert re.search(r"SortMergeJoin \[cwe_id#\d+\], \[cwe_id#\d+\], Inner", text)
        assert len(re.findall(r"Exchange hashpartitioning\(cwe_id#\d+, \d+\), ENSURE_REQUIREMENTS", text)) == 2


def test_one_definition_is_a_value_not_a_join(stored, no_broadcast):
    assert "cwe_id" not in "".join(re.findall(r"Exchange hashpartitioning\([^)]*\)", plan(library.weakness_detail_with_cves(stored, "CWE-89"))))


def test_blend_over_bucketed_tables_moves_only_ids(spark, stored, no_broadcast, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS blend LOCATION '{tmp_path / 'db'}'")
    try:
        for name in ("nvd", "kev", "epss"):
            save_bucketed(getattr(stored, name), f"blend.{name}", 8)
        catalog = Catalog(**{name: spark.table(f"blend.{name}") for name in ("nvd", "kev", "epss")})
        text = plan(catalog.risk)
        assert text.count("Exchange ") == 1
        assert catalog.risk.count() == universe(catalog.nvd, catalog.kev).count() == stored.risk.count()
        assert catalog.risk.exceptAll(stored.risk).count() == 0
    finally:
        spark.sql("DROP DATABASE blend CASCADE")


def test_merge_moves_each_side_once(stored, no_broadcast):
    text = plan(merge.merge_overwrite(stored.epss, stored.epss.select("*"), ["cve_id"]))
    assert text.count("Exchange hashpartitioning(cve_id") == text.count("Exchange ") == 2


def test_merges_read_each_side_once_whatever_the_sizes(spark, stored, tmp_path):
    path = str(tmp_path / "batch")
    stored.nvd.where("published >= '2001-07-25'").coalesce(1).write.parquet(path)
    for batch in (spark.read.parquet(path), stored.nvd):
        text = plan(merge.merge_keep_vector(stored.nvd, batch, ["cve_id"]))
        assert re.search(r"Join \[cve_id#\d+\], \[cve_id#\d+\], FullOuter", text)
        assert sum("raw_json" in s for s in read_schemas(text)) == 2


def test_batch_search_limits_before_its_shuffle(spark):
    tables = Tables(spark, SF_DIR)
    queries = tables.table("embeddings").where("vec_id < 3").withColumnRenamed("vec_id", "query_id")
    text = plan(knn.knn_batch(tables.table("embeddings"), queries))
    assert "WindowGroupLimit" in text and "Cartesian" not in text and "NestedLoop" not in text


def test_no_window_spans_a_users_day_of_events(spark):
    text = plan(metering.over_limit(Tables(spark, SF_DIR).usage_events))
    over_events = [line for line in text.splitlines() if "row_number()" in line and "Window" in line]
    assert over_events and all("_minute" in line for line in over_events)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_no_cross_joins(spark, name):
    if name.startswith(("stream_", "ann_", "read_", "append_", "table_sink", "risk_snapshot")):
        pytest.skip("its plan is that of reading back a stored result")
    text = plan(driver.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
