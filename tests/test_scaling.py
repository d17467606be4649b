"""Steps of the registered queries whose tasks, texts moved or evaluations grew faster than their tables."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from checks import corpus, landing, registry
from cvegrid.operators import merge
from cvegrid.sources import tables
from cvegrid.sources.keyed import KeyedStore


@pytest.fixture
def orders(spark, tmp_path):
    day = datetime.datetime(1999, 5, 1)
    rows = [(k, day + datetime.timedelta(days=k % 900), "1-URGENT") for k in range(5000)]
    frame = spark.createDataFrame(rows, "o_orderkey bigint, o_orderdate timestamp_ntz, o_orderpriority string")
    frame.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_records_are_dealt_to_more_tasks_as_the_table_grows(spark, orders, monkeypatch):
    monkeypatch.setattr(corpus, "ROWS_A_TASK", 100)
    assert corpus.raw(spark, orders).rdd.getNumPartitions() == 50
    assert corpus.raw(spark, orders, paged=10).rdd.getNumPartitions() == 50


def test_texts_are_made_after_the_keys_have_moved(spark, orders):
    pages = landing._pages(corpus.raw(spark, orders, paged=landing.PAGE).withColumn("entry", F.col("raw_json")), "entry", "[")
    above, below = plan(pages).split("Exchange")
    assert "descriptions" in above and "descriptions" not in below
    files = os.listdir(landing.land_vuln_pages(spark, orders).removeprefix("file:"))
    assert [f for f in files if f.endswith(".txt.gz")] and not [f for f in files if f.endswith(".txt")]


def test_options_are_parsed_once_a_record(spark, orders):
    # One parse for the record, one for its options.
    assert plan(registry.QUERIES["ssvc_factors"](spark, orders)).count("from_json(") == 2


def test_prose_is_written_above_the_sort(spark):
    from cvegrid.operators import risk as ops

    tables_ = [spark.createDataFrame([], s) for s in (registry.schemas.NVD, registry.schemas.KEV, registry.schemas.EPSS)]
    ids = spark.createDataFrame([("CVE-2020-1000",)], "cve_id string")
    found = ops.score_ids(ops.risk_scores(*tables_), ids)._jdf.queryExecution().analyzed().toString()
    above, below = found.split("Sort [", 1)
    assert "Listed in KEV" in above and "Listed in KEV" not in below


def test_a_landed_batch_is_evaluated_once_and_goes_when_published(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "store"), "cve_id string, a int, b int", {"x": ["a"], "y": ["b"]}, parts=4)
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def named(n):
        calls.add(1)
        return f"CVE-{n}" if n % 10 else None

    folder = tables.shared_folder(spark).removeprefix("file:")
    before = {f for f in os.listdir(folder) if f.startswith("batch-")}
    rows = spark.range(200).repartition(3).select(named("id").alias("cve_id"), F.lit(1).alias("a"), F.lit(2).alias("b"))
    store.replace(rows)
    assert calls.value == 200 and store.read().count() == 180
    merge.merge_into(store, rows.where("cve_id = 'CVE-7'").withColumn("a", F.lit(9)))
    assert store.read().where("a = 9").count() == 1
    assert {f for f in os.listdir(folder) if f.startswith("batch-")} == before
