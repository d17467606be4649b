"""Streaming loads of landed vulnerability pages and of catalog entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cvegrid import schemas
from cvegrid.functions.shaping import parse_record, stored_row
from cvegrid.operators.merge import MergeReport, keep_vector, merge_into
from cvegrid.sources.feeds import page_records
from cvegrid.sources.keyed import KeyedStore
from cvegrid.streaming.deltas import DeltaFolder


def stream_pages(spark: SparkSession, landing: str, per_line: bool = False, files_per_batch: int = 1000) -> DataFrame:
    """Streaming records of page files as they land."""
    pages = (
        spark.readStream.format("text")
        .option("wholetext", str(not per_line).lower())
        .option("maxFilesPerTrigger", files_per_batch)
        .load(landing)
    )
    records = pages.select(F.explode(page_records(F.col("value"))).alias("raw_json"))
    return records.withColumn("parsed", parse_record(F.col("raw_json")))


def vuln_store(spark: SparkSession, path: str, parts: int = 64) -> KeyedStore:
    """The stored vulnerabilities: narrow columns in one family, JSON, documents and vectors in another."""
    names = spark.createDataFrame([], schemas.STORED_NVD).columns
    narrow = [c for c in names if c != "cve_id" and c not in schemas.NVD_WIDE]
    return KeyedStore(spark, path, schemas.STORED_NVD, {"narrow": narrow, "wide": schemas.NVD_WIDE}, parts=parts)


def vuln_deltas(spark: SparkSession, path: str) -> DeltaFolder:
    return DeltaFolder(spark, path, f"{schemas.STORED_NVD}, arrival bigint")


def stream_vuln_ingest(records: DataFrame, deltas: DeltaFolder, checkpoint: str) -> StreamingQuery:
    """Shape arriving records and keep them as deltas; handled files are never read twice."""

    def load(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn("arrival", F.monotonically_increasing_id())
        deltas.put(stored_row(placed, keep=["arrival"]), number)

    return (
        records.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def fold_vulns(store: KeyedStore, deltas: DeltaFolder) -> MergeReport | None:
    """Merge the deltas behind the last fold into the store; None if there are none.

    Of an id the revision with the latest moment of modification counts, of equal ones the last
    arrival; a stored row that was modified later, if only within the day, stays.  So a fold that
    is repeated after a failure between the store and the ledger changes nothing.
    """
    rows = deltas.unfolded()
    last = rows.agg(F.max("batch_id")).first()[0]
    if last is None:
        return None
    order = F.struct("modified_at", "batch_id", "arrival").alias("place")
    incoming = rows.select("*", order).drop("batch_id", "arrival")
    report = merge_into(store, incoming, keep_vector(), position="place", not_before="modified_at")
    deltas.mark_folded(last)
    return report


def listing_deltas(spark: SparkSession, path: str) -> DeltaFolder:
    return DeltaFolder(spark, path, "cve_id string")


def stream_new_listings(
    entries: DataFrame, stored: DataFrame, deltas: DeltaFolder, checkpoint: str
) -> StreamingQuery:
    """Ids of arriving catalog entries that neither the store nor an earlier batch holds.

    The ids reported so far are the stream's own keyed state, spread over its partitions and kept
    in its checkpoint; a batch looks up only its own ids in it, however many batches there were.
    Known ids are cut away before, so the state holds new ones only.
    """
    unknown = entries.select("cve_id").join(stored.select("cve_id"), "cve_id", "left_anti")
    return (
        unknown.dropDuplicates(["cve_id"])
        .writeStream.foreachBatch(lambda batch, number: deltas.put(batch, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
