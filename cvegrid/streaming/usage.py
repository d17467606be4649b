"""Streaming usage counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cvegrid import schemas
from cvegrid.operators.merge import add_usage
from cvegrid.operators.metering import usage_daily
from cvegrid.sources.tables import VersionedTable
from cvegrid.streaming.deltas import DeltaFolder


def usage_deltas(spark: SparkSession, path: str) -> DeltaFolder:
    return DeltaFolder(spark, path, schemas.USAGE)


def stream_usage_daily(events: DataFrame, deltas: DeltaFolder, checkpoint: str) -> StreamingQuery:
    """Daily counters of each micro-batch as additive deltas.

    Counting is a sum, so late events need no watermark and are never dropped: they add to
    their own day in whatever batch they arrive.  No state outlives a batch.
    """

    def count(batch: DataFrame, number: int) -> None:
        deltas.put(usage_daily(batch), number)

    return (
        events.writeStream.foreachBatch(count)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_usage_windows(
    events: DataFrame, deltas: DeltaFolder, checkpoint: str, lateness: str = "7 days"
) -> StreamingQuery:
    """Daily counters kept as the stream's state, in event-time windows under a watermark.

    A day stays open until events `lateness` past its end have been seen; until then late events
    are added to it, afterwards they are dropped and its state is freed, so the state covers open
    days only.  Every batch puts out the new totals of the days it changed (update mode), which
    replace earlier ones: see ``latest_usage``.  What a run read less what was
    added to the totals is what came too late: see ``events_seen``.
    """
    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).observe("events", F.count(F.lit(1)).alias("seen"))
    days = seen.withWatermark("ts", lateness).groupBy("user_identifier", F.window("ts", "1 day").alias("day"))
    counted = days.agg(
        F.count(F.lit(1)).alias("query_count"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    ).select("user_identifier", F.to_date("day.start").alias("query_date"), "query_count", "input_tokens", "output_tokens")
    return (
        counted.writeStream.outputMode("update")
        .foreachBatch(lambda batch, number: deltas.put(batch, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_usage(deltas: DeltaFolder) -> DataFrame:
    """Totals of every user and day from a windowed stream: those of the last batch that changed them."""
    totals = ["query_count", "input_tokens", "output_tokens"]
    last = F.max_by(F.struct(*totals), "batch_id").alias("_last")
    return deltas.read().groupBy("user_identifier", "query_date").agg(last).select("user_identifier", "query_date", "_last.*")


def events_seen(query: StreamingQuery) -> int:
    """Events that the batches of a run have read, of the progress reports that Spark keeps."""
    rows = [p["observedMetrics"].get("events") for p in query.recentProgress]
    return sum(row["seen"] for row in rows if row)


def current_usage(stored: DataFrame | None, deltas: DeltaFolder) -> DataFrame:
    """Stored counters plus the deltas that aren't folded into them yet."""
    held = None if stored is None else stored.agg(F.max("folded_batch")).first()[0]
    through = -1 if held is None else held
    fresh = deltas.read().where(F.col("batch_id") > through).drop("batch_id")
    base = fresh.where(F.lit(False)) if stored is None else stored.drop("folded_batch")
    return add_usage(base, fresh)


def fold_usage(table: VersionedTable, deltas: DeltaFolder) -> int:
    """Write the counters with all deltas added as the table's next version.

    The batch folded last stands in the same version as the sums, so no delta counts twice
    whenever a fold is broken off or repeated.
    """
    stored = table.read() if table.version() is not None else None
    last = deltas.read().agg(F.max("batch_id")).first()[0]
    return table.write(current_usage(stored, deltas).withColumn("folded_batch", F.lit(last).cast("bigint")))
