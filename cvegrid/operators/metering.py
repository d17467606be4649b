"""Per-user query metering."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Daily allowances and prices per million tokens.
DAILY_LIMIT = 20
ADMIN_DAILY_LIMIT = 100_000
INPUT_PRICE = 3.00
OUTPUT_PRICE = 15.00


def usage_daily(events: DataFrame) -> DataFrame:
    """Count and token sums per user and day."""
    return events.groupBy("user_identifier", F.to_date("ts").alias("query_date")).agg(
        F.count("*").alias("query_count"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )


def usage_cost(input_tokens: Column, output_tokens: Column, input_price: float, output_price: float) -> Column:
    """Price in dollars; both prices are per million tokens."""
    million = F.lit(1_000_000.0)
    return input_tokens / million * F.lit(input_price) + output_tokens / million * F.lit(output_price)


def usage_stats(
    usage: DataFrame,
    as_of: datetime.date,
    input_price: float = INPUT_PRICE,
    output_price: float = OUTPUT_PRICE,
) -> DataFrame:
    """Per user: queries today, in 7 and 30 days, all-time tokens and their cost."""
    day = F.col("query_date")

    def queries_since(days_back: int) -> Column:
        recent = day >= F.lit(as_of - datetime.timedelta(days=days_back))
        return F.coalesce(F.sum(F.when(recent, F.col("query_count"))), F.lit(0))

    today = F.coalesce(F.sum(F.when(day == F.lit(as_of), F.col("query_count"))), F.lit(0))
    stats = usage.groupBy("user_identifier").agg(
        today.alias("queries_today"),
        queries_since(6).alias("queries_7d"),
        queries_since(29).alias("queries_30d"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )
    cost = usage_cost(F.col("input_tokens"), F.col("output_tokens"), input_price, output_price)
    return stats.withColumn("est_cost", cost).orderBy(F.col("queries_30d").desc(), "user_identifier")


def over_limit(
    events: DataFrame,
    limit: int = DAILY_LIMIT,
    admins: DataFrame | None = None,
    admin_limit: int = ADMIN_DAILY_LIMIT,
) -> DataFrame:
    """Each query with its number within the user's day and whether it was allowed.

    A user may hold a third of all events, so no window spans a user's day.  Events are
    numbered inside a user's minute, and each minute starts at the sum of the day's earlier
    minutes.  That running sum is over at most 1,440 rows per user and day.  Users in
    ``admins`` have ``admin_limit`` instead.
    """
    day, minute = F.to_date("ts"), F.date_trunc("minute", "ts")
    placed = events.withColumns({"query_date": day, "_minute": minute})
    slot = ["user_identifier", "query_date", "_minute"]
    earlier = (
        Window.partitionBy("user_identifier", "query_date").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        placed.groupBy(*slot)
        .agg(F.count("*").alias("_n"))
        .select(*slot, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    allowance = F.lit(limit)
    if admins is not None:
        # Joined to the per-minute counts, not to the events, so a busy user stays small here.
        elevated = admins.select("user_identifier", F.lit(True).alias("_admin")).distinct()
        starts = starts.join(elevated, "user_identifier", "left")
        allowance = F.when(F.col("_admin"), F.lit(admin_limit)).otherwise(allowance)
    starts = starts.withColumn("_allowance", allowance.cast("bigint"))
    inside = F.row_number().over(Window.partitionBy(*slot).orderBy("ts", "event_id"))
    return (
        placed.withColumn("_inside", inside)
        .join(starts, slot)
        .withColumn("query_no", F.col("_start") + F.col("_inside"))
        .withColumn("allowed", F.col("query_no") <= F.col("_allowance"))
        .select(*events.columns, "query_date", "query_no", "allowed")
    )
