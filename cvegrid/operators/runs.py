"""History of load runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvegrid import schemas
from cvegrid.functions.text import format_duration

RECENT_RUNS = 50


def run_status(results: Column) -> Column:
    """SUCCESS only when every step is ok."""
    return F.when(F.forall(results, lambda step: step["ok"]), "SUCCESS").otherwise("FAILED")


def run_rows(runs: DataFrame) -> DataFrame:
    """``run_at, elapsed, results`` to stored rows: status derived, elapsed in cents."""
    return runs.select(
        "run_at",
        run_status(F.col("results")).alias("status"),
        F.round("elapsed", 2).cast(schemas.RUN_SECONDS).alias("total_elapsed"),
        "results",
    )


def append_run_log(runs: DataFrame, path: str) -> None:
    """Append finished runs to the history; read with ``schemas.RUNS``, older files may hold narrower seconds."""
    run_rows(runs).write.mode("append").parquet(path)


def recent_runs(runs: DataFrame, limit: int = RECENT_RUNS) -> DataFrame:
    """The newest runs first."""
    return runs.orderBy(F.col("run_at").desc()).limit(limit)


def parse_results(text: Column) -> Column:
    """Step results stored as JSON text."""
    return F.from_json(text, f"array<{schemas.STEP}>")


def run_steps(runs: DataFrame) -> DataFrame:
    """One row per step; a failed step says only so, its raw error is never shown."""
    step = F.col("step")
    ok = F.coalesce(step["ok"], F.lit(False))
    return runs.select("run_at", "status", F.posexplode("results").alias("step_no", "step")).select(
        "run_at",
        "status",
        "step_no",
        F.coalesce(step["label"], F.lit("")).alias("label"),
        ok.alias("ok"),
        format_duration(F.coalesce(step["elapsed"], F.lit(0.0))).alias("elapsed"),
        F.when(ok, F.coalesce(step["summary"], F.lit(""))).otherwise("failed").alias("detail"),
    )
