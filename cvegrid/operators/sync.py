"""Incremental loads: date windows from a high-water mark and the two-phase sync."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvegrid.operators.merge import MergeReport, keep_vector, merge_keep_vector, merge_landed
from cvegrid.sources.keyed import KeyedStore

WINDOW_DAYS = 120
SECONDS_PER_DAY = 86400


def max_watermarks(vulns: DataFrame) -> DataFrame:
    return vulns.agg(F.max("last_modified").alias("max_modified"), F.max("published").alias("max_published"))


def _seconds_between(start: Column, end: Column) -> Column:
    """Exact seconds between two wall-clock moments, whatever the session time zone."""
    return (end - start).cast("interval second").cast("decimal(18,6)")


def sync_windows(high_water: Column, now: Column, days: int = WINDOW_DAYS) -> Column:
    """Consecutive windows from the high-water mark to ``now`` as an array of structs.

    Neighbours share an endpoint, the last window is cut at ``now``, and a mark that is not
    before ``now`` gives no window.
    """
    start, end = high_water.cast("timestamp_ntz"), now.cast("timestamp_ntz")
    step = F.make_dt_interval(F.lit(days))
    microsecond = F.lit(Decimal("0.000001"))
    last = F.floor((_seconds_between(start, end) - microsecond) / (days * SECONDS_PER_DAY)).cast("int")
    indexes = F.when(start < end, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        indexes,
        lambda i: F.struct(
            (start + step * i).alias("window_start"),
            F.least(start + step * (i + 1), end).alias("window_end"),
        ),
    )


def phase_windows(vulns: DataFrame, now: Column, days: int = WINDOW_DAYS, since: Column | None = None) -> DataFrame:
    """Windows of both phases; an empty store has none.  ``since`` replaces both marks."""
    marks = max_watermarks(vulns).where(F.col("max_modified").isNotNull())
    published = since if since is not None else F.col("max_published")
    modified = since if since is not None else F.col("max_modified")
    phases = F.array(
        F.struct(F.lit("published").alias("phase"), sync_windows(published, now, days).alias("windows")),
        F.struct(F.lit("modified").alias("phase"), sync_windows(modified, now, days).alias("windows")),
    )
    return (
        marks.select(F.explode(phases).alias("p"))
        .select("p.phase", F.posexplode("p.windows").alias("window_no", "w"))
        .select("phase", "window_no", "w.window_start", "w.window_end")
    )


def window_hits(moment: Column, start: Column, now: Column, days: int = WINDOW_DAYS) -> Column:
    """In how many windows a moment lies; a shared endpoint belongs to both neighbours."""
    at, first, end = (c.cast("timestamp_ntz") for c in (moment, start, now))
    inside = (at >= first) & (at <= end) & (first < end)
    on_edge = (_seconds_between(first, at) % (days * SECONDS_PER_DAY) == 0) & (at > first) & (at < end)
    return F.when(inside, F.when(on_edge, 2).otherwise(1)).otherwise(0)


@dataclass(frozen=True)
class SyncResult:
    """Merged table and the lazily computed one-row counts."""

    table: DataFrame
    counts: DataFrame


def _hits(store: DataFrame, feed: DataFrame, now: Column, days: int, since: Column | None) -> DataFrame:
    """Feed rows in a window of either phase, with the number of windows that hold them."""
    # Scalar subqueries: each mark is one value, computed once and inlined in the filter.
    stored_modified = store.agg(F.max("last_modified")).scalar()
    stored_published = store.agg(F.max("published")).scalar()
    published = stored_published if since is None else F.when(stored_published.isNotNull(), since)
    modified = stored_modified if since is None else F.when(stored_modified.isNotNull(), since)
    return feed.withColumns(
        {
            "_new": window_hits(F.col("published_at"), published, now, days),
            "_changed": window_hits(F.col("modified_at"), modified, now, days),
        }
    ).where((F.col("_new") > 0) | (F.col("_changed") > 0))


@dataclass(frozen=True)
class StoreSync:
    """Window hits of both phases, records synced, and what the merge did."""

    new: int
    modified: int
    distinct_synced: int
    merge: MergeReport

    @property
    def synced(self) -> int:
        return self.new + self.modified


def sync_store(
    store: KeyedStore, feed: DataFrame, now: Column, days: int = WINDOW_DAYS, since: Column | None = None
) -> StoreSync:
    """``incremental_sync`` of a keyed store: the feed is read once, and only touched parts are rewritten.

    The hits are landed with their window counts; what is counted and what is merged comes from
    there.  Columns of the feed that the store has not, besides the two moments, are refused.
    """
    base = store.version()
    hits = _hits(store.read(["published", "last_modified"], version=base), feed, now, days, since)
    own = [c for c in hits.columns if c not in ("_new", "_changed", "published_at") and c in store.types]
    unknown = set(feed.columns) - set(own) - {"published_at", "modified_at"}
    if unknown:
        raise ValueError(f"the stored table has no columns {sorted(unknown)}")
    landed, touched = store.land(hits.select(*own, "_new", "_changed"))
    counts = landed.agg(
        F.coalesce(F.sum("_new"), F.lit(0)).alias("new"),
        F.coalesce(F.sum("_changed"), F.lit(0)).alias("modified"),
        F.count(F.lit(1)).alias("distinct_synced"),
    ).first()
    report = merge_landed(store, landed.drop("_new", "_changed"), touched, base, keep_vector())
    return StoreSync(counts["new"], counts["modified"], counts["distinct_synced"], report)


def incremental_sync(
    store: DataFrame,
    feed: DataFrame,
    now: Column,
    days: int = WINDOW_DAYS,
    since: Column | None = None,
) -> SyncResult:
    """Bring the store up to date from a feed of shaped rows.

    ``feed`` has the stored columns plus the moments ``published_at`` and ``modified_at``.
    Phase one takes rows published since the newest stored publication, phase two rows
    modified since the newest stored modification.  A row in both phases counts in both, as
    callers expect; ``distinct_synced`` gives the number of records.  The feed holds an id
    at most once, so both phases carry the same row and one merge serves them.
    """
    hits = _hits(store, feed, now, days, since)
    counts = hits.agg(
        F.coalesce(F.sum("_new"), F.lit(0)).alias("new"),
        F.coalesce(F.sum("_changed"), F.lit(0)).alias("modified"),
        F.count("*").alias("distinct_synced"),
    ).withColumn("synced", F.col("new") + F.col("modified"))
    incoming = hits.drop("_new", "_changed", "published_at", "modified_at")
    return SyncResult(merge_keep_vector(store, incoming, ["cve_id"]), counts)
