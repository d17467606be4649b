"""Keyed merges of an incoming batch into a stored table.

The stored side holds a key once.  A batch may repeat keys: it is reduced to one row per key
inside the merge, the last by the column named as its position.  Every merge of two frames is one
full outer join on the key, whatever the sizes: each side moves once, the batch reduced before it
moves, and a stored table that is bucketed by the key doesn't move at all.  ``merge_into`` does the
same for a keyed store and reads and writes only the parts that the batch's keys belong to.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvegrid.sources.keyed import PART, KeyedStore
from cvegrid.sources.tables import scratch_path

Rule = Callable[[Column, Column], Column]


def last_per_key(batch: DataFrame, keys: list[str], position: str | None = None) -> DataFrame:
    """One row per key: the one with the largest position, without that column.

    Rows that tie, and all rows of a key if no position is named, go by a hash of their
    values, so that the choice is the same on every evaluation.
    """
    values = [c for c in batch.columns if c not in keys and c != position]
    if not values:
        return batch.select(*keys).distinct()
    order = [F.xxhash64(*values)] if position is None else [F.col(position), F.xxhash64(*values)]
    last = F.max_by(F.struct(*values), F.struct(*[c.alias(f"_{n}") for n, c in enumerate(order)]))
    return batch.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*")


def _merge(
    current: DataFrame,
    incoming: DataFrame,
    keys: list[str],
    rules: dict[str, Rule],
    position: str | None,
    not_before: str | None = None,
) -> DataFrame:
    unknown = [c for c in incoming.columns if c not in current.columns and c != position]
    if unknown:
        raise ValueError(f"the stored table has no columns {unknown}")
    batch = last_per_key(incoming, keys, position)

    def packed(frame: DataFrame, name: str) -> DataFrame:
        values = [c for c in frame.columns if c not in keys]
        return frame.select(*keys, F.struct(*values, F.lit(True).alias("_present")).alias(name))

    old, new = F.col("_old"), F.col("_new")
    columns = []
    for field in current.schema.fields:
        # As text, the type says nothing of nulls, which a cast must not forbid.
        name, kind = field.name, field.dataType.simpleString()
        if name in keys:
            value = F.col(name)
        elif name in rules:
            value = rules[name](old, new)
        elif name in batch.columns:
            value = F.when(new["_present"], new[name].cast(kind)).otherwise(old[name])
        else:
            value = old[name]
        columns.append(value.cast(kind).alias(name))
    both = packed(current, "_old").join(packed(batch, "_new"), keys, "full_outer")
    if not_before is not None:
        # A batch row that is older than the stored one counts as absent.
        older = F.coalesce(new[not_before] < old[not_before], F.lit(False))
        both = both.withColumn("_new", F.when(~older, new))
    return both.select(*columns)


def merge_overwrite(
    current: DataFrame, incoming: DataFrame, keys: list[str], position: str | None = None
) -> DataFrame:
    """Insert new keys; an existing key takes every incoming column, NULLs included."""
    return _merge(current, incoming, keys, {}, position)


def merge_keep_vector(
    current: DataFrame,
    incoming: DataFrame,
    keys: list[str],
    vector: str = "embedding",
    position: str | None = None,
    not_before: str | None = None,
) -> DataFrame:
    """As ``merge_overwrite``, but a missing incoming vector leaves the stored one.

    With ``not_before``, a batch row whose value there is smaller than the stored row's is left out.
    """
    return _merge(current, incoming, keys, keep_vector(vector), position, not_before)


def merge_score_publication(
    current: DataFrame, incoming: DataFrame, keys: list[str], position: str | None = None
) -> DataFrame:
    """Merge one score publication.

    Current values always come from the publication, even an older one.  The stored score
    moves to the previous columns only when the publication date advances, so loading the
    same day twice changes nothing.
    """

    return _merge(current, incoming, keys, shift_previous(), position)


def shift_previous() -> dict[str, Rule]:
    """Rules that move the stored score to the previous columns when the publication date advances."""

    def previous(stored: str, kept: str) -> Rule:
        def rule(old: Column, new: Column) -> Column:
            return F.when(new["scored_at"] > old["scored_at"], old[stored]).otherwise(old[kept])

        return rule

    return {
        "previous_probability": previous("probability", "previous_probability"),
        "previous_scored_at": previous("scored_at", "previous_scored_at"),
    }


def keep_vector(name: str = "embedding") -> dict[str, Rule]:
    """Rule under which a missing incoming vector leaves the stored one."""
    return {name: lambda old, new: F.coalesce(new[name], old[name])}


@dataclass(frozen=True)
class MergeReport:
    """What a merge into a store did: its version, keys added and replaced, and the parts rewritten."""

    version: int | None
    new: int
    modified: int
    parts: tuple[int, ...]


def merge_into(
    store: KeyedStore,
    incoming: DataFrame,
    rules: dict[str, Rule] | None = None,
    position: str | None = None,
    not_before: str | None = None,
    known_only: bool = False,
) -> MergeReport:
    """Merge a batch into a keyed store and publish the touched parts as its next version.

    The batch is reduced to one row a key, evaluated and written once.  Only the parts its keys
    belong to are opened; of them only families that it has columns of, unless it brings new keys,
    which every family holds.  ``rules`` are those of the merges above.  With ``not_before`` a row
    whose value there is smaller than the stored one's is left out, with ``known_only`` one whose
    key is not stored.
    """
    unknown = [c for c in incoming.columns if c not in store.types and c != position]
    if unknown:
        raise ValueError(f"the stored table has no columns {unknown}")
    base, path = store.version(), scratch_path(store.spark, "batch")
    rows, touched = store.land(last_per_key(incoming, [store.key], position), path)
    report = merge_landed(store, rows, touched, base, rules, not_before, known_only)
    store.discard(path)
    return report


def merge_landed(
    store: KeyedStore,
    rows: DataFrame,
    touched: list[int],
    base: int | None,
    rules: dict[str, Rule] | None = None,
    not_before: str | None = None,
    known_only: bool = False,
) -> MergeReport:
    """``merge_into`` for a batch that the store has landed already, with one row a key.

    Large batches are merged some parts at a time.
    """
    marks = [F.col(not_before).alias("_stored")] if not_before else []

    def counted(parts: list[int]) -> DataFrame:
        known = store.read([store.key, *([not_before] if not_before else [])], parts, base)
        known = known.select(store.key, F.lit(True).alias("_known"), *marks)
        kept = rows.where(F.col(PART).isin(parts)).join(known, store.key, "left")
        kept = kept.withColumn("_known", F.coalesce("_known", F.lit(False)))
        if not_before:
            kept = kept.where(~F.coalesce(F.col(not_before) < F.col("_stored"), F.lit(False))).drop("_stored")
        return kept.where("_known") if known_only else kept

    counts = counted(touched).agg(F.count_if(~F.col("_known")).alias("new"), F.count_if("_known").alias("modified")).first()
    if not counts["new"] + counts["modified"]:
        return MergeReport(base, 0, 0, ())
    frames = {}
    portions = store.portions(touched, rows.count() + store.read([store.key], touched, base).count())
    for family, columns in store.families.items():
        own = [c for c in columns if c in rows.columns]
        if own or counts["new"]:
            own_rules = {c: rule for c, rule in (rules or {}).items() if c in columns}
            frames[family] = [
                _merge(store.family(family, parts, base), counted(parts).select(store.key, *own), [store.key], own_rules, None)
                for parts in portions
            ]
    version, _ = store.rewrite(frames, base)
    return MergeReport(version, counts["new"], counts["modified"], tuple(touched))


def merge_counts(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """How many distinct incoming keys are new and how many exist already; only keys are moved."""
    known = current.select(*keys, F.lit(True).alias("known"))
    joined = incoming.select(*keys).distinct().join(known, keys, "left")
    return joined.agg(
        F.count_if(F.col("known").isNull()).alias("new"), F.count_if(F.col("known")).alias("modified")
    )


def update_from_batch(
    current: DataFrame, batch: DataFrame, keys: list[str], column: str, position: str | None = None
) -> DataFrame:
    """Set one column of existing rows from a batch; unknown keys in it are ignored."""
    wanted = [*keys, column] + ([position] if position else [])
    fresh = last_per_key(batch.select(*wanted), keys, position).select(
        *keys, F.struct(column).alias("_fresh")
    )
    value = F.when(F.col("_fresh").isNotNull(), F.col("_fresh")[column]).otherwise(F.col(column))
    return current.join(fresh, keys, "left").withColumn(column, value).select(*current.columns)


def new_ids_only(candidates: DataFrame, stored: DataFrame, key: str = "cve_id") -> DataFrame:
    """Distinct candidate ids not stored yet."""
    return candidates.select(key).distinct().join(stored.select(key), key, "left_anti")


def add_usage(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Add a batch of daily counters to the stored ones: one partial and one final sum."""
    keys = ["user_identifier", "query_date"]
    counters = ["query_count", "input_tokens", "output_tokens"]
    return stored.unionByName(batch).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])
