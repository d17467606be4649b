"""Mixing sources to target weights by subset sums over document lengths.

Every source gets a share of the budget by its weight, no more than twice its words.  Whole
passes over a source fill its target as far as they go.  For the rest, its documents are
counted by their exact length in words, and the number of documents to repeat is chosen for
each length: first the same part of every length, then one more of each length in seeded order,
and both again over the lengths that still fit, until at most KNAPSACK words are left or no length
fits (documents longer than KNAPSACK enter first, by a programme in coarser units), then a
bounded-knapsack dynamic programme that comes as near to what is left as sums of the
unused lengths can.  Which documents of a length are taken
is decided by a seeded hash, so reruns agree.

What is gathered is small: one row a source on the driver, and one row for each length of a
source in the task that fits it; the number of lengths is bounded by the longest document, not
by the number of documents.  Documents of one length and source are ranked in 64 parts by hash,
so that a length that a third of all rows share is not ranked in one task.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a source of its
own, last; a source without words has target 0; rows that repeat are separate rows; an empty
table gives an empty result; in `mix`, all columns are kept and may have any names but those
that begin with `_mix_`.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, table, whole_text, word_count

# Fixed by the contract.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST_TIMES = 2
KNAPSACK = 1 << 17
PART_BITS = 6
SEED = 42


def targets(sizes: Sequence[int], weights: Sequence[int] = WEIGHTS, budget: float = BUDGET) -> list[float]:
    """Words each source shall give; sizes in order of the sources, weights repeat over them."""
    given = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), budget * sum(sizes)
    while open_:
        whole = sum(weights[k % len(weights)] for k in open_)
        share = {k: left * weights[k % len(weights)] / whole for k in open_}
        above = [k for k in open_ if share[k] > MOST_TIMES * sizes[k]]
        for k in above or open_:
            given[k] = float(MOST_TIMES * sizes[k]) if above else share[k]
        if not above:
            break
        left -= sum(given[k] for k in above)
        open_ = [k for k in open_ if k not in set(above)]
    return given


def knapsack(lengths: Sequence[int], unused: Sequence[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum is as large as the budget allows."""
    taken = [0] * len(lengths)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    # The lot that first reached each sum; a lot is a power of two of documents of one length.
    by = np.full(budget + 1, -1, np.int64)
    lots: list[tuple[int, int]] = []
    for at, (length, free) in enumerate(zip(lengths, unused, strict=True)):
        many = min(free, budget // length if length else 0)
        step = 1
        while many > 0 and not reached[budget]:
            lot = min(step, many)
            weight = lot * length
            fresh = reached[:-weight] & ~reached[weight:]
            reached[weight:] |= fresh
            by[weight:][fresh] = len(lots)
            lots.append((at, lot))
            many -= lot
            step *= 2
    total = int(np.flatnonzero(reached)[-1])
    while total:
        at, lot = lots[by[total]]
        taken[at] += lot
        total -= lot * lengths[at]
    return taken


def fit(lengths: Sequence[int], counts: Sequence[int], target: float, seed: int = SEED) -> tuple[int, list[int]]:
    """Whole passes over a source, and how many documents of each length to take once more."""
    size = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if not size:
        return 0, [0] * len(lengths)
    wanted = round(target)
    passes = min(MOST_TIMES, wanted // size)
    rest = wanted - passes * size if passes < MOST_TIMES else 0
    extra = [c * rest // size for c in counts]
    rest -= sum(n * e for n, e in zip(lengths, extra, strict=True))
    order = sorted(range(len(lengths)), key=lambda k: random.Random(f"{seed}/{lengths[k]}").random())
    while rest > KNAPSACK:
        before = rest
        # Documents too long for the programme below, by one in units that it can hold.
        unit = -(-rest // KNAPSACK)
        long = [k for k in order if KNAPSACK < lengths[k] <= rest and extra[k] < counts[k]]
        most = knapsack([-(-lengths[k] // unit) for k in long], [counts[k] - extra[k] for k in long], rest // unit)
        for k, n in zip(long, most, strict=True):
            extra[k] += n
            rest -= n * lengths[k]
        for k in order:
            if rest <= KNAPSACK:
                break
            if 0 < lengths[k] <= rest and extra[k] < counts[k]:
                extra[k] += 1
                rest -= lengths[k]
        # What long documents leave is dealt again, among the lengths that still fit.
        open_ = [k for k in order if 0 < lengths[k] <= rest and extra[k] < counts[k]]
        if rest > KNAPSACK and open_:
            free = {k: counts[k] - extra[k] for k in open_}
            words = sum(lengths[k] * n for k, n in free.items())
            again = {k: n * min(rest, words) // words for k, n in free.items()}
            for k, n in again.items():
                extra[k] += n
                rest -= n * lengths[k]
        if rest == before:
            break
    # None, if more than KNAPSACK is left.
    usable = [k for k in order if 0 < lengths[k] <= rest and extra[k] < counts[k]]
    more = knapsack([lengths[k] for k in usable], [counts[k] - extra[k] for k in usable], rest if usable else 0)
    for k, n in zip(usable, more, strict=True):
        extra[k] += n
    return passes, extra


def mix(documents: DataFrame, seed: int = SEED, text: str = "text", weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """The rows with _mix_size, _mix_source_size, _mix_target and _mix_times.

    _mix_times says how often the mix takes the row: 0 to 2 times.
    """
    spark = documents.sparkSession
    spot = F.xxhash64(F.lit(seed), "doc_id")
    rows = documents.withColumns(
        {
            # A key without nulls, in which no source can look like the missing one.
            "_mix_key": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")),
            "_mix_size": word_count(F.col(text)),
            "_mix_spot": spot,
            "_mix_part": F.shiftrightunsigned(spot, 64 - PART_BITS).cast("int"),
            "_mix_tie": F.xxhash64(whole_text(text)),
        }
    )
    keys = ["_mix_key", "_mix_size", "_mix_part"]
    parts = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_mix_rows")), "mix-parts")
    sums = (
        parts.groupBy("_mix_key").agg(F.sum(F.col("_mix_size") * F.col("_mix_rows")).alias("words")).collect()
    )
    # By code point, the missing source last; one row a source.
    sums.sort(key=lambda r: (r["_mix_key"] == "", r["_mix_key"]))
    shares = targets([r["words"] for r in sums], weights)
    aims = spark.createDataFrame(
        [(r["_mix_key"], r["words"], share) for r, share in zip(sums, shares, strict=True)],
        "_mix_key string, _mix_source_size bigint, _mix_target double",
    )
    lengths = parts.groupBy("_mix_key", "_mix_size").agg(F.sum("_mix_rows").alias("rows")).join(aims, "_mix_key")

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_mix_size")
        passes, extra = fit(group["_mix_size"].tolist(), group["rows"].tolist(), group["_mix_target"].iloc[0], seed)
        return group.drop(columns="rows").assign(_mix_passes=passes, _mix_extra=extra)

    chosen = lengths.groupBy("_mix_key").applyInPandas(
        fitted,
        "_mix_key string, _mix_size bigint, _mix_source_size bigint, _mix_target double, "
        "_mix_passes bigint, _mix_extra bigint",
    )
    before = Window.partitionBy("_mix_key", "_mix_size").orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    plan = parts.withColumn("_mix_before", F.coalesce(F.sum("_mix_rows").over(before), F.lit(0))).join(
        chosen, ["_mix_key", "_mix_size"]
    )
    in_part = Window.partitionBy(*keys).orderBy("_mix_spot", "doc_id", "_mix_tie")
    again = F.row_number().over(in_part) + F.col("_mix_before") <= F.col("_mix_extra")
    return (
        rows.join(plan.drop("_mix_rows"), keys)
        .withColumn("_mix_times", (F.col("_mix_passes") + again.cast("int")).cast("int"))
        .select(*documents.columns, "_mix_size", "_mix_source_size", "_mix_target", "_mix_times")
    )


def mixed(documents: DataFrame, seed: int = SEED, text: str = "text") -> DataFrame:
    """The mix itself: rows as often as it takes them, as they came."""
    taken = mix(documents, seed, text).where("_mix_times > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("_mix_times"))).alias("_mix_copy")
    return taken.select(*documents.columns, copies).drop("_mix_copy")


def op10_subset_sum_mix(spark, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(documents).select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * F.col("_mix_times")).alias("taken"),
    )
