"""Hard negatives by Fagin's threshold algorithm.

Candidates are dealt into blocks, and so are anchors; a task meets one block of each.  It sorts the
candidates once for every dimension.  For an anchor it reads all lists at the same depth, from the
large end where the anchor's component is positive and from the small end where it is negative, and
scores every row it meets for the first time over all dimensions.  The threshold is what a row would
score that has the component last read in each list: no row still unseen scores more.  Reading stops
once the threshold is strictly below the kth score of every window, or below the window itself;
strictly, because an unseen row with the same score may have the smaller id.

This runs twice: first for the best rows of the anchor's own label, whose scores then span the
windows in which rows of other labels count.  A task sends at most k rows an anchor and window; the
final ranking keeps the best of those.

Scores are exact: single or double precision where no sum can leave their whole numbers, Python's
integers else.  A score that does not fit 64 bits is refused.

Defined cases: rows without an id, label or vector, or with a null or non-finite component, take no
part; a shorter vector counts as ending in zeros, an empty one scores 0; rows may repeat an id and
then count one by one, an anchor that comes twice has its negatives twice; an anchor without another
row of its label, or whose positives score below zero, has none; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, table

POSITIVES = 5
NEGATIVES = 3
ANCHOR_EVERY = 50
# A negative scores between these hundredths of its positive.
LEAST, MOST = 50, 95
SCALE = 256

ROWS_TOGETHER = 8192
ANCHORS_TOGETHER = 2048
# Depth of the first reading; every further one doubles it.
FIRST_DEPTH = 16

# Own names for all columns, so that anchors can meet the rows they come from.
_AS_ANCHOR = {"row": "anchor", "vec_id": "anchor_id", "label": "label", "vector": "vector"}
FOUND = "anchor bigint, place int, other bigint, other_id bigint, score bigint"


class SortedLists:
    """Candidates of a block with one sorted list a dimension; rows stand in the order of their ids."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.matrix = matrix
        self.single = matrix.astype(np.float32)
        self.largest = float(np.abs(matrix).max(initial=0))
        self.order = np.argsort(matrix, axis=0, kind="stable").astype(np.int32)

    def scores(self, rows: np.ndarray, anchor: np.ndarray, bound: float) -> np.ndarray:
        """Exact inner products of some rows with the anchor."""
        if bound < 2**24:
            return (self.single[rows] @ anchor.astype(np.float32)).astype(np.float64)
        if bound < 2**53:
            return self.matrix[rows] @ anchor
        whole = [int(x) for x in anchor]
        return np.array([sum(int(x) * y for x, y in zip(self.matrix[r], whole, strict=True)) for r in rows], object)

    def best(
        self, anchor: np.ndarray, windows: list[tuple[float, float]], k: int, barred: int = -1
    ) -> list[list[tuple[int, int]]]:
        """(row, score) of the k best rows in each window, the best first, of equal scores the first row."""
        rows, width = self.matrix.shape
        bound = self.largest * float(np.abs(anchor).sum())
        seen = np.zeros(rows, bool)
        if barred >= 0:
            seen[barred] = True
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) and not len(down):
            # Without a direction every row scores 0, so one list, read to its end, is enough.
            up = np.arange(min(width, 1))
        found = [(np.empty(0, np.int64), np.empty(0, np.float64 if bound < 2**53 else object)) for _ in windows]
        depth, upto = 0, min(FIRST_DEPTH, rows)
        while depth < rows:
            if width:
                met = np.concatenate(
                    [self.order[rows - upto : rows - depth, up].ravel(), self.order[depth:upto, down].ravel()]
                )
                fresh = np.zeros(rows, bool)
                fresh[met] = True
                fresh &= ~seen
            else:
                fresh, upto = ~seen, rows
            seen |= fresh
            at = np.flatnonzero(fresh)
            score = self.scores(at, anchor, bound)
            for number, (low, high) in enumerate(windows):
                inside = (score >= low) & (score <= high)
                if inside.any():
                    all_at = np.concatenate([found[number][0], at[inside]])
                    all_score = np.concatenate([found[number][1], score[inside]])
                    first = _leading(all_at, all_score, k)
                    found[number] = all_at[first], all_score[first]
            depth = upto
            if depth >= rows or seen.all() or self._settled(anchor, up, down, depth, windows, found, k, bound):
                break
            upto = min(2 * depth, rows)
        return [[(int(r), int(s)) for r, s in zip(*pair, strict=True)] for pair in found]

    def _settled(self, anchor, up, down, depth, windows, found, k, bound) -> bool:
        """Whether the threshold lies below all that still could change a window."""
        rows = len(self.matrix)
        ends = [self.matrix[self.order[rows - depth, up], up], self.matrix[self.order[depth - 1, down], down]]
        last, by = np.concatenate(ends), np.concatenate([anchor[up], anchor[down]])
        threshold = float(last @ by) if bound < 2**53 else sum(int(x) * int(y) for x, y in zip(last, by, strict=True))
        return all(
            low > high or threshold < low or (len(score) == k and threshold < score[-1])
            for (low, high), (_, score) in zip(windows, found, strict=True)
        )


def _leading(rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; of equal ones the first rows."""
    if scores.dtype == object:
        return np.array(sorted(range(len(rows)), key=lambda n: (-scores[n], rows[n]))[:k])
    return np.lexsort((rows, -scores))[:k]


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of the given width, shorter ones filled with zeros."""
    lists = vectors.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], vectors.type)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    made = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), lengths)
    column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    made[row, column] = lists.flatten().to_numpy(zero_copy_only=False)
    return made


def _width(*sides: pa.ChunkedArray) -> int:
    return max((int(n or 0) for side in sides for n in pc.list_value_length(side).to_numpy()), default=0)


def usable(embeddings: DataFrame) -> DataFrame:
    """row, vec_id, label and whole-number vector of the rows that take part."""
    component = F.col("embedding")
    finite = F.forall(component, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & component.isNotNull() & finite
    ).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("bigint").alias("vec_id"),
        label.cast("bigint").alias("label"),
        F.transform(component, _whole).alias("vector"),
    )


def _whole(x: Column) -> Column:
    """floor(256 * x) as a double, also where it leaves the 64-bit integers."""
    scaled = x.cast("double") * SCALE
    small = F.floor(F.when(F.abs(scaled) < 2.0**53, scaled)).cast("double")
    # Doubles of this size are whole.
    return F.when(F.abs(scaled) < 2.0**53, small).otherwise(scaled)


def _meet(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int, search) -> DataFrame:
    """`search` over every block of anchors with every block of rows."""

    def dealt(frame: DataFrame, key: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        # Of one type on both sides: an int and a bigint of the same value go to different partitions.
        return frame.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        )

    keys = ["anchor_block", "row_block"]
    left = dealt(anchors, "anchor", "anchor_block", anchor_blocks, "row_block", row_blocks)
    right = dealt(rows, "row", "row_block", row_blocks, "anchor_block", anchor_blocks)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, FOUND)


def _answer(found: list[tuple]) -> pa.Table:
    schema = pa.schema(
        [("anchor", pa.int64()), ("place", pa.int32()), ("other", pa.int64()), ("other_id", pa.int64()), ("score", pa.int64())]
    )
    sides = list(zip(*found, strict=True)) if found else [[]] * len(schema)
    return pa.table([pa.array(s, f.type) for s, f in zip(sides, schema, strict=True)], schema=schema)


def _best_positives(k: int):
    def search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return _answer([])
        width = _width(anchors["vector"], rows["vector"])
        rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        matrix, labels = _matrix(rows["vector"], width), rows["label"].to_numpy()
        ids, numbers = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
        vectors, whose = _matrix(anchors["vector"], width), anchors["label"].to_numpy()
        found = []
        for label in np.unique(whose):
            own = np.flatnonzero(labels == label)
            if not len(own):
                continue
            lists = SortedLists(matrix[own])
            for a in np.flatnonzero(whose == label):
                anchor = anchors["anchor"][a].as_py()
                itself = np.flatnonzero(numbers[own] == anchor)
                barred = int(itself[0]) if len(itself) else -1
                (best,) = lists.best(vectors[a], [(-math.inf, math.inf)], k, barred)
                found += [(anchor, 0, int(numbers[own[r]]), int(ids[own[r]]), s) for r, s in best]
        return _answer(found)

    return search


def _best_negatives(k: int):
    def search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return _answer([])
        width = _width(anchors["vector"], rows["vector"])
        rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        matrix, labels = _matrix(rows["vector"], width), rows["label"].to_numpy()
        ids, numbers = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
        vectors, whose = _matrix(anchors["vector"], width), anchors["label"].to_numpy()
        windows = anchors["windows"].to_pylist()
        found = []
        for label in np.unique(whose):
            other = np.flatnonzero(labels != label)
            if not len(other):
                continue
            lists = SortedLists(matrix[other])
            for a in np.flatnonzero(whose == label):
                anchor = anchors["anchor"][a].as_py()
                spans = [(w["low"], w["high"]) for w in windows[a]]
                for window, best in zip(windows[a], lists.best(vectors[a], spans, k), strict=True):
                    found += [(anchor, window["place"], int(numbers[other[r]]), int(ids[other[r]]), s) for r, s in best]
        return _answer(found)

    return search


def _ranked(found: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other_id", "other")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine(
    embeddings: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    every: int = ANCHOR_EVERY,
    least: int = LEAST,
    most: int = MOST,
    rows_together: int = ROWS_TOGETHER,
    anchors_together: int = ANCHORS_TOGETHER,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores of every hard negative.

    Blocks hold about the given numbers of rows and anchors, whatever the size of the table.
    """
    rows = stored(usable(embeddings), "hard-negative-rows")
    anchors = rows.where(F.col("vec_id") % every == 0).select(
        *[F.col(own).alias(name) for own, name in _AS_ANCHOR.items()]
    )
    row_blocks = max(1, math.ceil(rows.count() / rows_together))
    anchor_blocks = max(1, math.ceil(anchors.count() / anchors_together))
    met = _meet(rows, anchors.drop("anchor_id"), row_blocks, anchor_blocks, _best_positives(positives))
    best = stored(_ranked(met, ["anchor"], positives, "positive_place"), "hard-negative-positives").select(
        "anchor", "positive_place", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    # In whole numbers: least * p <= 100 * n <= most * p; no room if p is negative.
    score = F.col("positive_score").cast("decimal(20,0)")
    windows = (
        best.where("positive_score >= 0")
        .groupBy("anchor")
        .agg(
            F.collect_list(
                F.struct(
                    F.col("positive_place").alias("place"),
                    F.ceil(score * least / 100).cast("bigint").alias("low"),
                    F.floor(score * most / 100).cast("bigint").alias("high"),
                )
            ).alias("windows")
        )
    )
    asked = anchors.drop("anchor_id").join(windows, "anchor")
    near = _meet(rows, asked, row_blocks, anchor_blocks, _best_negatives(negatives))
    ranked = _ranked(near, ["anchor", "place"], negatives, "rank")
    return (
        ranked.join(best.withColumnRenamed("positive_place", "place"), ["anchor", "place"])
        .join(anchors.select("anchor", "anchor_id"), "anchor")
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("other_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


def op13_threshold_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 50, from the whole table."""
    return mine(table(spark, sf_dir, "embeddings"))
