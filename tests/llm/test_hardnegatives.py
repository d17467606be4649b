"""Hard negatives against scoring every pair, and their SQL twin."""

import math

import numpy as np
import pytest

from checks.compare import compare, connect
from cvegrid.llm import hardnegatives as hn
from cvegrid.llm.twins import ORACLES

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def usable(rows):
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        yield vec_id, [math.floor(256 * x) for x in vector], (label + 1) % 10 if vec_id % 7 == 0 else label


def brute(rows):
    held = list(usable(rows))
    for n, (anchor, vector, label) in enumerate(held):
        if anchor % 50:
            continue
        scored = [
            (-sum(x * y for x, y in zip(vector, other)), vec_id, own)  # noqa: B905  the shorter one ends in zeros
            for m, (vec_id, other, own) in enumerate(held)
            if m != n
        ]
        scored.sort()
        for minus, positive, own in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 50 * -minus <= -100 * s[0] <= 95 * -minus]
            for rank, (score, negative, _) in enumerate(fits[:3], 1):
                yield anchor, positive, rank, negative, -minus, -score


def mined(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS score", "1 AS `row`", "2 AS place")
    return sorted(tuple(r) for r in hn.mine(frame, **options).collect())


@pytest.mark.parametrize("together", [(8192, 2048), (37, 3)])
def test_random_rows(spark, together):
    rng = np.random.default_rng(5)
    rows = [(int(n), rng.normal(0, 0.2, 6).tolist(), int(n) % 3) for n in range(300)]
    # Ties, repeated rows, an anchor that comes twice, zero and short vectors.
    rows += [(n, [0.25, 0.0, 0.0, 0.0, 0.0, 0.0], n % 2) for n in range(400, 460)]
    rows += [(450, [0.25, 0.5], 1), (450, [0.25, 0.5], 1), (500, [0.0] * 6, 2), (550, [], 2), (11, [1.0], 4)]
    rows_together, anchors_together = together
    found = mined(spark, rows, rows_together=rows_together, anchors_together=anchors_together)
    assert found == sorted(brute(rows)) and len(found) > 50


def test_blocks_meet_whatever_their_partitions(spark):
    rng = np.random.default_rng(6)
    rows = [(int(n), rng.normal(0, 0.2, 6).tolist(), int(n) % 3) for n in range(300)]
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        assert mined(spark, rows, rows_together=37, anchors_together=3) == sorted(brute(rows))
    finally:
        spark.conf.set(setting, before)


def test_left_out_rows_and_large_components(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2), (2, [1.0, 1.0], 3), (3, None, 2), (4, [1.0, None], 2)]
    rows += [(5, [math.nan, 1.0], 2), (6, [math.inf, 1.0], 2), (None, [1.0, 2.0], 2), (8, [1.0, 2.0], None)]
    rows += [(50, [3e6, 1.0], 1), (51, [3e6, 1.5], 1), (52, [2.7e6, 2.0], 5), (53, [2.7e6, 2.0], 5)]
    # Sums beyond the whole numbers of a double.
    rows += [(100, [2.0**22, 3.0], 6), (101, [2.0**22, 1.0], 6), (102, [2.0**22 * 0.9, 1 / 256], 7), (103, [2.0**22 * 0.9, 0.0], 8)]
    found = mined(spark, rows)
    assert found == sorted(brute(rows))
    assert {row[0] for row in found} >= {50, 100}
    assert mined(spark, [(None, None, None)]) == [] and mined(spark, []) == []


def test_reading_stops_early():
    rng = np.random.default_rng(3)
    matrix = np.floor(rng.normal(0, 50, (4000, 4)))
    lists = hn.SortedLists(matrix)
    scored = 0

    def counted(rows, anchor, bound, real=lists.scores):
        nonlocal scored
        scored += len(rows)
        return real(rows, anchor, bound)

    lists.scores = counted
    anchor = np.array([40.0, -90.0, 3.0, 10.0])
    (best,) = lists.best(anchor, [(-math.inf, math.inf)], 5)
    every = matrix @ anchor
    order = np.lexsort((np.arange(4000), -every))[:5]
    assert best == [(int(r), int(every[r])) for r in order]
    assert scored < 2000


def test_twin(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(hn.op13_threshold_negatives(spark, sf), connect(sf), ORACLES["op13_threshold_negatives"]) is None
