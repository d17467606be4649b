"""Laws of the shards, and the mix against its targets and an exact search."""

import itertools
import random
import zlib
from collections import Counter

import pytest

from cvegrid.llm import mixing, ring

SCHEMA = "doc_id bigint, text string, source string"
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("rows", "shards", "slack"), [(0, 3, 0), (1, 24, 0), (1000, 24, 0), (999, 7, 0.1), (50, 1, 0)])
def test_allot(rows, shards, slack):
    pick = random.Random(rows)
    counts = Counter(pick.randrange(ring.CELLS) for _ in range(rows))
    counts.update({7: rows})
    pieces = ring.allot(counts, shards, slack)
    taken, used = Counter(), Counter()
    for cell, first, end, shard, slot in pieces:
        assert first < end and used[shard] == slot
        taken.update({(cell, rank): 1 for rank in range(first, end)})
        used[shard] += end - first
    assert set(taken.values()) <= {1} and len(taken) == sum(counts.values())
    assert all(used[s] <= b for s, b in enumerate(ring.bounds(sum(counts.values()), shards, slack)))


def walked(counts, shards, slack, nodes_per_shard):
    """Shard of every row, row by row: each goes clockwise from its place to the first node with room."""
    nodes, room = ring.ring(shards, nodes_per_shard), ring.bounds(sum(counts.values()), shards, slack)
    rows = [(cell, rank) for cell in sorted(counts) for rank in range(counts[cell])]
    shard_of, waiting, start = {}, [], 0
    for turn in range(2):
        for place, shard in nodes:
            own = []
            if turn == 0:
                while start < len(rows) and rows[start][0] <= place:
                    own.append(rows[start])
                    start += 1
            queue, waiting = own + waiting, []
            for row in queue:
                if room[shard] > 0:
                    room[shard] -= 1
                    shard_of[row] = shard
                else:
                    waiting.append(row)
            # Those that came from further back have waited longer.
            waiting = [r for r in waiting if r not in set(own)] + [r for r in waiting if r in set(own)]
        waiting += rows[start:] if turn == 0 else []
        start = len(rows)
    assert not waiting
    return shard_of


@pytest.mark.parametrize(("rows", "shards", "slack", "nodes"), [(400, 9, 0, 4), (400, 60, 0, 1), (300, 5, 0.2, 16), (90, 200, 0, 2)])
def test_allot_against_a_walk_row_by_row(rows, shards, slack, nodes):
    pick = random.Random(rows + shards)
    counts = Counter(pick.randrange(ring.CELLS) for _ in range(rows))
    counts[ring.CELLS - 1] += 25
    counts[77] += 40
    found = {}
    for cell, first, end, shard, _ in ring.allot(counts, shards, slack, nodes):
        found |= {(cell, rank): shard for rank in range(first, end)}
    assert found == walked(counts, shards, slack, nodes)


def test_every_shard_stands_on_the_ring():
    nodes = ring.ring(20_000, 1)
    assert {shard for _, shard in nodes} == set(range(20_000)) and nodes == sorted(nodes, key=lambda n: n[0])
    counts = Counter(random.Random(1).randrange(ring.CELLS) for _ in range(20_000))
    pieces = ring.allot(counts, 2000, nodes_per_shard=1)
    assert sum(end - first for _, first, end, _, _ in pieces) == 20_000


def test_shards(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    found = ring.op8_bounded_ring(spark, SF).collect()
    assert len(found) == len(texts)
    sizes = Counter(r["shard"] for r in found)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, many in sizes.items():
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(many))
    for r in found:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
    grown = ring.place(spark.read.parquet(f"{SF}/documents.parquet"), 25).collect()
    before = {r["doc_id"]: r["shard"] for r in found}
    assert sum(before[r["doc_id"]] != r["shard"] for r in grown) < 0.15 * len(found)


def test_shard_cases(spark):
    rows = [(None, None, None), (None, "x", "a"), (3, "y", "a"), (3, "y", "a"), (4, "", None)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cell", "2 AS size", "3 AS rank")
    found = ring.place(frame, 2).collect()
    assert Counter(r["shard"] for r in found) in (Counter({0: 3, 1: 2}), Counter({0: 2, 1: 3}))
    assert ring.place(frame.where("false"), 24).count() == 0


@pytest.mark.parametrize("sizes", [[], [0], [0, 0], [5], [100, 1, 1, 100], [7] * 9, [10**12, 3, 0, 5]])
def test_targets(sizes):
    found = mixing.targets(sizes)
    assert len(found) == len(sizes)
    assert sum(found) == pytest.approx(1.5 * sum(sizes))
    assert all(t <= 2 * s + 1e-9 for t, s in zip(found, sizes, strict=True))
    free = {round(t / mixing.WEIGHTS[k % 3], 6) for k, (t, s) in enumerate(zip(found, sizes, strict=True)) if t < 2 * s}
    assert len(free) <= 1


def test_knapsack_is_exact():
    pick = random.Random(1)
    for _ in range(60):
        lengths = pick.sample(range(1, 30), 4)
        unused = [pick.randrange(4) for _ in lengths]
        budget = pick.randrange(80)
        taken = mixing.knapsack(lengths, unused, budget)
        sums = {
            s for many in itertools.product(*(range(u + 1) for u in unused))
            if (s := sum(n * m for n, m in zip(lengths, many, strict=True))) <= budget
        }
        assert all(t <= u for t, u in zip(taken, unused, strict=True))
        assert sum(n * t for n, t in zip(lengths, taken, strict=True)) == max(sums)


def test_fit(monkeypatch):
    pick = random.Random(2)
    for limit in (mixing.KNAPSACK, 100):
        monkeypatch.setattr(mixing, "KNAPSACK", limit)
        lengths = sorted(pick.sample(range(1, 3000), 400))
        counts = [pick.randrange(1, 9) for _ in lengths]
        size = sum(n * c for n, c in zip(lengths, counts, strict=True))
        for share in (0, 0.3, 1, 1.7, 2):
            passes, extra = mixing.fit(lengths, counts, share * size)
            assert all(0 <= e <= c for e, c in zip(extra, counts, strict=True))
            taken = passes * size + sum(n * e for n, e in zip(lengths, extra, strict=True))
            assert abs(taken - share * size) <= 100 and passes + (sum(extra) > 0) <= 2


@pytest.mark.parametrize(
    ("lengths", "counts", "target", "taken"),
    [
        # What a long document leaves is filled with short ones.
        ([10, 1_000_000], [150_000, 1], 1_250_000, 1_250_000),
        ([3, 7, 900_000], [90_000, 90_000, 1], 890_000, 890_000),
        ([3, 7, 900_000], [90_000, 90_000, 1], 2_690_000, 2_690_000),
        ([0, 10, 500_000, 2_000_000], [5, 100_000, 2, 1], 1_999_990, 1_999_990),
        # Only two of the long ones add up.
        ([300_000, 400_000], [2, 1], 600_000, 600_000),
        # All short documents are taken and the long one doesn't fit.
        ([10, 1_000_000], [20_000, 1], 600_000, 200_000),
    ],
)
def test_fit_fills_what_long_documents_leave(lengths, counts, target, taken):
    passes, extra = mixing.fit(lengths, counts, target)
    assert all(0 <= e <= c for e, c in zip(extra, counts, strict=True))
    size = sum(n * c for n, c in zip(lengths, counts, strict=True))
    assert passes * size + sum(n * e for n, e in zip(lengths, extra, strict=True)) == taken


def test_mix(spark):
    found = mixing.op10_subset_sum_mix(spark, SF).collect()
    again = mixing.op10_subset_sum_mix(spark, SF).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()
    source = {r["doc_id"]: r["source"] for r in documents}
    names = sorted(set(source.values()))
    words = Counter()
    for r in documents:
        words[r["source"]] += len(r["text"].split())
    aims = dict(zip(names, mixing.targets([words[n] for n in names]), strict=True))
    taken = Counter()
    for r in found:
        name = source[r["doc_id"]]
        assert r["source_size"] == words[name] and r["target"] == aims[name] and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[name] += r["taken"]
    assert all(abs(taken[n] - aims[n]) <= 3 for n in names)


def test_mix_cases(spark):
    rows = [(None, None, None), (None, "a b", "x"), (3, "a b c", "x"), (3, "a b c", "x"), (5, "a " * 7, None), (6, "a", "=")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS size", "2 AS rows")
    found = mixing.mix(frame).collect()
    assert len(found) == len(rows)
    assert {(r["source"], r["_mix_source_size"]) for r in found} == {("x", 8), (None, 7), ("=", 1)}
    mixed = mixing.mixed(frame)
    assert mixed.columns == frame.columns and mixed.count() == sum(r["_mix_times"] for r in found)
    assert mixing.mix(frame.where("false")).count() == 0
