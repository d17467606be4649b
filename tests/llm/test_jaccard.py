"""Components against all pairs, and the tree against a look at every point."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cvegrid.llm import counttree, jaccard
from cvegrid.llm.shared import batch_of, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string"
CAPITALS = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, shingle=4, hundredths=85):
    sets = {}
    for doc_id, text in rows:
        words = WORD.findall((text or "").translate(CAPITALS))
        whole = {tuple(words)} if 0 < len(words) < shingle else set()
        sets[doc_id] = whole or {tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    holders = defaultdict(list)
    for doc_id in sorted(sets):
        shared = Counter()
        for shingle in sets[doc_id]:
            shared.update(holders[shingle])
            holders[shingle].append(doc_id)
        for other, both in shared.items():
            if 100 * both >= hundredths * (len(sets[doc_id]) + len(sets[other]) - both):
                a, b = root(doc_id), root(other)
                up[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def near_copies(pick):
    rows = []
    for size in (4, 10, 40, 100, 300, 700, 1500):
        base = [f"w{pick.randrange(5000)}" for _ in range(size)]
        for _ in range(40):
            words = list(base)
            for _ in range(pick.randrange(max(2, size // 12))):
                at = pick.randrange(len(words))
                if pick.random() < 0.5:
                    words[at] = f"x{pick.randrange(9999)}"
                elif len(words) > 1:
                    del words[at]
            rows.append(" ".join(words))
    rows += [None, "", "a b", "A b", "Ä b", "ä b", "a b c", "a b c d", "a b c d"]
    pick.shuffle(rows)
    return list(enumerate(rows, -5))


def common_line(pick):
    line = " ".join(f"c{i}" for i in range(20))
    return [(i, " ".join(f"v{pick.randrange(300)}" for _ in range(pick.randrange(10, 60))) + " " + line) for i in range(300)]


@pytest.mark.parametrize(("make", "block"), [(near_copies, 1024), (near_copies, 8), (common_line, 16)])
def test_components(spark, monkeypatch, make, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = make(random.Random(5))
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS _at", "2 AS _label")
    found = {r["_at"]: (r["_size"], r["_label"]) for r in jaccard.component_of(frame).collect()}
    assert found == brute(rows)


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(3, text), (1, text + " more"), (2, "other"), (2, "other"), (7, None), (None, text), (8, "")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 7, 8, None]


def test_shared_ids_are_linked(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, one), (1, other), (2, one), (3, other), (4, "else")]
    found = {r["_at"]: r["_label"] for r in jaccard.component_of(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4}


def brute_at(rows, shingle, hundredths):
    """The smallest id reached, by a look at all pairs."""
    sets = {}
    for at, text in rows:
        words = WORD.findall((text or "").translate(CAPITALS))
        runs = {tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)}
        sets[at] = runs or ({tuple(words)} if words else set())
    label = {at: at for at in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= hundredths * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {at: low if of == high else of for at, of in label.items()}
    return {at: (len(sets[at]), label[at]) for at in sets}


@pytest.mark.parametrize("block", [1024, 8])
def test_components_of_other_shingles(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(random.Random(6))
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {r["_at"]: (r["_size"], r["_label"]) for r in jaccard.component_of(frame, shingle=5, hundredths=80).collect()}
    assert found == brute_at(rows, 5, 80)


def test_pipeline_links_from_four_fifths_of_five_words(spark):
    base = [f"w{i}" for i in range(500)]
    few, many = list(base), list(base)
    # 11 isolated words leave 441 of 551 five-word shingles, 12 leave 436 of 556.
    for k in range(12):
        many[20 + 40 * k] = f"y{k}"
        if k < 11:
            few[20 + 40 * k] = f"x{k}"
    alone = [f"v{i}" for i in range(500)]
    other = [f"y{i}" if i % 40 == 20 and i < 480 else w for i, w in enumerate(alone)]
    short = [f"s{i}" for i in range(52)]
    rows = [(1, base), (2, few), (3, alone), (4, other), (5, short), (6, [*short[:25], "t", *short[26:]])]
    frame = spark.createDataFrame([(n, " ".join(words)) for n, words in rows], SCHEMA)
    kept = corpus_pipeline.ngram_jaccard_join(spark, frame, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]
    # The query keeps its own.
    assert len({r["_label"] for r in jaccard.component_of(frame).collect()}) == 6


@pytest.mark.parametrize("hundredths", [70, 80, 85, 90])
def test_cells_meet_at_the_least_similarity(hundredths):
    pick = np.random.default_rng(3)
    for size in [*range(1, 40), 127, 128, 159, 160, 255, 256, 319, 320, 511, 512, 640, 1023, 1280, 5000]:
        for _ in range(20):
            whole = np.unique(pick.integers(0, 2**63, size, np.uint64) << np.uint64(1))
            part = np.sort(whole[pick.permutation(size)[: -(-hundredths * size // 100)]])
            assert len(np.intersect1d(jaccard.cells(whole, hundredths), jaccard.cells(part, hundredths)))


def test_texts_without_an_id_of_their_own(spark):
    def text(name):
        return " ".join(f"{name}{i}" for i in range(40))

    lowest = -(1 << 63)
    rows = [(None, text("a")), (None, text("b")), (None, text("b") + " more"), (None, text("c")), (5, text("d")), (5, text("e"))]
    rows += [(6, text("a")), (7, text("e") + " more"), (8, text("c") + " more"), (9, text("f")), (lowest, text("g"))]
    frame = spark.createDataFrame(rows, SCHEMA)
    kept = Counter((r["doc_id"], r["text"][0]) for r in jaccard.one_of_each(frame).collect())
    assert kept == Counter([(None, "a"), (None, "b"), (None, "c"), (5, "d"), (5, "e"), (9, "f"), (lowest, "g")])
    found = Counter((r["_at"], r["_label"]) for r in jaccard.component_of(frame).collect())
    # Of the rows without id, the text of 6 and the one like 8 are known by those; the two of b have none.
    assert found == Counter({(None, 6): 1, (None, None): 2, (None, 8): 1, (5, 5): 2, (6, 6): 1, (7, 5): 1, (8, 8): 1, (9, 9): 1, (lowest, lowest): 1})


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.component_of(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0


@pytest.mark.parametrize("hundredths", [85, 80])
def test_similar_sets_share_a_cell(hundredths):
    pick = np.random.default_rng(1)
    for size in [*range(1, 40), 63, 64, 100, 220, 255, 256, 300, 511, 512, 700, 1100, 5000]:
        for _ in range(20):
            one = np.unique(pick.integers(0, 2**63, size, np.uint64) << np.uint64(1))
            lost = int(pick.integers(0, size // 5 + 1))
            gained = int(pick.integers(0, size // 5 + 1))
            other = np.unique(np.concatenate([one[pick.permutation(len(one))[lost:]], pick.integers(0, 2**63, gained, np.uint64)]))
            both = len(np.intersect1d(one, other))
            if 100 * both >= hundredths * (len(one) + len(other) - both):
                assert len(np.intersect1d(jaccard.cells(one, hundredths), jaccard.cells(other, hundredths)))


def test_tree():
    pick = np.random.default_rng(2)
    points = pick.integers(0, 4, (400, counttree.GROUPS)).astype(np.int32)
    points[100:200] = points[0] + (pick.random((100, counttree.GROUPS)) < 0.05)
    tree = counttree.CountTree(points)
    found = set(zip(*(side.tolist() for side in tree.near(points, 85)), strict=True))
    shared = np.minimum(points[:, None], points[None]).sum(-1)
    sizes = points.sum(1)
    wanted = 185 * shared >= 85 * (sizes[:, None] + sizes[None])
    assert found == set(zip(*(side.tolist() for side in np.nonzero(wanted)), strict=True))


def test_packing():
    tokens = np.array([0, 1 << 24, (1 << 64) - 1], np.uint64)
    assert jaccard.unpacked(jaccard.packed(tokens)).tolist() == [0, 1, (1 << 40) - 1]


def test_repeated_cells_across_batches():
    """Rows whose cell occurs once go, wherever batches begin, empty batches included."""
    pick = random.Random(7)
    for _ in range(200):
        cells = sorted(pick.randrange(12) for _ in range(pick.randrange(20)))
        rows = [(cell, owner) for owner, cell in enumerate(cells)]
        cuts = sorted(pick.randrange(len(rows) + 1) for _ in range(pick.randrange(5)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        found = jaccard._repeated(batch_of(part, jaccard.CELL_ROWS) for part in parts)
        often = Counter(cells)
        assert [row for batch in found for row in rows_of(batch)] == [r for r in rows if often[r[0]] > 1]


def test_clusters_stay_within_their_group():
    """What one group leaves doesn't grow together with what another one leaves through a set that both have."""
    pick = np.random.default_rng(4)
    points = [pick.integers(20, 30, counttree.GROUPS).astype("<i4") for _ in range(3)]
    near = [[points[0], points[0] + 1], [points[0] + 1, points[0] + 2], [points[0], 9 * points[1]], [points[2], points[2]]]
    # Of group, label, side and text; the last group has one label.
    who = [[(1, 11, 0, 1), (1, 12, 0, 2)], [(2, 12, 0, 2), (2, 13, 0, 3)], [(3, 11, 0, 1), (3, 14, 0, 4)], [(4, 15, 0, 5), (4, 15, 0, 6)]]
    rows = [(*one, point.astype("<i4").tobytes()) for group, found in zip(who, near, strict=True) for one, point in zip(group, found, strict=True)]
    columns = [pa.array(side) for side in zip(*rows, strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, names=["_group", "_label", "_side", "_at", "_point"])
    bunches = defaultdict(set)
    for made in jaccard._narrowing(85)([batch]):
        for bunch, label, at, size in rows_of(made):
            assert size > 0 and label == at + 10
            bunches[bunch].add(at)
    assert sorted(map(sorted, bunches.values())) == [[1, 2], [2, 3]]


def test_possible_clusters():
    pick = np.random.default_rng(8)
    points = pick.integers(0, 4, (300, counttree.GROUPS)).astype(np.int32)
    for start in (100, 200):
        points[start : start + 50] = points[start] + (pick.random((50, counttree.GROUPS)) < 0.05)
    labels = pick.integers(0, 200, 300).tolist()
    found = counttree.possible(points, labels, 85)
    shared, sizes = np.minimum(points[:, None], points[None]).sum(-1), points.sum(1)
    near = 185 * shared >= 85 * (sizes[:, None] + sizes[None])
    near &= np.array(labels)[:, None] != np.array(labels)[None]
    least = np.arange(300)
    for _ in range(300):
        least = np.minimum(least, np.where(near, least[None], 300).min(1))
    assert found.tolist() == np.where(near.any(1), least, -1).tolist()


def kept_rows(monkeypatch):
    """Rows of all that the join stores, by name."""
    rows, old = Counter(), jaccard.Scratch.stored

    def stored(self, frame, name):
        found = old(self, frame, name)
        rows[name] += found.count()
        return found

    monkeypatch.setattr(jaccard.Scratch, "stored", stored)
    return rows


def test_cells_of_the_same_texts_count_once(spark, monkeypatch):
    rows = kept_rows(monkeypatch)
    words = [f"w{i}" for i in range(600)]
    other = [f"x{i}" if i % 300 == 7 else word for i, word in enumerate(words)]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "else")], SCHEMA)
    assert {r["_at"]: r["_label"] for r in jaccard.component_of(frame).collect()} == {1: 1, 2: 1, 3: 3}
    assert rows["join-members"] == 2


def test_common_tokens_bring_no_sets_together(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", (20, 40, 80))
    counted = kept_rows(monkeypatch)
    line = " ".join(f"c{i}" for i in range(30))
    rows = [(i, " ".join(f"v{i}-{k}" for k in range(60)) + " " + line) for i in range(100)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(5)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {r["_at"]: (r["_size"], r["_label"]) for r in jaccard.component_of(frame).collect()}
    assert found == brute(rows)
    # The five pairs meet by their own words.
    assert counted["join-sets"] == 10


@pytest.mark.parametrize("hundredths", [85, 80])
def test_similar_sets_share_a_cell_whatever_is_listed(hundredths):
    pick = np.random.default_rng(9)
    for size in [*range(1, 40, 3), 64, 100, 255, 256, 511, 700, 1100, 5000]:
        for _ in range(20):
            one = np.unique(pick.integers(0, 2**63, size, np.uint64) << np.uint64(1))
            other = np.sort(one[pick.permutation(len(one))[: -(-hundredths * len(one) // 100)]])
            listed = np.sort(one[pick.random(len(one)) < pick.random()])
            common = listed, pick.integers(1, 4, len(listed)).astype(np.uint8)
            mine, theirs = (jaccard.cells(tokens, hundredths, common) for tokens in (one, other))
            assert len(np.intersect1d(mine, theirs))


def test_tokens_are_counted_over_all_batches(monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTED", 12)
    texts = ["a b c d e", "a b c d f", "a b c d e", "g h i j k", "a b c d k", "x g h i j", "a b c d y", "a b c d z", "y a b c d"]
    batches = [batch_of([(n, n, text)], "_id bigint, _at bigint, _text string") for n, text in enumerate(texts)]
    found = [row for batch in jaccard._measured(4)(batches) for row in rows_of(batch)]
    assert [row[:3] for row in found if row[4] is None] == [(n, n, 2) for n in range(len(texts))]
    sums = Counter()
    for row in found:
        if row[4] is not None:
            sums[row[4]] += row[5]
    token = lambda text: int(jaccard.shingles(text).view(np.int64)[0])
    # Of equal sets one counts; the last two are counted after the others.
    assert sums == {token("a b c d"): 6, token("g h i j"): 2}
