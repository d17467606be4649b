"""The network against place-by-place sums, its gradients, defined cases and held-out accuracy."""

import zlib

import numpy as np

from cvegrid.llm import bytenet as bn


def plain_echo(codes, place):
    for level, length in ((3, 32), (2, 16), (1, 8)):
        for period in range(1, bn.PERIODS + 1):
            first = place - length + 1
            if first - period >= 0 and all(codes[i] == codes[i - period] for i in range(first, place + 1)):
                return level
    return 0


def plain_pool(text, network):
    codes = bn.padded(text)
    levels = [plain_echo(codes, n) for n in range(len(codes))]
    best = np.full(bn.FILTERS, -np.inf)
    for start in range(len(codes) - bn.WIDTH + 1):
        places = [
            network.bytes_[w, codes[start + w]] + network.echoes_[w, levels[start + w]] for w in range(bn.WIDTH)
        ]
        best = np.maximum(best, np.sum(places, axis=0))
    return best


def some_network():
    network = bn.Network.fresh(3)
    network.echoes_[:] = np.random.default_rng(4).normal(0, 1, network.echoes_.shape)
    return network


def test_pool_covers_the_whole_text(monkeypatch):
    network = some_network()
    texts = ["", "a", "of of of of of of of of the", "naïve Häuser – " * 5, "x" * 90 + "needle" + "yz" * 40, "abcd" * 30]
    for chunk in (bn.CHUNK, 50, 7):
        monkeypatch.setattr(bn, "CHUNK", chunk)
        for text in texts:
            best, _ = bn.pool(bn.symbols(bn.padded(text)), network.filters())
            assert np.allclose(best, plain_pool(text, network), atol=1e-4), (chunk, text)


def test_weights_survive_packing():
    network = some_network()
    again = bn.Network.unpacked(network.packed())
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(network.parts(), again.parts(), strict=True))


def test_learns_and_is_repeatable():
    good = [f"plain words number {n} go here and there" for n in range(30)]
    bad = [f"plain words %%%{n} go here and there" for n in range(15)] + ["to to to to to to to to to to"] * 5
    first = bn.train(good + bad, [1] * 30 + [0] * 20, steps=150)
    second = bn.train(good + bad, [1] * 30 + [0] * 20, steps=150)
    assert first.packed() == second.packed()

    def score(text):
        return first.probability(bn.pool(bn.symbols(bn.padded(text)), first.filters())[0])

    assert all(score(t) > 0.5 for t in good) and all(score(t) < 0.5 for t in bad)


def test_cases(spark):
    rows = [(1, "good words here", 7), (2, None, 7), (3, "", 7), (None, "good words here", 7), (2, None, 7)]
    rows += [(n, f"text {n}", 7) for n in range(10, 40)] + [(5, "long " * 50_000, 7)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    labels = spark.createDataFrame(
        [(n, n % 2, "x") for n in range(10, 40)] + [(10, 1, "y"), (None, 0, "z"), (5, None, "w"), (99, 1, "v")],
        "doc_id bigint, quality int, text string",
    )
    sample = bn.fit_sample(documents, labels).collect()
    learned = {r["doc_id"]: r["quality"] for r in sample}
    assert learned == {n: n % 2 for n in range(10, 40) if zlib.crc32(str(n).encode()) % 3 != 1}
    network = bn.fit(bn.fit_sample(documents, labels), steps=5)
    found = bn.score(documents, network).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in found)
    by_id = {r["doc_id"]: r["score"] for r in found}
    assert by_id[1] == by_id[None] and by_id[2] == by_id[3]
    assert bn.fit(bn.fit_sample(documents, labels), most_bytes=0) is None
    assert {r["score"] for r in bn.score(documents, None).collect()} == {0.5}
    empty = documents.where("false")
    assert bn.fit(bn.fit_sample(empty, labels)) is None and bn.score(empty, network).collect() == []


def test_sample_is_bounded(spark):
    documents = spark.range(3000).selectExpr("id AS doc_id", "'t' || id AS text").unionByName(
        spark.range(3000).selectExpr("0 AS doc_id", "'t0' AS text")
    )
    labels = spark.range(3000).selectExpr("id AS doc_id", "1 AS quality")
    found = bn.fit_sample(documents, labels, rows=300).collect()
    assert 200 < len(found) < 400 and len({r["doc_id"] for r in found}) == len(found)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    quality = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect())
    found = bn.op11_byte_network(spark, sf).collect()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for row in found:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 3 == 1)
    kept = [(r["predicted"], quality[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in quality]
    clean, bad = [p for p, q in kept if q == 1], [p for p, q in kept if q == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(bad) <= 0.03 * len(bad)
