"""Profiles against letter-by-letter sums, and held-out accuracy."""

import zlib

import numpy as np

from cvegrid.llm import language as lg

SCHEMA = "doc_id bigint, text string, lang string"


def summed(profiles, text):
    letters = [profiles.letter(ord(c)).astype(int) for c in lg.spelled(text)]
    total = np.zeros(profiles.dimensions)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


def test_bundle(monkeypatch):
    texts = ["Der Hund, die Katze!", "", "x", "ça va 123 bien", "the cat " * 30]
    profiles = lg.Profiles(64)
    for piece in (lg.PIECE, 10):
        monkeypatch.setattr(lg, "PIECE", piece)
        found = profiles.bundle([lg.spelled(t) for t in texts], range(len(texts)), len(texts))
        for row, text in zip(found, texts, strict=True):
            assert np.array_equal(row, summed(profiles, text))


def test_cases(spark):
    rows = [(1, "der die das und", "de"), (2, "the and of to", "en"), (None, None, "fr"), (3, "123 !!", "en")]
    rows += [(4, "the and", None), (2, "the and of to", "en")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS score", "0 AS place")
    prototypes = lg.learn(frame)
    assert sorted(prototypes) == ["de", "en"]
    answers = [(r["doc_id"], r["lang_pred"]) for r in lg.predict(frame, prototypes).collect()]
    assert sorted(answers, key=str) == sorted(
        [(1, "de"), (2, "en"), (2, "en"), (3, "und"), (4, "en"), (None, "und")], key=str
    )
    assert {r["lang_pred"] for r in lg.predict(frame, {}).collect()} == {"und"}
    empty = frame.where("false")
    assert lg.learn(empty) == {} and lg.predict(empty, prototypes).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = lg.op2_hyperdimensional(spark, sf).collect()
    langs = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect())
    assert len(found) == len(langs)
    for row in found:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 3 == 1) and 0 <= row["score"] <= 1
    kept = [r for r in found if r["held_out"]]
    assert sum(langs[r["doc_id"]] == r["lang_pred"] for r in kept) >= 0.98 * len(kept)
