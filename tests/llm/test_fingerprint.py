"""Digests against a second count of the triplets, and the neighbours against a plain loop."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from cvegrid.llm import fingerprint as fp

SCHEMA = "doc_id bigint, text string"


def counted(data):
    found = Counter()
    for salt, (near, far) in enumerate(fp.SPREADS):
        for i in range(len(data) - far):
            one = [np.array([data[i + k]], np.uint32) for k in (0, near, far)]
            found[int(fp._mixed(*one, salt)[0])] += 1
    return found


def test_counts_and_pieces(monkeypatch):
    data = "Ein Text, der lang genug ist – mit Umlauten äöü.".encode() * 5
    expected = counted(data)
    assert fp.bucket_counts(data).tolist() == [expected[b] for b in range(fp.BUCKETS)]
    monkeypatch.setattr(fp, "PIECE", 7)
    assert fp.bucket_counts(data).tolist() == [expected[b] for b in range(fp.BUCKETS)]


def test_likeness_is_bounded():
    codes = [fp.digest(t) for t in (b"", b"a", b"the quick brown fox " * 9, bytes(range(256)) * 40)]
    for one in codes:
        assert fp.likeness(one, one) == 1
        for other in codes:
            assert 0 <= fp.likeness(one, other) == fp.likeness(other, one) <= 1
    lowest, highest = "00" + "00" * 64, "ff" + "ff" * 64
    assert fp.difference(lowest, highest) == fp.MOST


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    found = []
    for n, (doc_id, text) in enumerate(rows):
        own, following = text or "", rows[(n + 1) % len(rows)][1] or ""
        changed = fp.edited(own, following).encode()
        code, changed_code = fp.digest(own.encode()), fp.digest(changed)
        near_next = fp.likeness(code, fp.digest(following.encode()))
        digest = hashlib.sha256(changed).hexdigest()
        found.append((doc_id, len(own), digest, code, changed_code, fp.likeness(code, changed_code), near_next))
    return sorted(found, key=str)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(5, "only one document here")],
        [(None, None), (None, "x" * 50), (3, "abc"), (3, "abc"), (3, ""), (2**62 + 1, "ü" * 30), (-4, "long " * 200)],
        [(i * 37 % 101, f"document {i} " * (i % 9)) for i in range(101)],
    ],
)
def test_neighbours(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS block", "2 AS turn")
    assert sorted(map(tuple, fp.neighbours(frame).collect()), key=str) == expected(rows)


def test_registered_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = fp.op1_quartile_digest(spark, sf).collect()
    assert sorted(map(tuple, found), key=str) == expected(rows)
    assert all(r["near_edited"] > r["near_next"] for r in found)


def test_fingerprints_column(spark):
    frame = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None)], SCHEMA)
    codes = [r["fingerprint"] for r in fp.fingerprints(frame).orderBy("doc_id").collect()]
    assert codes[0] == codes[1] == fp.digest(b"a b c") and codes[2] == fp.digest(b"")
