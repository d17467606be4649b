"""The manifest against a tree built and folded node by node, and its SQL twin."""

import hashlib
import zlib

import pytest

from checks.compare import compare, connect
from cvegrid.llm import merkle as mk
from cvegrid.llm.twins import ORACLES

SCHEMA = "doc_id bigint, text string, source string, lang string, n_chars bigint"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, more=0):
    count = None if row["n_chars"] is None else row["n_chars"] + more
    values = [row["doc_id"], row["source"], row["lang"], count, row["text"]]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests):
    """Root, and for each leaf its siblings from below: (digest, whether it stands left) or None."""
    ways, level = [[] for _ in digests], [(d, [n]) for n, d in enumerate(digests)]
    while len(level) > 1:
        runs = [level[n : n + 2] for n in range(0, len(level), 2)]
        for run in runs:
            for side, (_, members) in enumerate(run):
                other = (run[1 - side][0], side == 1) if len(run) == 2 else None
                for member in members:
                    ways[member].append(other)
        level = [(digest(*[d for d, _ in run]), [m for _, ms in run for m in ms]) for run in runs]
    return level[0][0], ways


def brute(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda lang: (lang is not None, (lang or "").encode()))
    groups = []
    for lang in langs:
        own = [r for r in rows if r["lang"] == lang]
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        groups.append((own, *tree([leaf(r) for r in own])))
    root, upper = tree([subroot for _, subroot, _ in groups])
    for (own, subroot, ways), end in zip(groups, upper, strict=True):
        for row, way in zip(own, ways, strict=True):
            told = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            at = leaf(row, int(told))
            for step in way + end:
                at = digest(at) if step is None else digest(step[0], at) if step[1] else digest(at, step[0])
            proof = digest(*[s[0] for s in way + end if s])
            yield row["doc_id"], leaf(row), subroot, root, proof, at, at == root


def same(frame, rows):
    got = sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)
    assert got == sorted(brute(rows), key=str)


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(None, "a", "x", "en", None), (None, "a", "x", "en", 3), (1, "", "y", None, 0), (1, "", "y", None, 0)]
    rows += [(2, None, None, "", 5), (3, "q" * 5000, "é", "fr", 2**63 - 1), (4, "one", "z", "äö", 1)]
    rows += [(n, f"t{n}", "s", "de", n) for n in range(21)] + [(7, "other", "s", "de", None)]
    names = ["doc_id", "text", "source", "lang", "n_chars"]
    return spark.createDataFrame([dict(zip(names, r, strict=True)) for r in rows], SCHEMA)


def test_cases(cases):
    more = cases.selectExpr("*", "1 AS tree", "'x' AS leaf", "2 AS pos", "'y' AS subroot", "0 AS place")
    same(mk.manifest(more), cases.collect())


def test_one_row_and_none(spark, cases):
    one = cases.where("lang = 'äö'")
    (row,) = mk.manifest(one).collect()
    # Without siblings the leaf is the root and the proof is empty.
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == digest()
    same(mk.manifest(one), one.collect())
    assert mk.manifest(cases.where("false")).collect() == []


def test_several_steps_and_copies_of_targets(spark, monkeypatch):
    monkeypatch.setattr(mk, "STEP_BITS", 2)
    monkeypatch.setattr(mk, "MEET_BITS", 1)
    rows = spark.range(300).selectExpr(
        "id AS doc_id", "'t' || id AS text", "'s' AS source",
        "CASE WHEN id % 3 > 0 THEN 'de' ELSE 'l' || id % 11 END AS lang", "id AS n_chars",
    )
    same(mk.manifest(rows), rows.collect())


def test_twin(spark):
    sf = "/root/testdata/sf0.001"
    found = mk.op12_pointer_jumping(spark, sf)
    assert compare(found, connect(sf), ORACLES["op12_pointer_jumping"]) is None
    same(found, spark.read.parquet(f"{sf}/documents.parquet").collect())
