"""Base figures against plain Python, and the verdicts against the labels."""

import re
from collections import Counter

from cvegrid.llm import quality as ql

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string"


def figures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e a b c d e", "x " * 40, "a\n\na\n \na b\na b", "#*$ %&| <> ü€😀", "a b c d e f " * 3,
    "\x0ba\x0cb\rc d", "l1 w w w w w\nl1 w w w w w", "word word x", "z " * 5000 + "end",
]


def test_figures(spark):
    rows = list(enumerate(TEXTS)) + [(None, "one two"), (3, "one")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n_words", "2 AS hashes")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = ql.measured(frame).select("text", *[f"_quality.{n}" for n in names]).collect()
    assert len(found) == len(rows)
    for row in found:
        assert tuple(row)[1:] == figures(row["text"]), row["text"]


def test_fit_tells_the_classes(spark):
    prose = "Das ist ein ganz gewöhnlicher Satz mit vielen Wörtern, und er geht noch weiter als {} und {}. "
    junk = " ".join(f"W{i}*** X{i}### Y{i}&&&" for i in range(20))
    rows = [(i, prose.format(i, i + 1) + "Noch eine Zeile, die anders ist.") for i in range(60)]
    rows += [(100 + i, junk.replace("W", f"Q{i}")) for i in range(12)] + [(200, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"] for r in ql.keep_good(frame).collect()}
    assert kept == set(range(60))
    assert ql.keep_good(frame).columns == frame.columns


def test_empty(spark):
    assert ql.keep_good(spark.createDataFrame([], SCHEMA)).count() == 0


def test_registered(spark):
    sf = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    texts = dict(documents.select("doc_id", "text").collect())
    found = {r["doc_id"]: r for r in ql.op5_weak_supervision(spark, sf).collect()}
    assert len(found) == len(texts)
    for doc_id, row in found.items():
        own = figures(texts[doc_id])
        assert tuple(row)[1:6] == own
        assert row["base_failed"] == (own[0] < 10 or 100 * own[4] > 20 * own[0])
        assert not (row["kept"] and row["base_failed"])
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    clean = [found[r["doc_id"]] for r in labels if r["quality"] == 1]
    junk = [found[r["doc_id"]] for r in labels if r["quality"] == 0]
    assert all(r["kept"] for r in clean if not r["base_failed"])
    assert sum(not r["kept"] for r in junk) >= 0.95 * len(junk)
