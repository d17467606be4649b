"""What the operators leave on disk."""

import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cvegrid.llm import jaccard, phrases, quality
from cvegrid.llm.shared import Scratch, stored
from cvegrid.sources.tables import shared_folder

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark):
    texts = ["".join(f"Wort{(i * 7 + j) % 400} steht hier " for j in range(60)) for i in range(40)]
    rows = [(i, t, "de", "web", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[3], "de", "web", 1), (None, texts[4], None, None, None), (7, None, "de", "web", 0)]
    # Pairs too far apart for one round of representatives, and rows that share an id.
    near = [(200 + i, " ".join(f"n{i // 8}x{j}" for j in range(200 + i % 8)), "en", "web", 1) for i in range(64)]
    return spark.createDataFrame(rows + near + [(200, "ganz anders " * 9, "de", "web", 1)], SCHEMA)


def left(spark, work):
    """Names of the folders that the work leaves, without their random endings."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(os.listdir(folder))
    work()
    return sorted(name[:-33] for name in set(os.listdir(folder)) - before)


@pytest.mark.parametrize(
    "work, names",
    [
        (quality.keep_good, ["quality-kept"]),
        (jaccard.one_of_each, ["join-firsts"]),
        (jaccard.component_of, ["join-rows"]),
        (phrases.cut_phrases, ["passage-anchors"]),
        (phrases.without_repeated_phrases, ["passage-anchors"]),
    ],
)
def test_only_what_the_result_reads_stays(spark, work, names):
    docs = documents(spark)
    assert left(spark, lambda: work(docs).collect()) == names


@pytest.mark.parametrize("worth", [4, 0])
def test_results_outlast_the_scratch(spark, monkeypatch, worth):
    """Both ways out of the rounds; what was deleted is not read again."""
    monkeypatch.setattr(jaccard, "WORTH", worth)
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    found = jaccard.component_of(documents(spark))
    assert sorted(map(str, found.collect())) == sorted(map(str, found.collect()))


def test_stages_leave_no_texts(spark):
    docs = documents(spark)
    size = sum(len(r["text"] or "") for r in docs.collect())

    def work():
        read = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            read = stored(stage(spark, read, None), f"test-{name}")

    names = [name for name in left(spark, work) if not name.startswith("test-")]
    assert size and names == ["join-firsts", "mix-parts", "passage-anchors", "quality-kept"]


def test_shuffle_files_go_with_the_write(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {name for name in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in name}
    before = files()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    found = stored(spark.range(100_000).groupBy(F.xxhash64("id")).count(), "test-shuffled")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert found.count() == 100_000 and spark.conf.get(key) == setting


def test_drop_and_keep(spark):
    scratch = Scratch(spark)
    one, two, three = (scratch.stored(spark.range(n), "test-kept") for n in (1, 2, 3))
    paths = [Path(path.removeprefix("file:")) for _, path in scratch.held]
    scratch.drop(one)
    assert [p.exists() for p in paths] == [False, True, True]
    scratch.keep(three)
    assert [p.exists() for p in paths] == [False, False, True] and three.count() == 3 and two is not three


def test_copies_and_nulls_find_their_verdict(spark):
    text = "Das ist ein ganz gewöhnlicher Satz mit vielen Wörtern, und er geht noch ein gutes Stück weiter."
    good = [(1, text), (1, text), (None, text)] + [(10 + i, f"{text} Der Satz {i} endet.") for i in range(30)]
    frame = spark.createDataFrame([*good, (2, None), (3, "")], "doc_id bigint, text string")
    assert sorted(map(str, map(tuple, quality.keep_good(frame).collect()))) == sorted(map(str, good))
