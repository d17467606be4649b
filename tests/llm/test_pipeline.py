"""The stages of the pipeline against plain Python, each on its own input."""

import hashlib
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from cvegrid.llm import mixing, quality
from cvegrid.llm.shared import stored

from .test_jaccard import brute
from .test_passages import sequences

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(stored(stage(spark, steps[-1], SF), name))
    for frame in steps[:-1]:
        assert frame.dtypes == docs.dtypes
    raw, good, single, cut, mixed, final = [frame.collect() for frame in steps]
    measures = quality.measured(docs.select("doc_id", "text"))
    verdicts = quality.judged(measures, quality.fit(measures)).where("_quality_kept").collect()
    assert {r["doc_id"] for r in good} == {r["doc_id"] for r in verdicts}
    groups = brute([(r["doc_id"], r["text"]) for r in good], corpus_pipeline.SHINGLE, corpus_pipeline.HUNDREDTHS)
    assert sorted(r["doc_id"] for r in single) == sorted({top for _, top in groups.values()})
    kept = sequences([(r["doc_id"], r["text"]) for r in single])
    assert len(cut) == len(single)
    for r in cut:
        assert " ".join(WORD.findall(r["text"])) == kept[r["doc_id"]][2] and r["n_chars"] == len(r["text"])
    sizes = Counter()
    for r in cut:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    names = sorted(sizes)
    aims = dict(zip(names, mixing.targets([sizes[n] for n in names]), strict=True))
    taken = Counter()
    for r in mixed:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    smallest = min(len(WORD.findall(r["text"])) for r in cut)
    assert all(aims[n] - 300 <= taken[n] <= aims[n] + smallest for n in names)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in cut}
    assert Counter(r["doc_id"] for r in final) == Counter(r["doc_id"] for r in mixed)
    for r in final:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 0 and "ids" in found.columns


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
