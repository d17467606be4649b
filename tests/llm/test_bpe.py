"""Ids and decoded texts against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cvegrid.llm import bpe

ODD = [
    "", "a", " ", "<|endoftext|>x <|ENDOFTEXT|> <|startoftext|><|endoftext|>", "\x1c \x1d a\x1fb", "Σίσυφος ΑΣ İ ẞ",
    "x" * 3000 + " don't I'LL we've", "ab" * 5000, "é ́e 가 Å", "\U00010d50Ᲊ 中文测试 日本語 ½²٣", "a b c　d",
    "In in IN iN", "\U00018fca\U000196ad letters of newer tables",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def texts():
    pick = random.Random(4)
    kinds = [(32, 127), (1, 0x500), (0x2000, 0xD7FF), (0xE000, 0x1FFFF), (32, 33)]
    made = ["".join(chr(pick.randrange(*pick.choice(kinds))) for _ in range(pick.randrange(80))) for _ in range(300)]
    return ODD + made


@pytest.mark.parametrize("piece", [bpe.PIECE, 40])
@pytest.mark.parametrize("leaves", [bpe.FOREST_LEAVES, 4])
def test_like_the_library(library, monkeypatch, piece, leaves):
    monkeypatch.setattr(bpe, "PIECE", piece)
    monkeypatch.setattr(bpe, "FOREST_LEAVES", leaves)
    monkeypatch.setattr(bpe.cut, "__defaults__", (piece,))
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    vocabulary = bpe.Vocabulary(bpe.vocabulary_file())
    given = texts()
    ids, ends = vocabulary.encode(given)
    for text, own, wanted in zip(given, np.split(ids, ends[:-1]), library.encode_batch(given, add_special_tokens=False)):
        assert own.tolist() == wanted.ids, text
        assert vocabulary.decode(own.tolist()) == library.decode(wanted.ids, skip_special_tokens=False)


def test_frames(spark, library):
    rows = [(1, "Hello hello", 5), (1, "Hello hello", 5), (None, None, None), (2, "", 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    both = bpe.decode(bpe.encode(frame)).collect()
    assert [r["ids"] for r in both] == [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]
    assert [r["decoded"] for r in both] == ["hello</w> hello</w>"] * 2 + ["", ""]
    assert bpe.encode(frame.where("false")).count() == 0


def test_registered(spark, library):
    sf = "/root/testdata/sf0.001"
    given = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    found = bpe.op3_segment_tree_bpe(spark, sf).collect()
    assert len(found) == len(given)
    for row in found:
        ids = library.encode(given[row["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_clashing_columns_are_replaced(spark):
    rows = spark.createDataFrame([(1, "the house", "old", "older")], "doc_id long, text string, ids string, decoded string")
    row = bpe.decode(bpe.encode(rows)).first()
    assert row["decoded"] == "the</w> house</w>" and len(row["ids"]) == 2 and row["doc_id"] == 1
