"""Removal of repeated phrases by sharded Aho-Corasick automata.

Stretches of words that may share a phrase meet in one task (see `passages`).  Their windows of
20 words are counted to confirm which recur; the recurring ones, as sequences of word numbers,
make an automaton; the stretches stream through it, in document order, and every occurrence but
the first of a phrase is cut.

Defined cases: a null or blank text has no words; texts of fewer than 20 words lose nothing;
repeated rows of one doc_id and text are one document; an empty table gives an empty result.
See `passages` for order and ties.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, passages
from .shared import table

LENGTH = 20
# Words of the run whose hash makes an anchor.
SPAN = 5


def recurring(sequences: list[tuple[int, ...]], length: int) -> set[tuple[int, ...]]:
    """Windows that occur twice or more."""
    sizes = np.array([len(s) for s in sequences])
    flat = np.fromiter((w for s in sequences for w in s), np.int64, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - length + 1, 0)
    starts = np.repeat(begins - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    hashes = anchors.range_hashes(flat, starts, starts + length)
    _, at, many = np.unique(hashes, return_inverse=True, return_counts=True)
    flat = flat.tolist()
    return {tuple(flat[s : s + length]) for s in starts[many[at] > 1].tolist()}


def repeated_phrases(stretches: list[bytes], _groups: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each stretch the ranges of words covered by windows that also start earlier in the list."""
    numbers: dict[bytes, int] = {}
    sequences = [tuple(numbers.setdefault(w, len(numbers)) for w in s.split(b" ")) for s in stretches]
    phrases = recurring(sequences, length)
    if not phrases:
        return [[] for _ in stretches]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for number, phrase in enumerate(phrases):
        automaton.add_word(phrase, number)
    automaton.make_automaton()
    seen: set[int] = set()
    found = []
    for sequence in sequences:
        later = []
        for last, phrase in automaton.iter(sequence):
            if phrase in seen:
                later.append(last - length + 1)
            seen.add(phrase)
        found.append(passages.runs(np.array(later, np.int64), length))
    return found


def _cut(text: str, ranges: list[tuple[int, int]], copy: bool, length: int = LENGTH):
    words = anchors.WORD.findall(text.encode())
    if copy and len(words) >= length:
        ranges = [(0, len(words))]
    kept, at = [], 0
    for first, end in ranges:
        kept += words[at:first]
        at = end
    kept += words[at:]
    removed = len(words) - len(kept)
    return b" ".join(kept).decode(), len(words), removed


def without_repeated_phrases(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows without their text, with its remaining words and how many were removed.

    Added columns: kept_text, kept words joined by one space; n_words; n_removed.
    """
    return passages.cut_repeats(
        documents,
        text,
        passages.Unit(words=True, length=LENGTH, span=SPAN),
        repeated_phrases,
        _cut,
        "kept_text string, n_words bigint, n_removed bigint",
    )


def _cut_out(text: str, ranges: list[tuple[int, int]], copy: bool, length: int = LENGTH):
    """The text itself without the words of the ranges and the white space behind them."""
    data = text.encode()
    starts, ends = anchors.word_ranges(data)
    if copy and len(starts) >= length:
        ranges = [(0, len(starts))]
    kept, at = [], 0
    for first, end in ranges:
        kept.append(data[at : starts[first]])
        at = int(starts[end]) if end < len(starts) else int(ends[-1])
    kept.append(data[at:])
    return (b"".join(kept).decode(),)


def cut_phrases(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows with repeated phrases cut from their text, which otherwise stays as it is."""
    unit = passages.Unit(words=True, length=LENGTH, span=SPAN)
    cut = passages.cut_repeats(documents, text, unit, repeated_phrases, _cut_out, f"`{text}` string")
    return cut.select(*documents.columns)


def op9_phrase_automata(spark, sf_dir: str) -> DataFrame:
    """What is left of every whole document's words."""
    found = without_repeated_phrases(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
