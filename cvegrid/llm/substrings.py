"""Suffix-array removal of repeated byte strings by threshold-bounded interval expansion.

Stretches of text that may share a string meet in one task (see `passages`).  Their suffixes are
sorted by as many bytes as the threshold asks for, which gives the Burrows-Wheeler transform.
Starting from the interval of all suffixes, intervals are extended backwards breadth first: all
intervals of strings of one length give those of strings one longer, by their preceding bytes.
Where a new interval ends in the sorted order, the common prefix of the two suffixes there is
exactly the current length, so common prefixes come by increasing value, and the expansion stops
at the threshold: places without a value share at least that many bytes.

Defined cases: a null text is empty; texts shorter than the threshold lose nothing; repeated rows of one doc_id and text are one document; an empty table
gives an empty result.  See `passages` for order and ties.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages
from .shared import table

LENGTH = 100
# Bytes of the run whose hash makes an anchor.
SPAN = 20


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by at least their first `depth` symbols.

    The first symbols are compared as one number; from then on the order of what follows, once
    or twice as far on, doubles or triples the length that is told apart, among those suffixes
    only that are still alike.  Behind the end stand zeros.
    """
    many = len(symbols)
    # As many places in one key as 63 bits hold.
    further = 2 if (many + 1) ** 3 < 1 << 63 else 1
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    known = 63 // bits
    numbers = np.zeros(many, np.int64)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(known, np.int64)])
    for at in range(known):
        numbers = numbers << bits | padded[at : at + many]
    order = np.argsort(numbers)
    # A suffix's rank is the place of the first one that is like it so far.
    slots, keys = np.arange(many), numbers[order]
    rank = np.zeros(many, np.int64)
    while True:
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        alone = new & np.concatenate([new[1:], [True]])
        slots = slots[~alone]
        if known >= depth or not len(slots):
            return order
        members = order[slots]
        keys = rank[members]
        for step in range(1, further + 1):
            behind = members + step * known
            after = np.where(behind < many, rank[np.minimum(behind, many - 1)] + 1, 0)
            keys = keys * (many + 1) + after
        turn = np.argsort(keys)
        order[slots], keys = members[turn], keys[turn]
        known *= further + 1


def common_prefixes(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of each sorted suffix with the one before it, -1 where it is `least` or more."""
    many = len(order)
    # Where each sorted suffix stands once its own first symbol is gone, and the way back: where
    # the one that is longer by the preceding symbol stands.
    forward = np.argsort(symbols[order - 1], kind="stable")
    backward = np.empty(many, np.int64)
    backward[forward] = np.arange(many)
    leading = symbols[order]
    prefixes = np.full(many + 1, -1, np.int32)
    prefixes[0] = prefixes[many] = 0
    starts, ends = np.array([0]), np.array([many])
    of = np.zeros(many, np.int32)
    for length in range(least):
        sizes = ends - starts
        total = int(sizes.sum())
        if not total:
            break
        members = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
        of[members] = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        if 8 * total > many:
            longer = np.zeros(many, bool)
            longer[backward[members]] = True
            reached = np.flatnonzero(longer)
        else:
            reached = np.sort(backward[members])
        owner, symbol = of[forward[reached]], leading[reached]
        # One interval for each preceding symbol of each interval.
        edge = np.flatnonzero((owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1]))
        firsts = reached[np.concatenate([[0], edge + 1])]
        lasts = reached[np.concatenate([edge, [total - 1]])] + 1
        new = prefixes[lasts] < 0
        prefixes[lasts[new]] = length
        if length == 0:
            # The last interval ends with the table, which has its value already.
            new |= lasts == many
        starts, ends = firsts[new], lasts[new]
    return prefixes[:many]


def repeated_strings(stretches: list[bytes], _groups: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each stretch the ranges covered by strings that also start earlier in the list."""
    if len(stretches) < 1:
        return []
    sizes = np.array([len(s) for s in stretches])
    # Symbol 0 stands behind every stretch and in no text.
    symbols = np.zeros(int(sizes.sum()) + len(stretches), np.uint16)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    inside = np.ones(len(symbols), bool)
    inside[begins + sizes] = False
    symbols[inside] = np.frombuffer(b"".join(stretches), np.uint8).astype(np.uint16) + 1
    order = suffix_order(symbols, length)
    prefixes = common_prefixes(symbols, order, length)
    owner = np.repeat(np.arange(len(stretches)), sizes + 1)
    whole = (begins + sizes)[owner] - np.arange(len(symbols)) >= length
    # Sorted neighbours that share the whole length are one class; its first start is kept.
    class_of = np.cumsum(prefixes >= 0) - 1
    usable = whole[order]
    place, class_of = order[usable], class_of[usable]
    if not len(place):
        return [[] for _ in stretches]
    edges = np.flatnonzero(np.concatenate([[True], class_of[1:] != class_of[:-1]]))
    first = np.minimum.reduceat(place, edges)
    later = np.sort(place[place != np.repeat(first, np.diff(np.concatenate([edges, [len(place)]])))])
    cuts = np.searchsorted(later, np.concatenate([begins, [len(symbols)]]))
    return [
        passages.runs(later[a:b] - begin, length)
        for begin, a, b in zip(begins.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
    ]


def _cut(text: str, ranges: list[tuple[int, int]], copy: bool, length: int = LENGTH):
    data = text.encode()
    if copy and len(data) >= length:
        ranges = [(0, len(data))]
    kept, at = [], 0
    for first, end in ranges:
        kept.append(data[at:first])
        at = end
    kept.append(data[at:])
    return b"".join(kept), len(data), sum(end - first for first, end in ranges), len(ranges)


def without_repeated_strings(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows without their text, with its remaining bytes and how much was removed.

    Added columns: kept_bytes, n_bytes, n_removed, n_spans.
    """
    return passages.cut_repeats(
        documents,
        text,
        passages.Unit(words=False, length=LENGTH, span=SPAN),
        repeated_strings,
        _cut,
        "kept_bytes binary, n_bytes bigint, n_removed bigint, n_spans bigint",
    )


def op6_interval_expansion(spark, sf_dir: str) -> DataFrame:
    """What is left of every whole document's bytes."""
    found = without_repeated_strings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
