"""Finding repeated passages across documents: the Spark job that operators 6 and 9 share.

1. Tasks pick each text's anchors.  Anchors are counted, and those that occur once drop out.
2. A text that an earlier document has too is settled by its digest; other texts with repeated
   anchors send, for each of those, the stretch of text whose windows have that anchor.
3. Stretches with one anchor meet in one task, in document order, and a `finder` says which of
   their units lie in a window that also starts earlier.  Only distinct stretches are examined.
4. The units found are cut out of the texts.

Texts are dealt by document once and used for steps 2 and 4.  An anchor that occurs more than
HOT times sends its windows one by one, dealt by their own hash, so that the distinct content
of a group stays bounded whatever surrounds a very common passage.

A document's key is its doc_id, in an order-preserving form (null first, and no number's equal),
followed by the digest of its text.  Keys tell documents apart and order them.  Rows that agree
in both are one document and are cut alike; rows that share only an id, or have none, are dealt,
joined and examined each by its own key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import anchors
from .shared import Scratch, batch_of, rows_of, whole_text

HOT = 100_000
# Bytes of distinct stretches that are examined together.
EXAMINED = 1 << 20
# Bytes of stretches that a task keeps in mind while it sends them.
REMEMBERED = 32 << 20
# Byte at which the digest stands in a key, counted from 1, and its bytes.
DIGEST_AT, DIGEST_BYTES = 10, 16

# Stretches in document order -> for each the first and end places, from its start, to cut.
Finder = Callable[[list[bytes], list[int]], list[list[tuple[int, int]]]]


def runs(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Merge windows of a length that start at the given, ascending places."""
    if not len(places):
        return []
    breaks = np.flatnonzero(np.diff(places) > length)
    firsts = places[np.concatenate([[0], breaks + 1])]
    lasts = places[np.concatenate([breaks, [len(places) - 1]])]
    return list(zip(firsts.tolist(), (lasts + length).tolist(), strict=True))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch or overlap made one."""
    found: list[list[int]] = []
    for first, end in sorted(ranges):
        if found and first <= found[-1][1]:
            found[-1][1] = max(found[-1][1], end)
        else:
            found.append([first, end])
    return [(first, end) for first, end in found]


class Unit:
    """What windows consist of, and how stretches of it are written down."""

    def __init__(self, words: bool, length: int, span: int) -> None:
        self.words, self.length, self.span = words, length, span

    def values(self, data: bytes) -> np.ndarray:
        return anchors.word_hashes(data) if self.words else np.frombuffer(data, np.uint8)

    def anchors(self, values: np.ndarray) -> tuple[np.ndarray, ...]:
        return anchors.anchors(values, self.length, self.span)

    def stretches(self, data: bytes) -> Callable[[int, int], bytes]:
        """Function that gives the units from one place up to another."""
        if not self.words:
            return lambda first, end: data[first:end]
        starts, ends = anchors.word_ranges(data)
        # One space between words, so that equal words make equal stretches.
        spaced = anchors.WORD.findall(data)
        tight = len(data) == int((ends - starts).sum()) + max(len(starts) - 1, 0)
        if tight and data.count(b" ") == max(len(starts) - 1, 0):
            return lambda first, end: data[starts[first] : ends[end - 1]]
        return lambda first, end: b" ".join(spaced[first:end])


def _counted(unit: Unit):
    """Distinct anchors of each text with how often they occur in it."""
    shape = "_anchor bigint, _doc bigint, _times int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, times, owners = [], [], []
            for doc, text in rows_of(batch):
                hashes = unit.anchors(unit.values(text.encode()))[0]
                if len(hashes):
                    distinct, many = np.unique(hashes, return_counts=True)
                    found.append(distinct.view(np.int64))
                    times.append(many.astype(np.int32))
                    owners.append(np.full(len(distinct), doc, np.int64))
            if found:
                columns = [np.concatenate(found), np.concatenate(owners), np.concatenate(times)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_anchor", "_doc", "_times"])

    return run, shape


def _sent(unit: Unit):
    """Stretches around the repeated anchors of texts that no earlier document has.

    A stretch that the task has already sent for an earlier place need not be sent again: all of
    it is to be cut, and only that is passed on, as a row without content.  So a passage that
    very many texts hold is sent once a task, not once a text.
    """
    shape = "_group bigint, _key binary, _start bigint, _end bigint, _content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earliest: dict[bytes, tuple[bytes, int]] = {}
        remembered = 0
        for batch in batches:
            names = batch.schema.names
            key_, text_, copy_, doc_, repeated_, hot_ = (
                batch.column(names.index(n)) for n in ("_key", "_text", "_copy", "_doc", "_repeated", "_hot")
            )
            rows = []
            for n in range(batch.num_rows):
                repeated = repeated_[n].as_py()
                if not repeated or copy_[n].as_py():
                    continue
                key = key_[n].as_py()
                data = text_[n].as_py().encode()
                values = unit.values(data)
                hashes, first, last = unit.anchors(values)
                hashes = hashes.view(np.int64)
                hot = set(hot_[n].as_py() or ())
                stretch = unit.stretches(data)
                wanted: list[tuple[int, int, int]] = []
                for k in np.flatnonzero(np.isin(hashes, np.array(repeated, np.int64))).tolist():
                    group, start, end = int(hashes[k]), int(first[k]), int(last[k]) + unit.length
                    if group in hot:
                        windows = anchors.run_hashes(values[start:end], unit.length).view(np.int64).tolist()
                        wanted += [(own, place, place + unit.length) for place, own in enumerate(windows, start)]
                    else:
                        wanted.append((group, start, end))
                known = []
                for group, start, end in wanted:
                    content, here = stretch(start, end), (key, start)
                    if earliest.setdefault(content, here) < here:
                        known.append((start, end))
                        continue
                    earliest[content] = here
                    remembered += len(content)
                    rows.append((group, *here, end, content))
                rows += [(doc_[n].as_py(), key, start, end, None) for start, end in merged(known)]
                if remembered >= REMEMBERED:
                    earliest.clear()
                    remembered = 0
                if len(rows) >= 20_000:
                    yield batch_of(rows, shape)
                    rows = []
            yield batch_of(rows, shape)

    return run, shape


def _examined(finder: Finder):
    """Ranges to cut, from stretches sorted by group and document order.

    All windows of a stretch hold its anchor, each at another place, so no two of them are equal:
    a group with a single distinct stretch has nothing for the finder.
    """
    shape = "_key binary, _first bigint, _end bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        groups: list[int] = []
        whose: list[tuple[bytes, int]] = []
        size = 0

        def examine() -> pa.RecordBatch:
            found = [
                (key, start + first, start + end)
                for (key, start), cuts in zip(whose, finder(held, groups), strict=True)
                for first, end in cuts
            ]
            held.clear()
            groups.clear()
            whose.clear()
            return batch_of(found, shape)

        rows = (row for batch in batches for row in rows_of(batch))
        for number, (_, members) in enumerate(groupby(rows, key=lambda row: row[0])):
            seen: dict[bytes, tuple[bytes, int]] = {}
            waiting: list[tuple] = []
            before = None
            for _, key, start, end, content in members:
                if (key, start, end, content is None) == before:
                    continue
                before = (key, start, end, content is None)
                if content is not None and content not in seen:
                    seen[content] = (key, start)
                    continue
                # All its windows start earlier, where the first such stretch stands.
                waiting.append((key, start, end))
                if len(waiting) >= 10_000:
                    yield batch_of(waiting, shape)
                    waiting = []
            if waiting:
                yield batch_of(waiting, shape)
            if len(seen) > 1:
                held += seen
                groups += [number] * len(seen)
                whose += seen.values()
                size += sum(map(len, seen))
            if size >= EXAMINED:
                yield examine()
                size = 0
        if held:
            yield examine()

    return run, shape


def cut_repeats(documents: DataFrame, text: str, unit: Unit, finder: Finder, cut, extra: str) -> DataFrame:
    """The rows with more columns that `cut` makes of each text and the ranges to cut from it."""
    columns = documents.columns
    number = F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    order = F.coalesce(F.concat(F.lit("01"), F.lpad(F.hex(number), 16, "0")), F.lit("0" * 18))
    prepared = documents.select(
        F.unhex(F.concat(order, F.md5(whole_text(text).cast("binary")))).alias("_key"),
        whole_text(text).alias("_text"),
        F.struct(*[F.col(c) for c in columns if c != text], F.lit(0).alias("_any")).alias("_row"),
    )
    # A hash of the key is enough here: documents that shared one would also look at each
    # other's anchors, of which none is theirs.
    emit, shape = _counted(unit)
    # Stored, as they are read for the counts and again to tell each text's repeated ones.
    scratch = Scratch(documents.sparkSession)
    found = scratch.stored(prepared.select(F.xxhash64("_key").alias("_doc"), "_text").mapInArrow(emit, shape), "passage-found")
    counts = found.groupBy("_anchor").agg(F.sum("_times").alias("_total")).where("_total > 1")
    repeated = (
        found.select("_anchor", "_doc")
        .join(counts, "_anchor")
        .groupBy("_doc")
        .agg(
            F.collect_set("_anchor").alias("_repeated"),
            F.collect_set(F.when(F.col("_total") > HOT, F.col("_anchor"))).alias("_hot"),
        )
    )
    digest = F.substring("_key", DIGEST_AT, DIGEST_BYTES).alias("_digest")
    keys = prepared.select("_key").distinct().select("_key", digest, F.xxhash64("_key").alias("_doc"))
    first = keys.groupBy("_digest").agg(F.min("_key").alias("_first"))
    copies = keys.join(first, "_digest").select("_key", "_doc", (F.col("_key") != F.col("_first")).alias("_copy"))
    known = scratch.stored(copies.join(repeated, "_doc", "left"), "passage-anchors")
    scratch.keep(known)
    # Dealt once; both uses below take the same columns of it, so that Spark reuses the exchange.
    dealt = prepared.repartition("_key")
    emit, shape = _sent(unit)
    sent = dealt.join(known, "_key").mapInArrow(emit, shape)
    emit, shape = _examined(finder)
    ranges = (
        sent.repartition("_group")
        .sortWithinPartitions("_group", "_key", "_start", "_end")
        .mapInArrow(emit, shape)
        .groupBy("_key")
        .agg(F.collect_set(F.struct("_first", "_end")).alias("_ranges"))
    )
    whole = dealt.join(known.select("_key", "_copy"), "_key").join(ranges, "_key", "left")
    added = T._parse_datatype_string(extra)
    schema = T.StructType([prepared.schema["_row"], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            text_, copy_, ranges_ = (batch.column(names.index(n)) for n in ("_text", "_copy", "_ranges"))
            made = []
            for n in range(batch.num_rows):
                own = [(r["_first"], r["_end"]) for r in ranges_[n].as_py() or ()]
                made.append(cut(text_[n].as_py(), merged(own), copy_[n].as_py()))
            sides = list(zip(*made, strict=True)) if made else [()] * len(added.fields)
            arrays = [pa.array(side) for side in sides]
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("_row")), *arrays], names=["_row", *added.fieldNames()]
            )

    others = [F.col("_row").getField(c).alias(c) for c in columns if c != text]
    return whole.mapInArrow(run, schema).select(*others, *added.fieldNames())
