"""Similarity join on word shingles: components of documents with enough Jaccard similarity.

The registered query takes four words a shingle and a similarity of 0.85; callers may take others.

Routing.  Tokens are hashed shingles.  By the size of its set a document belongs to a
class, and its tokens to as many cells as suit the class; sets that are similar enough differ in
few cells, so of their cells, in any order that what they hold decides, the first few must have one
in common.  Cells that hold but common tokens come last, the others in the order of their hashes.
Documents emit the first cells' hashes; no similar pair is lost, and a passage that very many
documents share does not by itself bring them together.  Which tokens are common is counted over
all documents when they are measured; a token that the list lacks costs time, not pairs.

Linking.  Documents that meet are compared by their count vectors in an R-tree (`counttree`), and
the pairs that its bound leaves are checked token by token.  It runs in three steps, so that no
group is expanded into pairs:

1. each document goes to one of the groups it is in, large groups are dealt out in blocks;
   similar documents become components;
2. as long as groups hold several components and a round joins a good share of them, one document
   of each is compared in one group;
3. what still shares a group without having met is compared wholly: first the count vectors of
   each group, large groups in blocks by size, each block only with those whose sizes allow the
   similarity; then finer vectors of what that leaves, then the sets of what those leave.  Coarse
   vectors say little of sets that are many times larger than they have groups; the finer ones do.
   What a step leaves of a group goes on as clusters of it, not as components over all groups,
   which grow into one another; clusters whose first two sets are the same are one.

Equal sets are one from the start.  Tokens are told apart by 64-bit hashes when counted and by
their first 40 bits when a pair is compared.

Defined cases: a document without words or text has an empty set and is linked with nothing; one
of fewer words than a shingle has the whole sequence as its only shingle; texts, not ids, are
compared, so rows without doc_id are linked only if their texts are similar; components also link
rows that share a doc_id, and one whose rows all lack it is null; an empty table gives an empty
result; other columns are not read.  Texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .counttree import linked, points_of, possible
from .shared import SPACES, Scratch, batch_of, rows_of, table, whole_text

# Fixed by the contract of the query.
SHINGLE = 4
HUNDREDTHS = 85
# Sets of classes below this size have a cell for every token.
CELLS_FROM = 128
BLOCK = 1024
TOKEN_BYTES = 5
# Tokens are common from so many sets on, and come the later the more of the numbers are reached.
COMMON = (256, 2048, 16_384)
# Tokens that a task counts together; those that but one of the sets among them has are left out.
COUNTED = 1 << 21
# So many tokens are listed at most, the most common ones.
LISTED = 1 << 18
# Rows of texts, and between them rows of tokens and how many sets have them.
MEASURED = "_id bigint, _at bigint, _size bigint, _digest string, _token bigint, _sets bigint"
CELL_ROWS = "_cell bigint, _at bigint"
SETS = "_at bigint, _size bigint, _set binary, _point binary"
CLUSTERS = "_bunch bigint, _label bigint, _at bigint, _size bigint"
# A round of representatives is followed by another one if it has joined one of so many.
WORTH = 4
# Groups of the count vectors that are compared before the sets of what the first ones leave.
FINE_GROUPS = 1024


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashed shingles of a text, ascending."""
    words = anchors.word_hashes((text or "").encode().lower())
    if 0 < len(words) < shingle:
        return anchors.run_hashes(words, len(words))
    return np.unique(anchors.run_hashes(words, shingle))


def _cell_bits(size_class: int, hundredths: int) -> int:
    """Bits of the number of cells: so many cells that those which may differ are not all that are filled."""
    # Differing tokens to 2 ** size_class, at most; a fifth of the cells may be empty.
    bits = size_class - 1
    while 10 * (100 - hundredths) * 2 ** (size_class - bits) > 4 * hundredths:
        bits += 1
    return bits


def _ranks(tokens: np.ndarray, common: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """How common each token is, from the listed tokens, ascending, and theirs; 0 if not listed."""
    if common is None or not len(common[0]):
        return np.zeros(len(tokens), np.uint64)
    listed, ranks = common
    at = np.searchsorted(listed, tokens)
    at[at == len(listed)] = 0
    return np.where(listed[at] == tokens, ranks[at], 0).astype(np.uint64)


def _cells(tokens: np.ndarray, ranks: np.ndarray, size_class: int, differ: int, hundredths: int) -> np.ndarray:
    """Hashes of the first cells, one more than may differ; above the hash stands how common the cell is."""
    salt = np.uint64(0x9E3779B97F4A7C15 * (size_class + 1) & (1 << 64) - 1)
    if 1 << size_class < CELLS_FROM:
        held = anchors.mixed(tokens ^ salt)
    else:
        cell = tokens >> np.uint64(64 - _cell_bits(size_class, hundredths))
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        held = anchors.mixed(np.add.reduceat(anchors.mixed(tokens ^ salt), first) + cell[first])
        # One token that is not common makes a cell that is not.
        ranks = np.minimum.reduceat(ranks, first)
    held = held >> np.uint64(3) | ranks << np.uint64(61)
    if differ + 1 < len(held):
        held = np.partition(held, differ)[: differ + 1]
    return held


def cells(
    tokens: np.ndarray, hundredths: int = HUNDREDTHS, common: tuple[np.ndarray, np.ndarray] | None = None
) -> np.ndarray:
    """Hashes under which a set can meet all sets that are similar enough, by the same list of common tokens."""
    size = len(tokens)
    if not size:
        return np.zeros(0, np.uint64)
    size_class = size.bit_length() - 1
    ranks = _ranks(tokens, common)
    # Tokens in which two sets may differ, by their sizes together.
    apart = lambda sizes: (100 - hundredths) * sizes // (100 + hundredths)
    found = [_cells(tokens, ranks, size_class, apart(size + 100 * size // hundredths), hundredths)]
    if size_class and -(-hundredths * size // 100) < 1 << size_class:
        found.append(_cells(tokens, ranks, size_class - 1, apart(2 * size), hundredths))
    return np.concatenate(found)


def packed(tokens: np.ndarray) -> bytes:
    return tokens.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // TOKEN_BYTES, 8), np.uint8)
    wide[:, 8 - TOKEN_BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, TOKEN_BYTES)
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def _often(sets: list[np.ndarray]) -> list[tuple]:
    """Rows of the tokens that several of the sets have."""
    tokens = np.concatenate(sets)
    tokens.sort()
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    many = np.diff(first, append=len(tokens))
    found = tokens[first[many > 1]].view(np.int64).tolist()
    return [(None, None, None, None, token, n) for token, n in zip(found, many[many > 1].tolist(), strict=True)]


def _measured(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        many = 0
        for batch in batches:
            rows = []
            for doc, at, text in rows_of(batch):
                tokens = shingles(text, shingle)
                digest = hashlib.md5(tokens.tobytes()).hexdigest() if len(tokens) else None
                rows.append((doc, at, len(tokens), digest, None, None))
                if digest is not None and digest not in held:
                    held[digest] = tokens
                    many += len(tokens)
                if many >= COUNTED:
                    rows += _often([*held.values()])
                    held, many = {}, 0
            yield batch_of(rows, MEASURED)
        if held:
            yield batch_of(_often([*held.values()]), MEASURED)

    return run


def _common(measured: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The common tokens, ascending, and how common each is."""
    often = measured.where("_token is not null").groupBy("_token").agg(F.sum("_sets").alias("_sets"))
    listed = often.where(F.col("_sets") >= COMMON[0]).orderBy(F.desc("_sets"), "_token").limit(LISTED).toArrow()
    tokens = listed["_token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    ranks = np.searchsorted(COMMON, listed["_sets"].to_numpy(), side="right")
    return tokens[order], ranks[order].astype(np.uint8)


def _emitted(shingle: int, hundredths: int, common: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owners, seen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], set()
            for at, text in rows_of(batch):
                # Copies that stand together say nothing more.
                if at in seen:
                    continue
                seen.add(at)
                own = cells(shingles(text, shingle), hundredths, common).view(np.int64)
                found.append(own)
                owners.append(np.full(len(own), at, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found)), pa.array(np.concatenate(owners))], names=["_cell", "_at"]
            )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by cell, those whose cell another row has too; a batch is held at a time."""
    cells_, owners, beside = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    for batch in batches:
        # The last row of the batch before waits here for the one that follows it.
        cells_ = np.concatenate([cells_, batch.column(0).to_numpy()])
        owners = np.concatenate([owners, batch.column(1).to_numpy()])
        if not len(cells_):
            continue
        same = cells_[1:] == cells_[:-1]
        first = beside if len(beside) else np.zeros(1, bool)
        before, after = np.concatenate([first, same]), np.append(same, False)
        kept = np.flatnonzero((before | after)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(cells_[kept]), pa.array(owners[kept])], names=["_cell", "_at"])
        cells_, owners, beside = cells_[-1:], owners[-1:], before[-1:]
    if len(beside) and beside[0]:
        yield pa.RecordBatch.from_arrays([pa.array(cells_), pa.array(owners)], names=["_cell", "_at"])


def _packed_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, text in rows_of(batch):
                tokens = shingles(text, shingle)
                point = points_of([unpacked(packed(tokens))])[0].astype("<i4")
                rows.append((at, len(tokens), packed(tokens), point.tobytes()))
            yield batch_of(rows, SETS)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Columns of each group of several labels, from rows sorted by group; the label is the second."""
    rows = (row for batch in batches for row in rows_of(batch))
    for _, members in groupby(rows, key=lambda row: row[0]):
        columns = list(zip(*members, strict=True))
        if len(set(columns[1])) > 1:
            yield columns


def _joining(hundredths: int):
    """Labels and what they become, from rows of group, label, side and set sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[int, int]] = []
        for _, labels, sides, held in _groups(batches):
            compared = list(sides) if len(set(sides)) > 1 else None
            found = linked([unpacked(h) for h in held], list(labels), hundredths, compared)
            made += [(label, root) for label in found.up if (root := found.root(label)) != label]
            if len(made) >= 10_000:
                yield batch_of(made, "_label bigint, _root bigint")
                made = []
        yield batch_of(made, "_label bigint, _root bigint")

    return run


def _narrowing(hundredths: int):
    """The clusters that points leave, from rows of group, label, side, text and point sorted by group.

    Cells that the same sets share leave much the same clusters, so these go by their first two sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[list[np.ndarray]] = []
        for _, labels, sides, ats, held in _groups(batches):
            points = np.frombuffer(b"".join(held), "<i4").reshape(len(held), -1)
            found = possible(points, list(labels), hundredths, list(sides) if len(set(sides)) > 1 else None)
            at = np.array(ats)
            order = np.lexsort((at, found))
            order = order[found[order] >= 0]
            if len(order):
                first = np.flatnonzero(np.diff(found[order], prepend=-1))
                pair = anchors.mixed(at[order][first].view(np.uint64)) + at[order][first + 1].view(np.uint64)
                bunch = np.repeat(anchors.mixed(pair).view(np.int64), np.diff(first, append=len(order)))
                made.append([bunch, np.array(labels)[order], at[order], points[order].sum(axis=1, dtype=np.int64)])
            if len(made) >= 1000:
                yield _clusters(made)
                made = []
        if made:
            yield _clusters(made)

    return run


def _clusters(made: list[list[np.ndarray]]) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(side)) for side in zip(*made, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["_bunch", "_label", "_at", "_size"])


def _compared(groups: DataFrame, hundredths: int) -> DataFrame:
    """(_label, _root) for labels that join others of their group; groups: _group, _label, _side, _set."""
    return (
        groups.select("_group", "_label", "_side", "_set")
        .repartition("_group")
        .sortWithinPartitions("_group", "_label")
        .mapInArrow(_joining(hundredths), "_label bigint, _root bigint")
    )


def _narrowed(groups: DataFrame, hundredths: int) -> DataFrame:
    """Bunches of what may be similar in each group by its points; groups: _group, _label, _side, _at, _point."""
    return (
        groups.select("_group", "_label", "_side", "_at", "_point")
        .repartition("_group")
        .sortWithinPartitions("_group", "_label")
        .mapInArrow(_narrowing(hundredths), CLUSTERS)
        .distinct()
    )


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(_label, _root): the smallest label that each label of the edges can reach.

    Labels take the least label next to them and then that one's own, until nothing changes.
    """
    sides = scratch.stored(
        edges.select("_label", "_root")
        .union(edges.select(F.col("_root").alias("_label"), F.col("_label").alias("_root")))
        .distinct(),
        "join-edges",
    )
    both = sides.select("_label", F.col("_root").alias("_next"))
    found = scratch.stored(
        both.groupBy("_label").agg(F.least(F.min("_next"), F.col("_label")).alias("_root")), "join-roots"
    )
    while True:
        roots = found.select(F.col("_label").alias("_next"), F.col("_root").alias("_theirs"))
        nearer = both.join(roots, "_next").groupBy("_label").agg(F.min("_theirs").alias("_least"))
        stepped = found.join(nearer, "_label").withColumn("_new", F.least("_root", "_least"))
        jumped = stepped.join(roots.withColumnRenamed("_next", "_new"), "_new").select(
            "_label", F.least("_new", "_theirs").alias("_root"), F.col("_root").alias("_before")
        )
        after = scratch.stored(jumped, "join-roots")
        scratch.drop(found)
        if after.where("_root != _before").isEmpty():
            scratch.drop(sides)
            return after.select("_label", "_root")
        found = after


def _relabelled(documents: DataFrame, roots: DataFrame) -> DataFrame:
    return (
        documents.join(roots, "_label", "left")
        .select("_at", F.coalesce("_root", "_label").alias("_label"))
    )


def _texts(documents: DataFrame, text: str) -> DataFrame:
    """(_id, _at, _text): _at tells texts apart, whatever ids their rows have."""
    return documents.select(
        F.col("doc_id").cast("long").alias("_id"), F.xxhash64(whole_text(text)).alias("_at"), whole_text(text).alias("_text")
    )


def _rooted(documents: DataFrame, text: str, shingle: int, hundredths: int, scratch: Scratch) -> DataFrame:
    """(_id, _at, _size, _root) of each row: one _root for all texts linked by similarity, null without words."""
    rows = _texts(documents, text)
    texts = rows.select("_at", "_text")
    measured = scratch.stored(rows.mapInArrow(_measured(shingle), MEASURED), "join-sizes")
    sizes = measured.where("_token is null").select("_id", "_at", "_size", "_digest")
    # Equal sets have one representative.
    some = sizes.where("_digest is not null").select("_at", "_digest").distinct()
    classes = some.groupBy("_digest").agg(F.min("_at").alias("_label"))
    same = scratch.stored(some.join(classes, "_digest").select("_at", "_label"), "join-classes")
    leaders = same.where("_at = _label").select("_at")

    # Most cells occur once.  They move once, in order, and only those beside an equal one go on.
    emitted = texts.mapInArrow(_emitted(shingle, hundredths, _common(measured)), CELL_ROWS)
    repeated = emitted.repartition("_cell").sortWithinPartitions("_cell").mapInArrow(_repeated, CELL_ROWS)
    met = scratch.stored(repeated.join(leaders, "_at", "left_semi").distinct(), "join-met")
    many = met.groupBy("_cell").agg(F.count(F.lit(1)).alias("_rows"), F.bit_xor(F.xxhash64("_at")).alias("_who"))
    # Cells that hold the same texts bring together the same pairs: one of them stands for all.
    many = many.where("_rows > 1").groupBy("_rows", "_who").agg(F.min("_cell").alias("_cell"), F.count(F.lit(1)).alias("_times"))
    members = scratch.stored(met.join(many, "_cell").select("_cell", "_at", "_rows", "_times"), "join-members")
    scratch.drop(met)

    # At home in the cell that stands for the most.
    homes = members.groupBy("_at").agg(F.min(F.struct(-F.col("_times"), "_cell", "_rows")).alias("_home"))
    homes = homes.select("_at", "_home.*").withColumn("_block", F.pmod(F.xxhash64("_at"), F.ceil(F.col("_rows") / BLOCK)))
    # Copies of a text are made one in the tasks that read them.
    each = texts.groupBy("_at").agg(F.first("_text").alias("_text"))
    sets = scratch.stored(
        each.join(homes.select("_at"), "_at", "left_semi").mapInArrow(_packed_sets(shingle), SETS),
        "join-sets",
    )
    first = sets.join(homes, "_at").select(
        F.xxhash64("_cell", "_block").alias("_group"), F.col("_at").alias("_label"), F.lit(0).alias("_side"), "_set"
    )
    start = members.select("_at").distinct().withColumn("_label", F.col("_at"))
    labels = scratch.stored(_relabelled(start, _compared(first, hundredths)), "join-labels")

    worth = True
    while True:
        placed = members.select("_cell", "_at").join(labels, "_at")
        open_ = placed.groupBy("_cell").agg(
            F.min("_label").alias("_least"), F.max("_label").alias("_most"), F.approx_count_distinct("_label").alias("_labels")
        )
        left = scratch.stored(placed.join(open_.where("_least < _most"), "_cell"), "join-left")
        if left.isEmpty():
            break
        if not worth:
            # Representatives hardly join any more: compare all that is left, then nothing is open.
            scratch.drop(members)
            whole = scratch.stored(_whole(left, sets, hundredths, scratch), "join-roots")
            if not whole.isEmpty():
                labels = scratch.stored(_relabelled(labels, components(whole, scratch)), "join-labels")
            break
        speaker = left.groupBy("_label").agg(F.min(F.struct("_cell", "_at", "_labels")).alias("_s"))
        speaker = speaker.select("_label", "_s.*").withColumn(
            "_block", F.pmod(F.xxhash64("_label"), F.ceil(F.col("_labels") / BLOCK))
        )
        groups = sets.join(speaker, "_at").select(
            F.xxhash64("_cell", "_block").alias("_group"), "_label", F.lit(0).alias("_side"), "_set"
        )
        roots = scratch.stored(_compared(groups, hundredths), "join-roots")
        joined, open_labels = roots.count(), left.agg(F.approx_count_distinct("_label")).first()[0]
        worth = WORTH * joined >= open_labels
        if joined:
            before = labels
            labels = scratch.stored(_relabelled(before, roots), "join-labels")
            scratch.drop(before)
        scratch.drop(left, roots)

    # From sets to rows: leaders carry their label, equal sets their leader's.
    reached = labels.select(F.col("_at").alias("_leader"), F.col("_label").alias("_top"))
    final = same.join(reached, same["_label"] == reached["_leader"], "left").select(
        "_at", F.coalesce("_top", "_label").alias("_root")
    )
    return sizes.join(final, "_at", "left").select("_id", "_at", "_size", "_root")


def component_of(
    documents: DataFrame, text: str = "text", shingle: int = SHINGLE, hundredths: int = HUNDREDTHS
) -> DataFrame:
    """(_at, _size, _label): each row's doc_id, set size and the smallest doc_id its links reach.

    Sets of so many words a shingle are linked from so many hundredths of Jaccard similarity.
    """
    scratch = Scratch(documents.sparkSession)
    rows = scratch.stored(_rooted(documents, text, shingle, hundredths, scratch), "join-rows")
    scratch.keep(rows)
    held = rows.where("_id is not null and _root is not null").select("_id", "_root").distinct()
    several = held.groupBy("_id").agg(F.min("_root").alias("_least"), F.max("_root").alias("_most")).where("_least < _most")
    # Rows that share an id meet through it.
    edges = scratch.stored(
        held.join(several, "_id").where("_root > _least").select(F.col("_root").alias("_label"), F.col("_least").alias("_root")),
        "join-shared",
    )
    if not edges.isEmpty():
        met = components(edges, scratch).select(F.col("_label").alias("_root"), F.col("_root").alias("_met"))
        rows = scratch.stored(
            rows.join(met, "_root", "left").select("_id", "_at", "_size", F.coalesce("_met", "_root").alias("_root")), "join-rows"
        )
    scratch.keep(rows)
    least = rows.where("_root is not null").groupBy("_root").agg(F.min("_id").alias("_label"))
    return rows.join(least, "_root", "left").select(
        F.col("_id").alias("_at"), "_size", F.when(F.col("_root").isNull(), F.col("_id")).otherwise(F.col("_label")).alias("_label")
    )


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count vectors of many groups, for (_at, _set)."""
    for batch in batches:
        rows = [
            (at, points_of([unpacked(held)], FINE_GROUPS)[0].astype("<i4").tobytes()) for at, held in rows_of(batch)
        ]
        yield batch_of(rows, "_at bigint, _point binary")


def _whole(left: DataFrame, sets: DataFrame, hundredths: int, scratch: Scratch) -> DataFrame:
    """(_label, _root) of all that shares an open cell.

    Points are compared within each cell; the clusters that the tree leaves of it are compared by
    finer points, and those that these leave token by token.  Each step drops what the later ones
    don't read, of left and sets too.
    """
    sized = left.select("_cell", "_at", "_label").join(sets.select("_at", "_size"), "_at")
    dealt = _blocks(sized.withColumnRenamed("_cell", "_bunch"), hundredths)
    maybe = scratch.stored(_narrowed(dealt.join(sets.select("_at", "_point"), "_at"), hundredths), "join-maybe")
    nothing = maybe.select("_label", F.col("_label").alias("_root")).where("false")
    if maybe.isEmpty():
        return nothing
    # The sets of what is open, once each.
    held = scratch.stored(sets.select("_at", "_set").join(maybe.select("_at").distinct(), "_at", "left_semi"), "join-held")
    scratch.drop(left, sets)
    finer = scratch.stored(held.mapInArrow(_finer, "_at bigint, _point binary"), "join-finer")
    still = scratch.stored(_narrowed(_blocks(maybe, hundredths).join(finer, "_at"), hundredths), "join-still")
    scratch.drop(maybe, finer)
    return nothing if still.isEmpty() else _compared(_blocks(still, hundredths).join(held, "_at"), hundredths)


def _blocks(members: DataFrame, hundredths: int) -> DataFrame:
    """(_group, _label, _side, _at): all that is to be compared of each _bunch, by _size.

    A bunch of up to BLOCK rows is one group.  A larger one is cut into bands, twelve to a
    doubling of the size, and these into parts; any two whose sizes allow the similarity make a
    group, the two being its sides.
    """
    many = members.groupBy("_bunch").agg(F.count(F.lit(1)).alias("_rows"))
    placed = members.join(many, "_bunch")
    small = placed.where(F.col("_rows") <= BLOCK).select(
        F.xxhash64("_bunch").alias("_group"), "_label", F.lit(0).alias("_side"), "_at"
    )
    large = placed.where(F.col("_rows") > BLOCK).withColumn("_band", F.floor(F.log2("_size") * 12))
    bands = (
        large.groupBy("_bunch", "_band")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_bunch", "_band", F.ceil(F.col("_rows") / BLOCK).alias("_parts"))
    )
    parts = bands.select("_bunch", "_band", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    # Sizes that differ by more than the similarity allows can't be similar.
    reach = math.ceil(12 * math.log2(100 / hundredths))
    one, other = parts.alias("a"), parts.alias("b")
    near = one.join(
        other,
        (F.col("a._bunch") == F.col("b._bunch"))
        & (F.col("b._band") - F.col("a._band")).between(0, reach)
        & ((F.col("a._band") < F.col("b._band")) | (F.col("a._part") <= F.col("b._part"))),
    )
    block = lambda of, side: F.struct(
        F.col(f"{of}._band").alias("_band"), F.col(f"{of}._part").alias("_part"), F.lit(side).alias("_side")
    )
    alone = (F.col("a._band") == F.col("b._band")) & (F.col("a._part") == F.col("b._part"))
    cells_ = near.select(
        F.col("a._bunch").alias("_bunch"),
        F.xxhash64("a._bunch", "a._band", "a._part", "b._band", "b._part").alias("_group"),
        F.explode(F.when(alone, F.array(block("a", 0))).otherwise(F.array(block("a", 0), block("b", 1)))).alias("_block"),
    ).select("_bunch", "_group", "_block.*")
    dealt = large.join(bands, ["_bunch", "_band"]).withColumn("_part", F.pmod(F.xxhash64("_at"), F.col("_parts")))
    return small.union(dealt.join(cells_, ["_bunch", "_band", "_part"]).select("_group", "_label", "_side", "_at"))


def op7_count_tree_join(spark, sf_dir: str) -> DataFrame:
    """Set size and component of every whole document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return component_of(documents).select(
        F.col("_at").alias("doc_id"), F.col("_size").alias("n_shingles"), F.col("_label").alias("component_id")
    )


def one_of_each(
    documents: DataFrame, text: str = "text", shingle: int = SHINGLE, hundredths: int = HUNDREDTHS
) -> DataFrame:
    """One row of each group of similar texts, the first by doc_id (null first), as it came.

    Rows are told apart by doc_id and text, and linked by their texts alone; rows without words stay.
    """
    scratch = Scratch(documents.sparkSession)
    found = _rooted(documents, text, shingle, hundredths, scratch).where("_root is not null")
    firsts = found.groupBy("_root").agg(F.min(F.struct("_id", "_at")).alias("_first"))
    firsts = scratch.stored(firsts.select(F.xxhash64("_first._id", "_first._at").alias("_key")), "join-firsts")
    scratch.keep(firsts)
    rows = documents.select(
        F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(whole_text(text))).alias("_key"),
        F.struct(*documents.columns).alias("_row"),
        (F.length(F.btrim(whole_text(text), F.lit(SPACES))) == 0).alias("_bare"),
    )
    # Rows that agree in both are made one in the tasks that read them.
    each = rows.where("not _bare").groupBy("_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    kept = each.join(firsts, "_key", "left_semi").select("_row.*")
    return kept.union(rows.where("_bare").select("_row.*"))
