"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has CELLS places.  Every shard stands at many of them, as virtual nodes; a key's hash
gives its place, and the next virtual node clockwise is its home.  A shard takes rows up to its
bound; what finds it full goes on clockwise to the next virtual node with room.  At the default
slack of 0 the bounds are the row quotas themselves, so shard counts are at most one apart
whatever the keys, while all but the overflow stays at home when shards are added.

Only the number of rows in each place matters for who overflows where, so the driver walks the
ring over CELLS counts, whatever the number of rows, and gives each shard a range of the ranks
of each place.  A row then needs its rank within its place: tasks sort places of about
1/65,536 of the rows.

Defined cases: a null text has no bytes; a null key has the place of its text's checksum; rows
that share a key are ranked by checksum and size, and share a place, however many they are; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import table, whole_text

CELL_BITS = 16
CELLS = 1 << CELL_BITS
NODES_PER_SHARD = 256
ROW_BYTES = 8


def ring(shards: int, nodes_per_shard: int = NODES_PER_SHARD) -> list[tuple[int, int]]:
    """Places and shards of all virtual nodes, clockwise; nodes that share a place follow by their whole hash."""
    nodes = []
    for shard in range(shards):
        for number in range(nodes_per_shard):
            mark = hashlib.blake2b(f"{shard}/{number}".encode(), digest_size=8).digest()
            nodes.append((mark, shard))
    return [(int.from_bytes(mark, "big") >> (64 - CELL_BITS), shard) for mark, shard in sorted(nodes)]


def bounds(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most rows each shard takes."""
    if slack > 0:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def allot(
    counts: dict[int, int], shards: int, slack: float = 0.0, nodes_per_shard: int = NODES_PER_SHARD
) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot) for all rows, given the rows of each cell."""
    nodes = ring(shards, nodes_per_shard)
    room = bounds(sum(counts.values()), shards, slack)
    used = [0] * shards
    pieces: list[tuple[int, int, int, int, int]] = []
    waiting: deque[tuple[int, int, int]] = deque()
    cells = deque(sorted(cell for cell, rows in counts.items() if rows))

    def take(shard: int, queue: deque[tuple[int, int, int]]) -> None:
        while queue and used[shard] < room[shard]:
            cell, first, end = queue.popleft()
            upto = min(end, first + room[shard] - used[shard])
            pieces.append((cell, first, upto, shard, used[shard]))
            used[shard] += upto - first
            if upto < end:
                queue.appendleft((cell, upto, end))

    for place, shard in nodes:
        own: deque[tuple[int, int, int]] = deque()
        while cells and cells[0] <= place:
            cell = cells.popleft()
            own.append((cell, 0, counts[cell]))
        take(shard, own)
        take(shard, waiting)
        waiting.extend(own)
    # Places behind the last node belong to the first one; the rest goes round again.
    waiting.extend((cell, 0, counts[cell]) for cell in cells)
    for _, shard in nodes:
        take(shard, waiting)
    if waiting:
        raise ValueError("the shards have less room than there are rows")
    return pieces


def place(documents: DataFrame, shards: int, slack: float = 0.0, nodes_per_shard: int = NODES_PER_SHARD) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    text = whole_text("text")
    checksum = F.crc32(text)
    rows = documents.select(
        "doc_id",
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        checksum.alias("text_crc32"),
        F.xxhash64(F.coalesce("doc_id", checksum)).alias("spot"),
    ).withColumn("cell", F.shiftrightunsigned("spot", 64 - CELL_BITS).cast("int"))
    counts = {r["cell"]: r["rows"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).collect()}
    pieces = allot(counts, shards, slack, nodes_per_shard)
    # At most one piece a cell and one more for each stop at a node: bounded by the parameters.
    ranges = F.broadcast(
        documents.sparkSession.createDataFrame(
            pieces, "cell int, first_rank bigint, end_rank bigint, shard int, first_slot bigint"
        )
    )
    in_cell = Window.partitionBy("cell").orderBy("spot", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(in_cell).cast("long") - 1)
    within = (ranked["cell"] == ranges["cell"]) & ranked["rank"].between(
        ranges["first_rank"], ranges["end_rank"] - 1
    )
    return ranked.join(ranges, within).select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("first_slot") + F.col("rank") - F.col("first_rank")).alias("slot"),
    )


def op8_bounded_ring(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts are at most one apart."""
    placed = place(table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
