"""Merkle manifest of a dataset, with proofs made by pointer jumping.

A leaf is the digest of a row's fields.  The leaves of a language, in the order of their ids, form
one binary tree, and the roots of these trees, in the order of the languages, another one.  Trees
grow eight levels at a time: a task gets 256 consecutive nodes and returns the digests above them.

For the proofs every node first points to its parent and holds one segment, the digest of its
sibling.  A round joins each node with the node it points to: it then points to that node's target,
and the two segments follow one another.  The distance doubles, so that trees of n leaves need
log2(log2(n)) rounds.  After the round with distance d only nodes at levels divisible by 2 * d are
met again and kept.  Proofs of a language's leaves are followed by the proof of its root.

Rows are placed by a range sort and the counts of its parts.  Where many nodes point to one target,
the target stands once for each 4,096 of them, so no join key has more rows.

Defined cases: a null field is `-`, an empty one `0:`; rows without an id come first in their
language, rows of one id go by their leaf's digest, and rows that are equal throughout share digests
but have a place each; a language with one row has its leaf as root; a null language is a group of
its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, table

# Levels grown in one step, and nodes that meet one copy of their target, as powers of two.
STEP_BITS = 8
MEET_BITS = 12
TAMPERED = 7
PART_BITS = 33

_NO_SIBLINGS = "CAST(array() AS ARRAY<BINARY>)"


def field(value: Column) -> Column:
    """A field as the leaf's digest takes it: byte count and value, or a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(n_chars: Column) -> Column:
    """Digest of a row under the given character count."""
    values = [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def above(*digests: Column) -> Column:
    """Digest of the node above the given ones; their hex texts are what is hashed."""
    return F.unhex(F.sha2(F.concat(*[F.coalesce(as_hex(d), F.lit("")) for d in digests]), 256))


def depth_of(size: Column) -> Column:
    """Levels of a tree above its leaves."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def leaves(documents: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and the leaf that is presented for checking."""
    told = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    changed = F.when(told, F.col("n_chars").cast("decimal(20,0)") + 1)
    return documents.select(
        "doc_id",
        "lang",
        leaf_digest(F.col("n_chars")).alias("leaf"),
        F.when(changed.isNotNull(), leaf_digest(changed)).alias("changed"),
    )


def numbered(frame: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their part of the sorted table and their place in it, counted from 0."""
    rows = frame.withColumn("_read", F.monotonically_increasing_id())
    keys = [*order, "_read"]
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read")
    laid = stored(laid.withColumn("_at", F.monotonically_increasing_id()), name)
    laid = laid.withColumn("part", F.shiftright("_at", PART_BITS))
    # One row a part: as many as the sort has partitions.
    counts = laid.groupBy("part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    joined = laid.join(F.broadcast(starts), "part")
    return joined.withColumn("place", F.col("_start") + F.col("_at") - F.col("_first")).drop("_at", "_first", "_start")


def _halved(below: Column) -> Column:
    """The level above: every two digests become one, a last single one too."""
    pairs = F.sequence(F.lit(0), F.shiftright(F.size(below) - 1, 1))
    return F.transform(pairs, lambda i: above(F.get(below, 2 * i), F.get(below, 2 * i + 1)))


def _grow(level: DataFrame, name: str, held: list[str] | None = None) -> DataFrame:
    """Blocks of consecutive nodes with the digests of up to eight levels, from (tree, pos, digest, size).

    `levels` holds the block's digests level by level; `top` is what remains of them.
    """
    members = F.array_sort(F.collect_list(F.struct("pos", "digest", *(held or []))))
    blocks = level.groupBy("tree", F.shiftright("pos", STEP_BITS).alias("block")).agg(
        F.first("size").alias("size"), members.alias("members")
    )
    blocks = blocks.withColumn("height", F.least(depth_of(F.col("size")), F.lit(STEP_BITS)))
    blocks = blocks.withColumn("level_0", F.transform("members", lambda m: m["digest"]))
    for number in range(STEP_BITS):
        folded = _halved(F.col(f"level_{number}"))
        blocks = blocks.withColumn(f"level_{number + 1}", F.when(F.col("height") > number, folded))
    layers = [F.when(F.col("height") > n, F.col(f"level_{n}")) for n in range(STEP_BITS)]
    tops = F.array(*[F.col(f"level_{n}") for n in range(STEP_BITS + 1)])
    kept = ["tree", "block", "size", "height"]
    if held:
        blocks = blocks.withColumn("members", F.transform("members", lambda m: m.dropFields("digest")))
        kept.append("members")
    return stored(
        blocks.select(
            *kept,
            F.filter(F.array(*layers), lambda x: x.isNotNull()).alias("levels"),
            F.get(F.get(tops, F.col("height")), F.lit(0)).alias("top"),
        ),
        name,
    )


def _sibling(layer: Column, place: Column) -> Column:
    return F.get(layer, place.bitwiseXOR(F.lit(1)))


def grow_trees(leaf_rows: DataFrame, largest: int, held: list[str], name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaf nodes, inner nodes and roots of all trees, from (tree, pos, digest, size, held).

    Nodes have the segment of their first step up; a root has none.
    """
    blocks = _grow(leaf_rows, f"{name}-0", held)
    bottom = F.get("levels", F.lit(0))
    members = F.transform("members", lambda m, i: F.struct(m.alias("m"), _sibling(bottom, i).alias("sibling")))
    start = F.when(F.col("size") > 1, F.array("sibling")).otherwise(F.expr(_NO_SIBLINGS))
    leaf_nodes = (
        blocks.select("tree", "size", F.explode(members).alias("n"))
        .select("tree", "size", "n.m.*", "n.sibling")
        .withColumn("segment", start)
        .drop("sibling")
    )
    inner, roots, lifted, size = [], [], 0, largest
    while True:
        layers = blocks.select("tree", "block", F.posexplode("levels").alias("up", "layer"))
        siblings = F.transform("layer", lambda _, i: _sibling(F.col("layer"), i))
        nodes = layers.where(F.col("up") + lifted > 0).select(
            "tree",
            (F.col("up") + lifted).alias("level"),
            F.shiftleft("block", STEP_BITS).alias("base"),
            "up",
            F.posexplode(siblings).alias("nth", "sibling"),
        )
        position = F.expr("shiftright(base, up)") + F.col("nth")
        inner.append(nodes.select("tree", "level", position.alias("pos"), F.array("sibling").alias("segment")))
        level = blocks.select(
            "tree",
            F.col("block").alias("pos"),
            F.col("top").alias("digest"),
            (F.shiftright(F.col("size") - 1, STEP_BITS) + 1).alias("size"),
        )
        roots.append(level.where("size = 1").select("tree", F.col("digest").alias("subroot")))
        lifted += STEP_BITS
        size = (size - 1 >> STEP_BITS) + 1
        if size == 1:
            return leaf_nodes, reduce(DataFrame.unionByName, inner), reduce(DataFrame.unionByName, roots)
        blocks = _grow(level.where("size > 1"), f"{name}-{lifted}")


def _met(nodes: DataFrame, level: Column, targets: DataFrame, distance: int) -> DataFrame:
    """Nodes with the segments of the targets they point to, `distance` above them.

    A node that has arrived at its root asks for a level that no node has, under its own position.
    """
    far = F.size("segment") == distance
    within = F.col("pos").bitwiseAND(F.lit((1 << distance) - 1).cast("bigint"))
    asked = nodes.withColumns(
        {
            "_tree": F.col("tree"),
            "_level": F.when(far, level + distance).otherwise(-1),
            "_pos": F.when(far, F.shiftright("pos", distance)).otherwise(F.col("pos")),
            "_copy": F.shiftright(within, MEET_BITS).cast("int"),
        }
    )
    longer = F.concat("segment", F.coalesce("_more", F.expr(_NO_SIBLINGS)))
    met = asked.join(targets, ["_tree", "_level", "_pos", "_copy"], "left").withColumn("segment", longer)
    return met.drop("_tree", "_level", "_pos", "_copy", "_more")


def jump(leaf_nodes: DataFrame, inner: DataFrame, largest: int, name: str) -> DataFrame:
    """Leaf nodes with whole segments: rounds of joins, each doubling the distance."""
    distance = 1
    while distance < (largest - 1).bit_length():
        inner = stored(inner, f"{name}-{distance}")
        copies = F.sequence(F.lit(0), F.lit((1 << max(0, distance - MEET_BITS)) - 1))
        targets = inner.where(F.col("level") % (2 * distance) == distance).select(
            F.col("tree").alias("_tree"),
            F.col("level").alias("_level"),
            F.col("pos").alias("_pos"),
            F.col("segment").alias("_more"),
            F.explode(copies).alias("_copy"),
        )
        leaf_nodes = _met(leaf_nodes, F.lit(0), targets, distance)
        inner = _met(inner.where(F.col("level") % (2 * distance) == 0), F.col("level"), targets, distance)
        distance *= 2
    return leaf_nodes


def fold(start: Column, position: Column, segment: Column) -> Column:
    """Digest at the end of a segment; a bit of the position tells on which side a sibling stands."""

    def up(state: Column, sibling: Column) -> Column:
        left = state["at"].bitwiseAND(F.lit(1).cast("bigint")) == 1
        # A node without a sibling is hashed alone.
        digest = above(F.when(left, sibling).otherwise(state["digest"]), F.when(left, state["digest"]).otherwise(sibling))
        return F.struct(digest.alias("digest"), F.shiftright(state["at"], 1).alias("at"))

    begin = F.struct(start.alias("digest"), position.cast("bigint").alias("at"))
    return F.aggregate(segment, begin, up, lambda state: state["digest"])


def manifest(documents: DataFrame) -> DataFrame:
    """Leaf, roots, proof and the check of the presented row, for every row."""
    rows = numbered(stored(leaves(documents), "merkle-leaves"), ["lang", "doc_id", "leaf"], "merkle-order")
    runs = stored(
        rows.groupBy("part", "lang").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows")), "merkle-runs"
    )
    groups = runs.groupBy("lang").agg(F.min("first").alias("first"), F.sum("rows").alias("size"))
    trees = numbered(groups, ["lang"], "merkle-trees").select(
        F.col("lang").alias("_lang"), F.col("place").alias("tree"), F.col("first"), F.col("size")
    )
    largest, many = trees.agg(F.max("size"), F.count(F.lit(1))).first()
    if not many:
        shape = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
        return documents.sparkSession.createDataFrame([], f"{shape}, verified boolean")
    # A language's rows are found by (part, language), so a large one is spread over the parts.
    known = runs.drop("first", "rows").join(trees, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    known = known.withColumnsRenamed({"part": "_part", "lang": "_lang"})
    own_tree = (F.col("part") == F.col("_part")) & F.col("lang").eqNullSafe(F.col("_lang"))
    held = ["doc_id", "changed", "leaf"]
    placed = rows.join(known, own_tree).select(
        "tree", (F.col("place") - F.col("first")).alias("pos"), F.col("leaf").alias("digest"), "size", *held
    )
    leaf_nodes, inner, subroots = grow_trees(placed, largest, held, "merkle-grown")
    proofs = jump(leaf_nodes, inner, largest, "merkle-jump")

    # The tree of the trees' roots.
    subroots = stored(subroots, "merkle-subroots")
    upper = subroots.select(
        F.lit(0).cast("bigint").alias("tree"),
        F.col("tree").alias("pos"),
        F.col("subroot").alias("digest"),
        F.lit(many).cast("bigint").alias("size"),
        "subroot",
    )
    upper_leaves, upper_inner, top = grow_trees(upper, many, ["subroot"], "merkle-upper")
    root = as_hex(F.lit(top.first()["subroot"]))
    upper_proofs = jump(upper_leaves, upper_inner, many, "merkle-upper-jump").select(
        F.col("pos").alias("tree"), "subroot", F.col("segment").alias("upper")
    )
    copies = F.sequence(F.lit(0).cast("bigint"), F.shiftright(F.col("size") - 1, MEET_BITS))
    ends = upper_proofs.join(trees.select("tree", "size"), "tree").select(
        "tree", "subroot", "upper", F.explode(copies).alias("copy")
    )
    whole = proofs.withColumn("copy", F.shiftright("pos", MEET_BITS)).join(ends, ["tree", "copy"])
    presented = F.coalesce("changed", "leaf")
    siblings = F.transform(
        F.filter(F.concat("segment", "upper"), lambda s: s.isNotNull()), lambda s: as_hex(s)
    )
    folded = fold(fold(presented, F.col("pos"), F.col("segment")), F.col("tree"), F.col("upper"))
    return whole.select(
        "doc_id",
        as_hex(F.col("leaf")).alias("leaf"),
        as_hex(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        as_hex(folded).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_pointer_jumping(spark, sf_dir: str) -> DataFrame:
    """Manifest and checked proof of every document."""
    return manifest(table(spark, sf_dir, "documents"))
