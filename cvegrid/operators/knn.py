"""Nearest neighbours by cosine distance, exact and approximate."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvegrid.functions.vectors import DISTANCE_PLACES, as_matrix, distance_to, unit, unit_rows

TOP_K = 5
# About how many queries and rows meet in one task, and how many of the queries in one product.
QUERIES_TOGETHER = 2048
ROWS_TOGETHER = 8192
QUERIES_AT_ONCE = 64

# Of the index: vectors that place the centroids, most centroids, and the share of exact neighbours
# that a search has to find, measured on so many rows.
SAMPLE = 100_000
MOST_LISTS = 4096
RECALL = 0.97
TRIES = 400
CENTROIDS = "list int, centroid array<double>, rows bigint, probes int"


def union_all_search(tables: list[DataFrame], columns: list[str]) -> DataFrame:
    """The searched tables under one another, repeats kept."""
    first, *rest = [table.select(*columns) for table in tables]
    for table in rest:
        first = first.unionByName(table)
    return first


def semantic_top_k(
    tables: list[DataFrame], query: list[float], k: int = TOP_K, key: str = "cve_id"
) -> DataFrame:
    """The k rows of all tables nearest to the query; rows without a vector come last.

    The sort with a limit keeps k rows per task, so nothing but those is moved.
    """
    scored = union_all_search(tables, [key, "content", "embedding"]).select(
        key, "content", distance_to(F.col("embedding"), query).alias("distance")
    )
    return scored.orderBy(F.col("distance").asc_nulls_last(), key).limit(k)


def context_join(results: DataFrame, key: str = "cve_id") -> DataFrame:
    """The contents of a top-k result as one text, nearest first."""
    ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("distance", F.lit(math.inf)), key, "content")))
    texts = F.transform(ranked, lambda row: row["content"])
    # The wording around the texts.
    return results.agg(texts.alias("texts")).select(
        F.when(F.size("texts") == 0, "No relevant context found.")
        .otherwise(F.concat(F.lit("Retrieved context:\n\n"), F.array_join("texts", "\n\n---\n\n")))
        .alias("context")
    )


def knn_batch(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    key: str = "vec_id",
    query_key: str = "query_id",
    queries_together: int = QUERIES_TOGETHER,
    rows_together: int = ROWS_TOGETHER,
) -> DataFrame:
    """The k nearest corpus rows of every query vector.

    Queries and rows are dealt by hash into blocks of about the given sizes, and every block of the
    one meets every block of the other once.  Such a meeting is one matrix product and sends k
    rows a query; the ranking keeps k a query before its shuffle and k at the end.  The numbers of
    blocks come from counts inside the same plan, so the search stays one lazy plan however many
    queries there are, and a task never holds more than two blocks.
    """
    # A query without a vector has no neighbours, nor has one without a direction (all zeros).
    given = queries.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
    query_kind = "bigint" if isinstance(queries.schema[query_key].dataType, T.IntegralType) else "string"
    left = given.select(
        F.col(query_key).cast(query_kind).alias(query_key), F.col("embedding").cast("array<double>").alias("_query")
    )
    right = corpus.where(F.col("embedding").isNotNull()).select(key, "embedding")
    query_blocks, row_blocks = _blocks(left, queries_together), _blocks(right, rows_together)
    left = _dealt(left, "_query", "_query_block", query_blocks, "_row_block", row_blocks)
    right = _dealt(right, key, "_row_block", row_blocks, "_query_block", query_blocks)
    kind = corpus.schema[key].dataType.simpleString()
    near = _meet(left, right, ["_query_block", "_row_block"], k, key, query_key, f"{query_key} {query_kind}, {key} {kind}")
    return _ranked(near, query_key, key, k)


def _ranked(near: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(query_key).orderBy("distance", key)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(frame: DataFrame, together: int) -> Column:
    """Number of blocks of a frame, as a value of the plan; one for an empty frame."""
    return frame.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / together)).cast("int")).scalar()


def _dealt(frame: DataFrame, by: str, own: str, blocks: Column, other: str, others: Column) -> DataFrame:
    """Rows in their block, once for each block of the other side."""
    placed = frame.withColumn(own, F.pmod(F.xxhash64(by), blocks).cast("int"))
    return placed.withColumn(other, F.explode(F.sequence(F.lit(0), others - 1)))


def _meet(left: DataFrame, right: DataFrame, blocks: list[str], k: int, key: str, query_key: str, ids: str) -> DataFrame:
    """k nearest rows of each query within every pair of blocks that shares the block columns."""

    def nearest(queries: pa.Table, rows: pa.Table) -> pa.Table:
        key_type, query_type = rows.schema.field(key).type, queries.schema.field(query_key).type
        found = {query_key: [], key: [], "distance": []}
        if queries.num_rows and rows.num_rows:
            width = len(queries["_query"][0])
            wanted = unit_rows(as_matrix(queries["_query"].combine_chunks(), width)[0])
            # In the order of their keys, so that a stable sort breaks ties by key.
            rows = rows.sort_by(key)
            matrix = unit_rows(as_matrix(rows["embedding"].combine_chunks(), width)[0])
            keys = rows[key].to_pylist()
            for start in range(0, len(wanted), QUERIES_AT_ONCE):
                distance = np.round(1.0 - wanted[start : start + QUERIES_AT_ONCE] @ matrix.T, DISTANCE_PLACES)
                for place, row in enumerate(distance, start):
                    for at in _first(row, k):
                        found[query_key].append(queries[query_key][place].as_py())
                        found[key].append(keys[at])
                        found["distance"].append(float(row[at]))
        kinds = {query_key: query_type, key: key_type, "distance": pa.float64()}
        return pa.table({name: pa.array(values, kinds[name]) for name, values in found.items()})

    return left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInArrow(nearest, f"{ids}, distance double")


def _first(distances: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest distances, of equal ones the first; a missing distance is none."""
    real = np.flatnonzero(~np.isnan(distances))
    if len(real) > k:
        bound = np.partition(distances[real], k - 1)[k - 1]
        real = real[distances[real] <= bound]
    return real[np.argsort(distances[real], kind="stable")][:k]


class InvertedLists:
    """A stored index for approximate search: centroids, and all rows in the list of their nearest one.

    Centroids come from k-means over a bounded sample of unit vectors; every row is indexed.  A
    query probes the lists whose centroids are nearest, and further ones until they hold k rows,
    so it always gets k rows if the index has them.  Only the probed lists are opened.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id") -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.key = key

    def build(
        self,
        vectors: DataFrame,
        lists: int | None = None,
        sample: int = SAMPLE,
        k: int = TOP_K,
        recall: float = RECALL,
        tries: int = TRIES,
        seed: int = 7,
    ) -> None:
        """Index the rows that have a direction.

        About `sample` of them, chosen by the hash of the key, place the centroids; without a
        number, there are as many lists as the square root of the number of rows, at most MOST_LISTS.
        How many lists a search opens is measured: the fewest in which `recall` of the exact k
        neighbours of about `tries` rows lie.
        """
        usable = vectors.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)).select(
            self.key, "embedding"
        )
        rows = usable.count()
        lists = lists or max(1, min(MOST_LISTS, math.isqrt(rows)))
        share = min(1.0, sample / max(1, rows))
        chosen = usable.where(F.pmod(F.xxhash64(self.key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        points = chosen.select(array_to_vector(unit(F.col("embedding"))).alias("features"))
        centroids = np.zeros((0, 0))
        if rows:
            model = KMeans(k=lists, seed=seed, maxIter=15, distanceMeasure="euclidean").fit(points)
            centroids = unit_rows(np.asarray(model.clusterCenters(), dtype="float64"))
            centroids = centroids[~np.isnan(centroids).any(axis=1)]
        placed = usable.withColumn("list", _nearest_list(F.col("embedding"), centroids))
        placed.limit(0).write.mode("errorifexists").parquet(f"{self.path}/schema")
        # A long list is written by several tasks.
        spread = placed.repartition("list", F.pmod(F.xxhash64(self.key), F.lit(16)))
        spread.write.mode("errorifexists").partitionBy("list").parquet(f"{self.path}/lists")
        sizes = {r["list"]: r["count"] for r in self.rows().groupBy("list").count().collect()}
        probes = self._probes_for(centroids, rows, k, recall, tries) if rows else 1
        kept = [(n, c.tolist(), sizes.get(n, 0), probes) for n, c in enumerate(centroids)]
        self.spark.createDataFrame(kept, CENTROIDS).write.mode("errorifexists").parquet(f"{self.path}/centroids")

    def _probes_for(self, centroids: np.ndarray, rows: int, k: int, recall: float, tries: int) -> int:
        """Lists to open so that the exact neighbours of about `tries` indexed rows are found at that rate.

        At most tries x k rows come to the driver: a tried vector and the list of one neighbour.
        """
        share = int(min(1.0, tries / rows) * (1 << 20)) + 1
        picked = self.rows().where(F.pmod(F.xxhash64(self.key, F.lit("tried")), F.lit(1 << 20)) < share)
        tried = picked.select(F.col(self.key).alias("_tried"), "embedding")
        near = knn_batch(self.rows(), tried, k + 1, self.key, "_tried").where(F.col(self.key) != F.col("_tried"))
        lists = near.join(self.rows().select(self.key, "list"), self.key).select("_tried", "list")
        pairs = tried.join(lists, "_tried").select(F.col("embedding").cast("array<double>"), "list").collect()
        if not pairs:
            return 1
        vectors = unit_rows(np.array([p["embedding"] for p in pairs]))
        order = np.argsort(-(vectors @ centroids.T), axis=1, kind="stable")
        place = (order == np.array([p["list"] for p in pairs])[:, None]).argmax(axis=1)
        return int(np.sort(place)[min(len(place) - 1, math.ceil(recall * len(place)) - 1)]) + 1

    def rows(self) -> DataFrame:
        """The indexed rows with their lists."""
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        return self.spark.read.schema(schema).parquet(f"{self.path}/lists")

    def search(
        self,
        queries: DataFrame,
        k: int = TOP_K,
        probes: int | None = None,
        query_key: str = "query_id",
        together: int = ROWS_TOGETHER,
    ) -> DataFrame:
        """Approximately the k nearest rows of every query vector, as `knn_batch` gives them.

        At most MOST_LISTS centroids come to the driver.  Queries and rows meet list by list, long
        lists in parts and many queries in groups, so a task holds a bounded number of both.
        """
        held = self.spark.read.schema(CENTROIDS).parquet(f"{self.path}/centroids").orderBy("list").collect()
        if not held:
            return knn_batch(self.rows(), queries, k, self.key, query_key)
        probes = probes or held[0]["probes"]
        sizes = np.array([r["rows"] for r in held], dtype="int64")
        centroids = np.array([r["centroid"] for r in held], dtype="float64")
        given = queries.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
        given = given.select(query_key, F.col("embedding").cast("array<double>").alias("_query"))
        groups = _blocks(given, QUERIES_TOGETHER)
        asked = given.withColumn("_group", F.pmod(F.xxhash64("_query"), groups).cast("int")).withColumn(
            "list", F.explode(_probed(F.col("_query"), centroids, sizes, k, probes))
        )
        parts = self.spark.createDataFrame(
            [(n, max(1, -(-int(size) // together))) for n, size in enumerate(sizes)], "list int, parts int"
        )
        right = self.rows().join(F.broadcast(parts), "list")
        right = right.withColumn("_part", F.pmod(F.xxhash64(self.key), F.col("parts")).cast("int")).drop("parts")
        right = right.withColumn("_group", F.explode(F.sequence(F.lit(0), groups - 1)))
        left = asked.join(F.broadcast(parts), "list")
        left = left.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        blocks = ["list", "_part", "_group"]
        kind = self.rows().schema[self.key].dataType.simpleString()
        query_kind = queries.schema[query_key].dataType.simpleString()
        ids = f"{query_key} {query_kind}, {self.key} {kind}"
        near = _meet(left, right, blocks, k, self.key, query_key, ids)
        return _ranked(near, query_key, self.key, k)


def _nearest_list(vector: Column, centroids: np.ndarray) -> Column:
    """Number of the centroid nearest to a vector."""

    @F.arrow_udf("int")
    def nearest(vectors: pa.Array) -> pa.Array:
        matrix, _ = as_matrix(vectors, centroids.shape[1])
        return pa.array(np.argmax(unit_rows(matrix) @ centroids.T, axis=1).astype("int32"))

    return nearest(vector)


def _probed(vector: Column, centroids: np.ndarray, sizes: np.ndarray, k: int, probes: int) -> Column:
    """Lists that a query opens: the nearest ones, at least `probes` and at least k rows."""

    @F.arrow_udf("array<int>")
    def lists(vectors: pa.Array) -> pa.Array:
        matrix, _ = as_matrix(vectors, centroids.shape[1])
        order = np.argsort(-(unit_rows(matrix) @ centroids.T), axis=1, kind="stable")
        enough = np.maximum(probes, 1 + (np.cumsum(sizes[order], axis=1) < k).sum(axis=1))
        return pa.array([row[:n].tolist() for row, n in zip(order, enough, strict=True)], pa.list_(pa.int32()))

    return lists(vector)
