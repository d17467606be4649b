"""Vector search and embedding batches against plain computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cvegrid.functions.vectors import cosine_distance, distance_to, estimate_tokens, truncate_text
from cvegrid.operators import embed, knn


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    data = rng.normal(size=(400, 16)).astype("float32")
    data[100:130] = data[7]  # a group of equal vectors
    return data


@pytest.fixture(scope="module")
def corpus(spark, vectors):
    rows = [(i, f"text {i}", v.tolist()) for i, v in enumerate(vectors)] + [(1000, "none", None)]
    return spark.createDataFrame(rows, "vec_id long, content string, embedding array<float>").repartition(6)


def exact(vectors, query, k):
    data = vectors.astype("float64")
    query = np.asarray(query, dtype="float64")
    cosine = data @ query / (np.linalg.norm(data, axis=1) * np.linalg.norm(query))
    distance = np.round(1 - cosine, 9)
    return sorted(zip(distance.tolist(), range(len(data)), strict=True))[:k]


def same(found, expected):
    """Equal ids in equal order at (nearly) equal distances."""
    return all(a[1] == b[1] and abs(a[0] - b[0]) < 2e-9 for a, b in zip(found, expected, strict=True))


def test_both_distances_agree(corpus, vectors):
    query = [float(x) for x in vectors[3]]
    rows = corpus.select(
        "vec_id",
        cosine_distance(F.col("embedding"), F.array(*[F.lit(x) for x in query])).alias("a"),
        distance_to(F.col("embedding"), query).alias("b"),
    ).collect()
    assert all(r.a is None and r.b is None if r.vec_id == 1000 else abs(r.a - r.b) < 1e-8 for r in rows)


def test_zero_vectors_have_no_distance(spark):
    frame = spark.createDataFrame([([0.0, 0.0],), ([0.0, 2.0],)], "embedding array<float>")
    rows = frame.select(
        cosine_distance(F.col("embedding"), F.array(F.lit(0.0), F.lit(1.0))), distance_to(F.col("embedding"), [0.0, 1.0])
    ).collect()
    assert [tuple(r) for r in rows] == [(None, None), (0.0, 0.0)]


def test_width_is_checked(spark):
    frame = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0],)], "embedding array<float>")
    with pytest.raises(Exception, match="every vector must have 2 numbers"):
        frame.select(distance_to(F.col("embedding"), [1.0, 0.0])).collect()


def test_top_k_over_both_tables(corpus, vectors):
    tables = [corpus.where("vec_id % 2 = 0"), corpus.where("vec_id % 2 = 1")]
    for k in (5, 40):
        found = knn.semantic_top_k(tables, vectors[7].tolist(), k, key="vec_id").collect()
        assert same(((r.distance, r.vec_id) for r in found), exact(vectors, vectors[7], k))
    everything = knn.semantic_top_k(tables, vectors[7].tolist(), 10_000, key="vec_id").collect()
    assert len(everything) == 401 and everything[-1].vec_id == 1000


@pytest.mark.parametrize("together", [(2048, 8192), (4, 37)])
def test_batch_search_is_exact(spark, corpus, vectors, together):
    chosen = [7, 8, 9, 50, 51, 52, 53, 54, 55]
    queries = spark.createDataFrame([(i, vectors[i].tolist()) for i in chosen], "query_id long, embedding array<float>")
    found = knn.knn_batch(corpus, queries, k=6, queries_together=together[0], rows_together=together[1]).collect()
    for query in chosen:
        ranked = sorted((r.rank, r.distance, r.vec_id) for r in found if r.query_id == query)
        assert [r[0] for r in ranked] == list(range(1, 7))
        assert same((r[1:] for r in ranked), exact(vectors, vectors[query], 6))


def test_batch_search_without_queries(spark, corpus):
    queries = spark.createDataFrame([], "query_id string, embedding array<float>")
    assert knn.knn_batch(corpus, queries).columns == ["query_id", "vec_id", "distance", "rank"]


def test_batch_search_is_one_lazy_plan(spark, corpus, vectors):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    queries = corpus.select(F.col("vec_id").alias("query_id"), "embedding")
    knn.knn_batch(corpus, queries, queries_together=8)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


def test_queries_without_direction_have_no_neighbours(spark, corpus):
    queries = spark.createDataFrame([("a", None), ("b", [0.0] * 16)], "query_id string, embedding array<float>")
    assert knn.knn_batch(corpus, queries).count() == 0
    assert knn.knn_batch(corpus.where("false"), corpus.select(F.col("vec_id").alias("query_id"), "embedding")).count() == 0


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    made = knn.InvertedLists(spark, str(tmp_path_factory.mktemp("ann") / "index"))
    made.build(corpus, lists=12)
    return made


def test_index_holds_every_row_that_has_a_vector(index, corpus):
    assert index.rows().count() == 400 and index.rows().select("list").distinct().count() > 6


def test_approximate_search_recalls_most_and_gives_k_rows(spark, corpus, vectors, index):
    queries = corpus.where("vec_id % 4 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), "embedding")
    found = index.search(queries, k=5).collect()
    hits = 0
    for query in range(0, 400, 4):
        own = sorted((r.rank, r.distance, r.vec_id) for r in found if r.query_id == query)
        best = exact(vectors, vectors[query], 5)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        every = {i: d for d, i in exact(vectors, vectors[query], 400)}
        assert all(abs(every[i] - d) < 2e-9 for _, d, i in own)
        hits += sum(abs(a[1] - b[0]) < 2e-9 for a, b in zip(own, best, strict=True))
    assert hits >= 0.9 * 500


def test_a_search_opens_only_its_lists_but_always_k_rows(spark, vectors, index):
    query = spark.createDataFrame([(1, vectors[3].tolist())], "query_id long, embedding array<float>")
    assert index.search(query, k=5, probes=1).count() == 5
    assert index.search(query, k=390, probes=1).count() == 390
    plan = index.search(query, k=5, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan or "PartitionFilters: [isnotnull(list" in plan


def test_an_empty_index_answers_nothing(spark, corpus, tmp_path):
    made = knn.InvertedLists(spark, str(tmp_path / "none"))
    made.build(corpus.where("false"))
    assert made.search(corpus.select(F.col("vec_id").alias("query_id"), "embedding")).count() == 0


def test_context(corpus, vectors):
    near = knn.semantic_top_k([corpus], vectors[9].tolist(), 2, key="vec_id")
    ids = [r.vec_id for r in near.collect()]
    text = knn.context_join(near, "vec_id").first().context
    assert text == f"Retrieved context:\n\ntext {ids[0]}\n\n---\n\ntext {ids[1]}"
    assert knn.context_join(near.where("false"), "vec_id").first().context == "No relevant context found."


def test_token_estimate(spark):
    frame = spark.createDataFrame([("",), ("a",), ("ab",), ("é" * 20_000,)], "t string")
    rows = frame.select(estimate_tokens(F.col("t")), F.length(truncate_text(F.col("t")))).collect()
    assert [tuple(r) for r in rows] == [(1, 0), (1, 1), (2, 2), (10001, 16382)]


def greedy(sizes, max_tokens, max_items):
    """Request number of each size, one after the other."""
    numbers, used, held, number = [], 0, 0, 0
    for size in sizes:
        if held and (used + size > max_tokens or held >= max_items):
            number, used, held = number + 1, 0, 0
        numbers.append(number)
        used, held = used + size, held + 1
    return numbers


def test_packing_matches_one_by_one(spark):
    rng = np.random.default_rng(1)
    texts = ["x" * int(n) for n in rng.integers(0, 60, 230)]
    texts[17] = "y" * 400  # over the budget by itself
    frame = spark.createDataFrame(list(enumerate(texts)), "n long, content string").repartition(5)
    found = {r.n: (r.run, r.request) for r in embed.token_batches(frame, "n", max_tokens=100, max_items=50).collect()}
    expected = {}
    for start in range(0, 230, 50):
        sizes = [len(t) // 2 + 1 for t in texts[start : start + 50]]
        for offset, number in enumerate(greedy(sizes, 100, 50)):
            expected[start + offset] = (start // 50, number)
    assert found == expected


def test_requests_respect_both_limits():
    texts = [(i, "z" * (i * 7 % 90)) for i in range(300)]
    requests = list(embed._grouped(iter(texts), 200, 12))
    assert [k for request in requests for k, _ in request] == list(range(300))
    numbers = [n for n, request in enumerate(requests) for _ in request]
    assert numbers == greedy([len(t) // 2 + 1 for _, t in texts], 200, 12)


def test_every_character_is_embedded(spark):
    long = "ab" * embed.PIECE + "c"
    rows = spark.createDataFrame([(1, long), (2, "abc"), (3, None), (4, "")], "n long, content string")

    def count(texts):
        assert all(len(t) <= embed.PIECE for t in texts)
        return [[float(t.count(x)) for x in "abc"] for t in texts]

    found = {r.n: r.embedding for r in embed.embed_texts(rows, count, "n", max_items=2).collect()}
    assert found == {1: [embed.PIECE, embed.PIECE, 1], 2: [1, 1, 1], 3: [0, 0, 0], 4: [0, 0, 0]}
    packed = embed.token_batches(rows.where("n < 3"), "n").orderBy("n", "piece").collect()
    assert [(r.n, r.piece, r.tokens) for r in packed] == [(1, 0, 8191), (1, 1, 8191), (1, 2, 1), (2, 0, 2)]


def test_requests_are_those_of_the_packing(spark):
    rng = np.random.default_rng(2)
    texts = ["x" * int(n) for n in rng.integers(0, 60, 120)] + ["y" * (2 * embed.PIECE + 5), None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, content string").repartition(4)

    def telling(request):
        # Each text's vector tells of the request it came in.
        return [[float(len(request)), float(sum(map(len, request))), float(len(t))] for t in request]

    packed = embed.token_batches(rows, "n", max_tokens=9000, max_items=50).collect()
    groups = {}
    for r in packed:
        groups.setdefault((r.run, r.request), []).append((r.n, r.piece))
    found = {r.n: r.embedding for r in embed.embed_requests(rows, telling, "n", max_tokens=9000, max_items=50).collect()}
    for pieces in groups.values():
        for n, _ in pieces:
            if n != 120:
                assert found[n][0] == len(pieces)
    # The long text came in three requests of its own, or shared ones; all its characters were embedded.
    assert found[120][2] == 2 * embed.PIECE + 5 and found[121][2] == 0 and len(found) == 122


def test_refused_requests_are_halved(spark):
    def fussy(texts):
        if len(texts) > 3:
            raise embed.RequestTooLarge(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, "a" * i) for i in range(25)], "n long, content string").coalesce(1)
    found = {r.n: r.embedding for r in embed.embed_texts(rows, fussy, "n").collect()}
    assert found == {i: [float(i), 1.0] for i in range(25)}

    def never(texts):
        raise embed.RequestTooLarge(len(texts))

    with pytest.raises(embed.RequestTooLarge):
        embed._answered(never, ["a", "b"])


def test_backfill_fills_only_gaps(spark):
    rows = spark.createDataFrame(
        [("A", "aa", [9.0]), ("B", "bbb", None), ("C", "", None)], "cve_id string, content string, embedding array<float>"
    )
    assert [r.cve_id for r in embed.missing_embedding(rows).collect()] == ["B", "C"]
    filled = embed.backfill_vectors(rows, lambda texts: [[float(len(t))] for t in texts])
    assert {r.cve_id: r.embedding for r in filled.collect()} == {"A": [9.0], "B": [3.0], "C": [0.0]}
