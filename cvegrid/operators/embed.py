"""Packing texts into embedding requests and running a caller's embedding function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvegrid.functions.vectors import (
    CHARS_PER_TOKEN,
    MAX_INPUTS_PER_REQUEST,
    MAX_TOKENS_PER_INPUT,
    MAX_TOKENS_PER_REQUEST,
    estimate_tokens,
)
from cvegrid.operators.merge import update_from_batch

Embedder = Callable[[list[str]], list[list[float]]]


class RequestTooLarge(Exception):
    """Raised by an embedding function for a request it wants split."""


def missing_embedding(rows: DataFrame, key: str = "cve_id") -> DataFrame:
    """Rows without a vector, in key order."""
    return rows.where(F.col("embedding").isNull()).select(key, "content").orderBy(key)


# One token fewer than an input may hold: the estimate counts one more than the length gives.
PIECE = (MAX_TOKENS_PER_INPUT - 1) * CHARS_PER_TOKEN


def text_pieces(text: Column) -> Column:
    """The whole text as an array of consecutive pieces that fit one input each."""
    whole = F.coalesce(text, F.lit(""))
    last = F.floor((F.greatest(F.length(whole), F.lit(1)) - 1) / PIECE).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda n: F.substring(whole, n * PIECE + 1, F.lit(PIECE)))


def token_batches(
    rows: DataFrame,
    order: str,
    text: str = "content",
    max_tokens: int = MAX_TOKENS_PER_REQUEST,
    max_items: int = MAX_INPUTS_PER_REQUEST,
) -> DataFrame:
    """Request number of every piece of every text under greedy packing in row order.

    A text longer than one input is cut into pieces, and every piece is packed.  Loads hand
    texts over in runs of ``max_items`` consecutive rows and pack each run by itself, so a run
    is the unit here: ``order`` is a unique integer and a run is one block of it.  A run holds
    the sizes of at most ``max_items`` texts, whatever the corpus, and only sizes are gathered,
    not texts.  A piece over the budget gets a request of its own.
    """
    sized = rows.select(F.col(order), F.posexplode(text_pieces(F.col(text))).alias("piece", "part")).select(
        F.floor(F.col(order) / max_items).cast("bigint").alias("run"),
        F.struct(
            F.col(order).alias("position"), "piece", estimate_tokens(F.col("part")).cast("bigint").alias("tokens")
        ).alias("item"),
    )
    runs = sized.groupBy("run").agg(F.array_sort(F.collect_list("item")).alias("items"))
    start = F.struct(
        F.lit(0).alias("request"),
        F.lit(0).cast("bigint").alias("used"),
        F.lit(0).alias("held"),
        F.array().cast("array<int>").alias("placed"),
    )

    def place(state: Column, item: Column) -> Column:
        full = (state["held"] > 0) & (
            (state["used"] + item["tokens"] > max_tokens) | (state["held"] >= max_items)
        )
        request = state["request"] + F.when(full, 1).otherwise(0)
        return F.struct(
            request.alias("request"),
            (F.when(full, F.lit(0)).otherwise(state["used"]) + item["tokens"]).cast("bigint").alias("used"),
            (F.when(full, F.lit(0)).otherwise(state["held"]) + 1).alias("held"),
            F.array_append(state["placed"], request).alias("placed"),
        )

    packed = runs.select("run", "items", F.aggregate("items", start, place, lambda s: s["placed"]).alias("placed"))
    return packed.select("run", F.explode(F.arrays_zip("items", "placed")).alias("p")).select(
        F.col("p.items.position").alias(order),
        F.col("p.items.piece").cast("bigint").alias("piece"),
        "run",
        F.col("p.placed").alias("request"),
        F.col("p.items.tokens").alias("tokens"),
    )


def _grouped(parts: Iterator[tuple], max_tokens: int, max_items: int) -> Iterator[list[tuple]]:
    """Parts in requests, each closed by the first part that doesn't fit any more."""
    request: list[tuple] = []
    room = max_tokens
    for part in parts:
        need = len(part[1]) // CHARS_PER_TOKEN + 1
        if request and (need > room or len(request) == max_items):
            yield request
            request, room = [], max_tokens
        request.append(part)
        room -= need
    if request:
        yield request


def _answered(embed: Embedder, texts: list[str]) -> list[list[float]]:
    """Vectors of all texts in order; what the function refuses is asked again in halves."""
    vectors: list[list[float]] = []
    waiting = [texts]
    while waiting:
        part = waiting.pop()
        try:
            found = embed(part)
        except RequestTooLarge:
            if len(part) < 2:
                raise
            half = len(part) // 2
            waiting += [part[half:], part[:half]]
            continue
        if len(found) != len(part):
            raise ValueError(f"embedding function returned {len(found)} vectors for {len(part)} texts")
        vectors += found
    return vectors


def embed_texts(
    rows: DataFrame,
    embed: Embedder,
    key: str = "cve_id",
    text: str = "content",
    max_tokens: int = MAX_TOKENS_PER_REQUEST,
    max_items: int = MAX_INPUTS_PER_REQUEST,
) -> DataFrame:
    """One vector per row from a caller's function, which sees request-sized lists of texts.

    Every character is embedded: a long text goes in as pieces, and its vector is the sum of
    theirs, which for a cosine is their mean.  Each task packs its own stream of pieces; a
    request the function refuses is halved until it passes.  Only key and text go through Python.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Pieces of a row follow each other; the last one closes it.
        parts = (
            ((row_key, n + 1 == len(pieces)), piece)
            for frame in frames
            for row_key, pieces in zip(frame[key], frame["pieces"], strict=True)
            for n, piece in enumerate(pieces)
        )
        total = None
        for request in _grouped(parts, max_tokens, max_items):
            done = []
            vectors = _answered(embed, [piece for _, piece in request])
            for ((row_key, closes), _), vector in zip(request, vectors, strict=True):
                total = vector if total is None else [a + b for a, b in zip(total, vector, strict=True)]
                if closes:
                    done.append((row_key, total))
                    total = None
            yield pd.DataFrame(done, columns=[key, "embedding"])

    pieces = rows.select(key, text_pieces(F.col(text)).alias("pieces"))
    return pieces.mapInPandas(run, f"{key} {kind}, embedding array<float>")


def embed_requests(
    rows: DataFrame,
    embed: Embedder,
    order: str,
    text: str = "content",
    max_tokens: int = MAX_TOKENS_PER_REQUEST,
    max_items: int = MAX_INPUTS_PER_REQUEST,
) -> DataFrame:
    """One vector per row, asked for in exactly the requests of ``token_batches``.

    The request is the grouping key: a task gets the pieces of one request in their order, never
    more than fit it, and a failed task asks for the same requests again.  Within a request the
    vectors of a long text's pieces are added up, then those of its requests, so every character
    is embedded.  ``order`` is the rows' unique integer.
    """
    kind = rows.schema[order].dataType.simpleString()
    pieces = rows.select(order, F.posexplode(text_pieces(F.col(text))).alias("piece", "part"))
    packed = token_batches(rows, order, text, max_tokens, max_items).join(
        pieces.withColumn("piece", F.col("piece").cast("bigint")), [order, "piece"]
    )

    def answer(request: pd.DataFrame) -> pd.DataFrame:
        request = request.sort_values([order, "piece"])
        sums: dict = {}
        for row_key, vector in zip(request[order], _answered(embed, request["part"].tolist()), strict=True):
            held = sums.get(row_key)
            sums[row_key] = vector if held is None else [a + b for a, b in zip(held, vector, strict=True)]
        named = {"run": request["run"].iloc[0], "request": request["request"].iloc[0]}
        return pd.DataFrame({order: list(sums), **named, "vector": list(sums.values())})

    columns = f"{order} {kind}, run bigint, request int, vector array<double>"
    asked = packed.select(order, "piece", "run", "request", "part").groupBy("run", "request").applyInPandas(answer, columns)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("run", "request", "vector"))), lambda p: p["vector"])
    total = F.aggregate(
        F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))),
        F.get("parts", F.lit(0)),
        lambda held, more: F.zip_with(held, more, lambda a, b: a + b),
    )
    return asked.groupBy(order).agg(parts.alias("parts")).select(order, total.cast("array<float>").alias("embedding"))


def backfill_vectors(rows: DataFrame, embed: Embedder, key: str = "cve_id") -> DataFrame:
    """The table with vectors computed for the rows that lack one; only those rows move."""
    lacking = rows.where(F.col("embedding").isNull())
    fresh = embed_texts(lacking, embed, key)
    filled = update_from_batch(lacking, fresh, [key], "embedding")
    return rows.where(F.col("embedding").isNotNull()).unionByName(filled)
