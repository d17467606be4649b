"""A byte-level convolutional network that scores the quality of whole texts.

Each place of a text has two inputs: its byte, and its echo, which tells how long the stretch ending
there already repeats the bytes a few places before it.  A filter covers WIDTH places and adds up
one learned weight for every byte, and one for every echo, at each of them.  It runs over the whole
text in overlapping chunks, its largest response anywhere is what counts (max-pooling), and a
rectified, weighted sum of the pooled responses gives one probability.

The filters are learned with numpy in one task, from at most about FIT_ROWS distinct labelled texts
chosen by digest and at most FIT_BYTES bytes of them; both bounds are parameters.  Back-propagation
reaches only the places that max-pooling has taken.  The weights are some 80 kilobytes; they come to
the driver and go out to the tasks, which score every row.

Defined cases: a null text counts as empty, and an empty one still has the padding around it; equal
texts score alike; without a usable label every text scores 0.5; rows without an id are scored but
not learned from; of an id with several labels the smallest counts; of a repeated row one is
learned from; a text that alone exceeds the byte bound is scored but not learned from; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out
from .shared import batch_of, rows_of, stored, table, whole_text

# Labelled texts, and bytes of them, that the network is fitted on at most.
FIT_ROWS = 4096
FIT_BYTES = 16 << 20

WIDTH = 6
FILTERS = 12
PAD = WIDTH - 1
# Places of a chunk; neighbouring chunks share what a filter and an echo reach over.
CHUNK = 4096

# An echo repeats bytes at most PERIODS places before; levels count runs of 8, 16 and 32 bytes.
PERIODS = 32
LEVELS = 4
REACH = PERIODS + 31

STEPS = 1000
BATCH = 16
RATE = 0.02
SEED = 7

SHARES = 1 << 20


def padded(text: str | None) -> np.ndarray:
    """Bytes of a text between zeros, so that it has a place for every filter."""
    around = np.zeros(PAD, np.uint8)
    return np.concatenate([around, np.frombuffer((text or "").encode(), np.uint8), around])


def echoes(codes: np.ndarray) -> np.ndarray:
    """Level of every place: 1, 2, 3 after a run of 8, 16, 32 bytes that repeats earlier ones."""
    level = np.zeros(len(codes), np.uint8)
    for period in range(1, min(PERIODS, len(codes) - 8) + 1):
        run = codes[period:] == codes[:-period]
        reach = 1
        for step in (1, 2, 4, 8, 16):
            if len(run) <= step:
                break
            run = run[step:] & run[:-step]
            reach += step
            if step >= 4:
                if not run.any():
                    break
                place = level[period + reach - 1 :]
                np.maximum(place, run * np.uint8((4, 8, 16).index(step) + 1), out=place)
    return level


def symbols(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, bytes and echo levels as one number) of each chunk; chunks overlap by PAD."""
    for start in range(0, len(codes) - PAD, CHUNK):
        before = min(start, REACH)
        piece = codes[start - before : start + CHUNK + PAD]
        yield start, (piece[before:] + echoes(piece)[before:].astype(np.intp) * 256)


@dataclass
class Network:
    """Weights: per place of a filter and byte, per place and echo level, per filter, and the sum's."""

    bytes_: np.ndarray
    echoes_: np.ndarray
    floor: np.ndarray
    out: np.ndarray
    base: np.ndarray

    @classmethod
    def fresh(cls, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.05, (WIDTH, 256, FILTERS)),
            np.zeros((WIDTH, LEVELS, FILTERS)),
            np.zeros(FILTERS),
            rng.normal(0, 0.5, FILTERS),
            np.ones(1),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.bytes_, self.echoes_, self.floor, self.out, self.base]

    def packed(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float32).tobytes()

    @classmethod
    def unpacked(cls, held: bytes) -> Network:
        values, parts, at = np.frombuffer(held, np.float32).astype(np.float64), [], 0
        for like in cls.fresh().parts():
            parts.append(values[at : at + like.size].reshape(like.shape))
            at += like.size
        return cls(*parts)

    def filters(self) -> np.ndarray:
        """One table a place of the filter, by echo level and byte."""
        both = self.echoes_[:, :, None, :] + self.bytes_[:, None, :, :]
        return both.reshape(WIDTH, LEVELS * 256, FILTERS).astype(np.float32)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        total = np.maximum(pooled + self.floor, 0) @ self.out + self.base[0]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def pool(chunks, filters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter over all chunks, and where it is."""
    best, at = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.intp)
    for start, chunk in chunks:
        many = len(chunk) - PAD
        response = filters[0][chunk[:many]]
        for place in range(1, WIDTH):
            response += filters[place][chunk[place : place + many]]
        first = response.argmax(axis=0)
        most = response[first, np.arange(FILTERS)]
        at = np.where(most > best, first + start, at)
        best = np.maximum(most, best)
    return best, at


def train(texts: list[str], qualities: list[int], steps: int = STEPS, seed: int = SEED) -> Network:
    """A network fitted by stochastic gradients of the log loss, with Adam's step sizes."""
    network, rng = Network.fresh(seed), np.random.default_rng(seed)
    held = [list(symbols(padded(text))) for text in texts]
    flat = [np.concatenate([c[: len(c) - PAD] for _, c in chunks] + [chunks[-1][1][-PAD:]]) for chunks in held]
    wanted = np.asarray(qualities, float)
    parts = network.parts()
    mean, spread = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    order: list[int] = []
    for step in range(1, steps + 1):
        if len(order) < BATCH:
            order += rng.permutation(len(texts)).tolist()
        batch, order = order[:BATCH], order[BATCH:]
        slopes = [np.zeros_like(p) for p in parts]
        filters = network.filters()
        for n in batch:
            pooled, at = pool(held[n], filters)
            error = (network.probability(pooled) - wanted[n]) / len(batch)
            active = np.maximum(pooled + network.floor, 0)
            reached = error * network.out * (active > 0)
            slopes[2] += reached
            slopes[3] += error * active
            slopes[4] += error
            for place in range(WIDTH):
                symbol = flat[n][at + place]
                slopes[0][place, symbol % 256, np.arange(FILTERS)] += reached
                slopes[1][place, symbol // 256, np.arange(FILTERS)] += reached
        for part, slope, m, s in zip(parts, slopes, mean, spread, strict=True):
            m += 0.1 * (slope - m)
            s += 0.001 * (slope * slope - s)
            part -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return network


def fit_sample(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text and quality of about `rows` distinct labelled documents at most, chosen by digest."""
    known = (
        labels.where("doc_id is not null and quality is not null")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    text = whole_text("text")
    marked = documents.where(F.col("doc_id").isNotNull()).withColumn("mark", F.xxhash64(text))
    found = stored(marked.select("doc_id", "mark").distinct().join(known, "doc_id"), "quality-labels")
    share = min(SHARES, int(rows / max(1, found.count()) * SHARES))
    chosen = found.where(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SHARES)) < share)
    # A share of the distinct keys that makes about `rows`, whatever their number.
    met = marked.select("doc_id", "mark", text.alias("text")).join(F.broadcast(chosen), ["doc_id", "mark"])
    return met.groupBy("doc_id", "mark").agg(F.first("text").alias("text"), F.first("quality").alias("quality"))


def fit(sample: DataFrame, most_bytes: int = FIT_BYTES, steps: int = STEPS) -> Network | None:
    """The network learned from a sample, or None if it has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, qualities, room = [], [], most_bytes
        for batch in batches:
            for text, quality in rows_of(batch):
                size = len(text.encode())
                if size <= room:
                    room -= size
                    texts.append(text)
                    qualities.append(int(quality > 0))
        if texts:
            yield batch_of([(train(texts, qualities, steps).packed(),)], "weights binary")

    one = sample.repartition(1).sortWithinPartitions(F.xxhash64("mark", "doc_id"), "doc_id")
    made = one.select("text", "quality").mapInArrow(run, "weights binary").collect()
    return Network.unpacked(bytes(made[0]["weights"])) if made else None


def score(documents: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shape = "doc_id bigint, held_out boolean, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = network.filters() if network else None
        for batch in batches:
            rows = [
                (
                    doc_id,
                    kept,
                    float(network.probability(pool(symbols(padded(text)), filters)[0])) if network else 0.5,
                )
                for doc_id, kept, text in rows_of(batch)
            ]
            yield batch_of(rows, shape)

    scored = documents.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), "text").mapInArrow(run, shape)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_byte_network(spark, sf_dir: str) -> DataFrame:
    """Quality of every whole document, learned from the labelled ones that are not held out."""
    documents = table(spark, sf_dir, "documents")
    network = fit(fit_sample(documents, table(spark, sf_dir, "labels")))
    return score(documents, network)
