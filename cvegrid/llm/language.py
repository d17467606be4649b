"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1.  A trigram's vector binds those of its
letters: the first moved round by two places, the second by one, the third as it is, multiplied.
A text's profile bundles (adds up) the vectors of all its trigrams, a language's prototype those
of all its training texts, and the predicted language is the one whose prototype has the largest
cosine with the text's profile.  Words are lower-cased runs of letters and marks, one space apart.

Learning covers every training row: tasks add up one profile a language, Spark adds those up
place by place, and one vector a language comes to the driver and goes out to the tasks, so
their number of languages, not of documents, bounds its size.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every text if
nothing was learned; of languages that score alike the first in code-point order is taken; a
null doc_id counts as the empty text in the split; rows may repeat and are predicted alike; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_of, rows_of, table

DIMENSIONS = 1024
SEED = 7
# Texts, and characters, whose trigrams are counted together.
TEXTS_AT_ONCE = 64
PIECE = 1 << 18
KEPT_LETTERS = 20_000
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}\p{M}]+")
CODE_BITS = 21


def spelled(text: str | None) -> str:
    """Lower-case words with a space around each; empty without any letter."""
    if not text or not LETTER.search(text):
        return ""
    return f" {OTHER.sub(' ', text.lower()).strip()} "


class Profiles:
    """Profiles of texts; keeps the vectors of the letters it has met."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        self.dimensions = dimensions
        self.seed = seed
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= KEPT_LETTERS:
                self.letters.clear()
            made = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, np.int8)
            self.letters[code] = 2 * made - 1
        return self.letters[code]

    def trigrams(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of trigrams given as packed code points."""
        low = (1 << CODE_BITS) - 1
        parts = [keys >> 2 * CODE_BITS, keys >> CODE_BITS & low, keys & low]
        codes, at = np.unique(np.concatenate(parts), return_inverse=True)
        vectors = np.stack([self.letter(int(c)) for c in codes])
        first, second, third = at.reshape(3, -1)
        return np.roll(vectors, 2, axis=1)[first] * np.roll(vectors, 1, axis=1)[second] * vectors[third]

    def bundle(self, texts: Iterable[str], owners: Iterable[int], many: int) -> np.ndarray:
        """Summed trigram vectors of each owner's texts."""
        found = np.zeros((many, self.dimensions))
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if held:
                keys, at = np.unique(np.concatenate([k for _, k in held]), return_inverse=True)
                whose = np.repeat([o for o, _ in held], [len(k) for _, k in held])
                rows, row_of = np.unique(whose, return_inverse=True)
                counts = np.bincount(row_of * len(keys) + at, minlength=len(rows) * len(keys))
                counts = counts.reshape(len(rows), len(keys)).astype(np.float32)
                found[rows] += counts @ self.trigrams(keys).astype(np.float32)
                held.clear()

        size = 0
        for text, owner in zip(texts, owners, strict=True):
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
            for start in range(0, max(len(codes) - 2, 0), PIECE):
                piece = codes[start : start + PIECE + 2]
                held.append((owner, piece[:-2] << 2 * CODE_BITS | piece[1:-1] << CODE_BITS | piece[2:]))
                size += len(piece)
                if size >= PIECE or len(held) >= TEXTS_AT_ONCE:
                    flush()
                    size = 0
        flush()
        return found


def held_out() -> F.Column:
    """Whether a row is kept from learning."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def learn(labelled: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes by language, from columns text and lang."""
    shape = "lang string, profile array<bigint>"

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Profiles(dimensions, seed)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            rows = [(spelled(text), lang) for text, lang in rows_of(batch)]
            langs = sorted({lang for _, lang in rows})
            number = {lang: n for n, lang in enumerate(langs)}
            found = made.bundle([t for t, _ in rows], [number[lang] for _, lang in rows], len(langs))
            for lang, profile in zip(langs, found, strict=True):
                sums[lang] = sums.get(lang, 0) + profile
        yield batch_of([(lang, profile.astype(np.int64).tolist()) for lang, profile in sums.items()], shape)

    parts = labelled.select("text", "lang").where("text is not null and lang is not null").mapInArrow(profiles, shape)
    placed = parts.select("lang", F.posexplode("profile").alias("place", "value"))
    sums = placed.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    prototypes: dict[str, np.ndarray] = {}
    for lang, place, value in sums.collect():
        prototypes.setdefault(lang, np.zeros(dimensions))[place] = value
    return dict(sorted(prototypes.items()))


def predict(
    documents: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, seed: int = SEED
) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shape = "doc_id bigint, held_out boolean, lang_pred string, score double"
    langs = [lang for lang, p in prototypes.items() if p.any()]
    units = np.array([prototypes[lang] / np.linalg.norm(prototypes[lang]) for lang in langs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Profiles(dimensions, seed)
        for batch in batches:
            rows = [(doc_id, kept, spelled(text)) for doc_id, kept, text in rows_of(batch)]
            found = made.bundle([t for _, _, t in rows], range(len(rows)), len(rows))
            lengths = np.linalg.norm(found, axis=1)
            known = (lengths > 0) & bool(langs)
            best, score = np.zeros(len(rows), int), np.zeros(len(rows))
            if known.any():
                cosines = found[known] @ units.T / lengths[known, None]
                best[known] = cosines.argmax(axis=1)
                score[known] = cosines.max(axis=1).clip(0, 1)
            answers = [
                (doc_id, kept, langs[b] if k else UNDETERMINED, float(s))
                for (doc_id, kept, _), b, k, s in zip(rows, best, known, score, strict=True)
            ]
            yield batch_of(answers, shape)

    return documents.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, shape)


def op2_hyperdimensional(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every whole document, learned from those not held out."""
    documents = table(spark, sf_dir, "documents")
    prototypes = learn(documents.where(~held_out()))
    return predict(documents, prototypes)
