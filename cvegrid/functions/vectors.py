"""Distances and text sizing for embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of an embedding request.
MAX_TOKENS_PER_REQUEST = 250_000
MAX_TOKENS_PER_INPUT = 8_191
MAX_INPUTS_PER_REQUEST = 500
CHARS_PER_TOKEN = 2

# Distances are compared at this many places, so equal vectors tie wherever they sit in a
# batch and the id decides.
DISTANCE_PLACES = 9


def estimate_tokens(text: Column) -> Column:
    """Upper bound of the token count, from the length alone."""
    return F.floor(F.length(text) / CHARS_PER_TOKEN).cast("int") + 1


def truncate_text(text: Column) -> Column:
    """Text cut to what one embedding input may hold."""
    return F.substring(text, 1, MAX_TOKENS_PER_INPUT * CHARS_PER_TOKEN)


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, product: total + product)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b) of two vector columns; NULL for a missing or zero vector."""
    return F.lit(1.0) - F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def unit(vector: Column) -> Column:
    """The vector as doubles of length one."""
    norm = F.sqrt(_dot(vector, vector))
    return F.transform(vector, lambda x: F.try_divide(x.cast("double"), norm))


def as_matrix(vectors: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrow lists as a float matrix and the mask of rows that hold a vector."""
    present = vectors.is_valid().to_numpy(zero_copy_only=False)
    held = vectors.drop_null()
    values = held.flatten().to_numpy(zero_copy_only=False).astype("float64")
    if len(values) != len(held) * width or any(n != width for n in np.diff(held.offsets.to_numpy())):
        raise ValueError(f"every vector must have {width} numbers")
    return values.reshape(len(held), width), present


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row becomes NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def distance_to(vector: Column, query: list[float]) -> Column:
    """Cosine distance of a vector column to one query vector, one matrix product per batch.

    Only the vector column crosses to Python; ids and texts stay in the JVM.
    """
    width = len(query)
    target = unit_rows(np.asarray([query], dtype="float64"))[0]

    @F.arrow_udf("double")
    def distance(vectors: pa.Array) -> pa.Array:
        matrix, present = as_matrix(vectors, width)
        result = np.full(len(vectors), np.nan)
        result[present] = np.round(1.0 - unit_rows(matrix) @ target, DISTANCE_PLACES)
        return pa.array(result, mask=np.isnan(result), type=pa.float64())

    return distance(vector)
