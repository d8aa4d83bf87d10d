"""Vector expressions over ARRAY<FLOAT> columns, in double precision.

Two columns are compared by built-in array functions. A column is compared with one fixed query by an Arrow function, an array product for each
batch: array functions are interpreted element by element in the JVM, and written-out sums take longer to compile than to run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_vector(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a null, a zero vector, another length or non-finite elements."""
    c = F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))
    return F.when(~F.isnan(c) & (F.abs(c) <= 1.5), c)


def strict_cosine(a: Column, b: Column) -> Column:
    """Cosine similarity that fails on different lengths."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b))).otherwise(F.raise_error(F.lit("vectors differ in length")))


def l2(a: Column, b: Column) -> Column:
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(d))


def _matrix(v: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column with ``dim`` elements: their positions and their matrix in double precision (nulls within are NaN)."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    off = np.asarray(v.offsets.to_numpy(zero_copy_only=False), np.int64)
    ok = np.flatnonzero((np.diff(off) == dim) & np.asarray(v.is_valid().to_numpy(zero_copy_only=False), bool))
    flat = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return ok, flat[off[ok][:, None] + np.arange(dim)] if len(ok) else np.zeros((0, dim))


def _scored(column: str | Column, query: Sequence[float], score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Column:
    q = np.asarray(query, np.float64)

    @F.arrow_udf("double")
    def run(v: pa.Array) -> pa.Array:
        ok, m = _matrix(v, len(q))
        out, there = np.zeros(len(v)), np.zeros(len(v), bool)
        with np.errstate(all="ignore"):
            x = score(m, q)
        out[ok], there[ok] = x, np.isfinite(x)
        return pa.array(out, pa.float64(), mask=~there)

    return run(F.col(column) if isinstance(column, str) else column)


def dot_to(column: str | Column, query: Sequence[float]) -> Column:
    """Inner product with a fixed query, one array product for each Arrow batch; null where it is none or not finite."""
    return _scored(column, query, lambda m, q: m @ q)


def cosine_to(column: str | Column, query: Sequence[float]) -> Column:
    """``cosine`` of a column and a fixed query, a batch at a time: null for a null, a zero vector, another length or non-finite elements."""
    return _scored(column, query, lambda m, q: (m @ q) / (np.sqrt(np.einsum("ij,ij->i", m, m)) * np.sqrt(q @ q)))


def l2_to(column: str | Column, query: Sequence[float]) -> Column:
    return _scored(column, query, lambda m, q: np.sqrt(np.square(m - q).sum(axis=1)))


def parse_vector(text: Column) -> Column:
    """A vector printed as ``[1.0,2.0]``; null where it cannot be read."""
    return F.from_json(text, "array<float>")
