"""Vectors as integers: what the exact search and the compression of codes start from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers up to this size: products of two and sums of many such products stay within 64 bits.
LIMIT = 1 << 24


def _usable(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def integers(vectors: DataFrame, scale: int, vector_column: str, **kept: Column | str) -> DataFrame:
    """The columns named in ``kept`` and, as ``v``, each vector's floor(scale * component), taken in double precision.

    Vectors that are null or hold null or non-finite components are left out. An integer beyond 2^24 either way raises an
    error: it could not be multiplied and added exactly.
    """
    v = F.col(vector_column).cast("array<double>")
    # Filters may be evaluated in any order, so unusable components must not fail here.
    narrow = lambda x: F.abs(x * float(scale)) < float(LIMIT)
    floors = F.transform(v, lambda x: F.when(narrow(x), F.floor(x * float(scale))))
    wide = F.exists(v, lambda x: _usable(x) & ~narrow(x))
    whole = F.when(wide, F.raise_error(F.lit("a vector's integers go beyond 2^24"))).otherwise(floors).cast("array<int>")
    columns = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in kept.items()]
    return vectors.where(v.isNotNull() & F.forall(v, _usable)).select(*columns, whole.alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A column of lists of ``width`` integers as rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``, whole numbers in double precision, as 64-bit integers."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T
