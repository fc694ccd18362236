"""Features for kernel classifiers: a linear model on them separates what lies around each other.

Random Fourier features (Rahimi & Recht, 2007): cosines of random projections, whose products approach the kernel
exp(-gamma * squared distance) with an error of about 1 / sqrt(dims). One narrow pass, one matrix product per batch; the
learners of :mod:`corpusloom.operators.learn` train on the result as on any other vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

ROWS_AT_ONCE = 512


def kernel_width(df: DataFrame, vec: str) -> float:
    """1 / (length of the vectors * variance of all their numbers), the usual choice of gamma; 1 without variance."""
    values = F.col(vec).cast("array<double>")
    power = lambda p: F.aggregate(values, F.lit(0.0), lambda total, x: total + x**p)
    n, length, one, two = df.where(F.col(vec).isNotNull()).agg(F.sum(F.size(values)), F.max(F.size(values)), F.sum(power(1)), F.sum(power(2))).first()
    variance = two / n - (one / n) ** 2 if n else 0.0
    return 1 / (length * variance) if variance > 0 else 1.0


def rbf_features(df: DataFrame, vec: str, out: str = "rbf", dims: int = 512, gamma: float | None = None, seed: int = 7) -> DataFrame:
    """Add ``out``, an ``array<double>`` of ``dims`` numbers; products of two rows approach the kernel of their vectors.

    ``gamma`` defaults to :func:`kernel_width`, which reads the vectors once. The same ``seed``, ``gamma`` and ``dims`` give
    the same features for the same vector everywhere, so models can be kept. Null vectors stay null; vectors of different
    lengths are an error. A column named like ``out`` is replaced.
    """
    if dims < 1:
        raise ValueError("dims must be 1 at least")
    width = gamma if gamma is not None else kernel_width(df, vec)
    return df.withColumn(out, _project(F.col(vec).cast("array<double>"), dims, width, seed))


def _project(vectors: Column, dims: int, gamma: float, seed: int) -> Column:
    @F.arrow_udf("array<double>")
    def project(column: pa.Array) -> pa.Array:
        known = column.drop_null()
        lengths = np.unique(known.value_lengths().to_numpy(zero_copy_only=False))
        if len(lengths) > 1:
            raise ValueError("vectors must all have the same length")
        length = int(lengths[0]) if len(lengths) else 0
        draw = np.random.Generator(np.random.PCG64(seed))
        shift = draw.uniform(0, 2 * np.pi, dims)
        weights = draw.normal(0, np.sqrt(2 * gamma), (length, dims))
        x = known.flatten().to_numpy(zero_copy_only=False).reshape(len(known), length)
        z = np.empty((len(known), dims))
        for start in range(0, len(known), ROWS_AT_ONCE):  # in place, so that only the result is held
            part = z[start : start + ROWS_AT_ONCE]
            np.matmul(x[start : start + ROWS_AT_ONCE], weights, out=part)
            part += shift
            np.cos(part, out=part)
            part *= np.sqrt(2 / dims)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        offsets = np.append(0, np.cumsum(valid * dims)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(z.reshape(-1)), mask=pa.array(~valid))

    return project(vectors)
