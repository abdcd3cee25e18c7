"""Kernel machines on all dimensions: Nystroem features from landmark rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import LinearSVC
from pyspark.sql import DataFrame, functions as F

from weftwork.functions.hashing import row_hash
from weftwork.operators.vectorize import rows_of, with_column
from weftwork.session import write_once

#: Landmarks at most; a task holds them and a square matrix of their number.
LANDMARKS = 256


def kernel_matrix(a: np.ndarray, b: np.ndarray, kernel: str, gamma: float, degree: int = 3, coef0: float = 0.0) -> np.ndarray:
    """exp(-gamma |x - y|^2) for ``rbf``, (gamma x y + coef0)^degree for ``poly``."""
    if kernel == "rbf":
        sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
        return np.exp(-gamma * np.maximum(sq, 0.0))
    if kernel == "poly":
        return (gamma * (a @ b.T) + coef0) ** degree
    raise ValueError(f"unknown kernel {kernel}; one of rbf, poly")


def pick_landmarks(df: DataFrame, id_col: str, features: str = "features", n: int = LANDMARKS, seed: int = 42) -> np.ndarray:
    """``n`` rows of least hash, each vector once."""
    if not 0 < n <= LANDMARKS:
        raise ValueError(f"between 1 and {LANDMARKS} landmarks")
    rows = df.select(id_col, features).withColumn("_h", row_hash(id_col, seed)).orderBy("_h", id_col).limit(n).select(features).collect()
    return np.unique(np.array([r[0].toArray() for r in rows]), axis=0)


def nystroem_map(landmarks: np.ndarray, kernel: str, **shape) -> np.ndarray:
    """The matrix that turns kernel values against the landmarks into features whose inner products
    approximate the kernel, exactly so between landmarks."""
    values, vectors = np.linalg.eigh(kernel_matrix(landmarks, landmarks, kernel, **shape))
    keep = values > 1e-10 * max(values.max(), 1e-300)
    return vectors[:, keep] / np.sqrt(values[keep])


def nystroem_features(df: DataFrame, landmarks: np.ndarray, kernel: str, features: str = "features", name: str = "kernel", **shape) -> DataFrame:
    """``df`` with a vector column of Nystroem features, in Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast((landmarks, nystroem_map(landmarks, kernel, **shape)))  # LANDMARKS rows

    def add(batch):
        import pyarrow as pa

        marks, turn = shared.value
        starts, indices, values = rows_of(batch.column(batch.schema.get_field_index(features)))
        n = len(starts) - 1
        x = np.zeros((n, marks.shape[1]))
        x[np.repeat(np.arange(n), np.diff(starts)), indices] = values
        out = kernel_matrix(x, marks, kernel, **shape) @ turn
        offsets = pa.array(np.arange(n + 1) * out.shape[1], pa.int32())
        return pa.StructArray.from_arrays(
            [pa.array(np.ones(n, np.int8)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))],
            names=["type", "size", "indices", "values"])

    return with_column(df, name, add)


def fit_kernel_svm(
    df: DataFrame, id_col: str, kernel: str = "rbf", gamma: float | None = None, degree: int = 3, coef0: float = 0.0,
    landmarks: int = LANDMARKS, C: float = 1.0, seed: int = 42, max_iter: int = 100,
) -> tuple[object, Callable[[DataFrame], DataFrame]]:
    """(model, function adding the model's input column to a frame): a support vector machine with a
    kernel over all dimensions. ``gamma``: 1 / (dimensions * variance of all values) unless given."""
    from pyspark.ml.functions import vector_to_array

    if gamma is None:
        v = F.explode(vector_to_array("features"))
        row = df.select(v.alias("v")).agg(F.var_pop("v").alias("s"), F.count(F.lit(1)).alias("n")).first()
        gamma = 1.0 / max(row["n"] / max(df.count(), 1) * row["s"], 1e-12)
    shape = {"gamma": gamma} | ({"degree": degree, "coef0": coef0} if kernel == "poly" else {})
    marks = pick_landmarks(df, id_col, n=landmarks, seed=seed)
    prepare = lambda d: nystroem_features(d, marks, kernel, **shape)
    rows = write_once(prepare(df).select("kernel", "label"))
    return LinearSVC(featuresCol="kernel", regParam=1.0 / (C * max(rows.count(), 1)), maxIter=max_iter).fit(rows), prepare
