"""Scores as Columns: double accumulation from left to right, cast to float; higher is always better."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pinion.schema import COSINE, INNER_PRODUCT, L2


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2_norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """0 where either norm is 0."""
    norms = l2_norm(a) * (l2_norm(b) if norm_b is None else norm_b)
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(norms, F.lit(0.0)))


def literal(vector: list[float]) -> Column:
    """A query vector as float32, which is what collections store."""
    return F.array(*[F.lit(float(x)).cast("float") for x in vector])


def score(metric: str, a: Column, b: Column) -> Column:
    """Cosine similarity, inner product, or the negative Euclidean distance (plus 0.0, so that there is no -0.0)."""
    if metric == COSINE:
        out = cosine(a, b)
    elif metric == INNER_PRODUCT:
        out = dot(a, b)
    elif metric == L2:
        out = -F.sqrt(squared_l2(a, b)) + F.lit(0.0)
    else:
        raise ValueError(f"unknown metric {metric}")
    return out.cast("float")


def scores(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The same for numpy rows, in double precision."""
    x, q = x.astype(np.float64), q.astype(np.float64)
    if metric == INNER_PRODUCT:
        return x @ q
    if metric == L2:
        return -np.sqrt(((x - q) ** 2).sum(-1)) + 0.0
    norms = np.sqrt((x * x).sum(-1)) * np.sqrt((q * q).sum())
    return np.divide(x @ q, norms, out=np.zeros(len(x)), where=norms != 0)
