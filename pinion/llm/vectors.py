"""What the vector operators share: which vectors take part, and how their arrays reach numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VALID = (
    "size({c}) > 0 AND NOT exists({c}, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists({c}, x -> x <> 0)"
)


def numbers(df: DataFrame, vec_col: str) -> str:
    """The type that vectors are moved in: single precision if they are stored so, which loses nothing, else double."""
    return "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"


def all_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, valid): valid rows have an id and a vector that is not null, not zero and finite throughout."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(numbers(df, vec_col)).alias("vec"))
    return rows.withColumn("valid", F.coalesce(F.expr(f"id IS NOT NULL AND vec IS NOT NULL AND {VALID.format(c='vec')}"), F.lit(False)))


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the valid rows."""
    return all_vectors(df, id_col, vec_col).where("valid").select("id", "vec")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest part first, so that tiny and huge vectors keep their direction."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
