"""Exact search: a score Column, a filter before it, and a bounded sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinion.functions.metrics import literal, score


def exact_top_k(rows: DataFrame, metric: str, query: list[float] | Column, k: int, vector: str = "vector", id_col: str = "id", out: str = "_score") -> DataFrame:
    """The k best rows, score descending, ties by id. Becomes TakeOrderedAndProject: k rows per task reach the last one."""
    q = query if isinstance(query, Column) else literal(query)
    return rows.withColumn(out, score(metric, F.col(vector), q)).orderBy(F.desc(out), id_col).limit(k)


def top_k_per(rows: DataFrame, group: str, k: int, order: list, keep_ties: bool = False) -> DataFrame:
    """The k first rows of every group; with keep_ties all that equal the k-th in the first ordering column."""
    rank = F.rank().over(W.partitionBy(group).orderBy(order[0])) if keep_ties else F.row_number().over(W.partitionBy(group).orderBy(*order))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def merge_top_k(hits: DataFrame, k: int, score_col: str = "_score", id_col: str = "id") -> DataFrame:
    """Hits of all segments, merged: score descending, public id ascending."""
    return hits.orderBy(F.desc(score_col), id_col).limit(k)
