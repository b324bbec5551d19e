"""Distributed union-find: connected components by hooking to the least neighbour, pointer jumping and contraction.

Every round is made of joins and of aggregates with map-side combine, and leaves a smaller graph; nothing but an edge count
reaches the driver. Once FINISH edges or fewer are left, one task of that bounded size ends the work with a union-find.
Each round is cut with a checkpoint, so that lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinion.llm.common import cut

#: Edges (16 bytes each) that one task may finish.
FINISH = 500_000


def union_find(edges: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node's least reachable node."""
    root: dict[int, int] = {}
    for u, v in edges:
        for x in (u, v):
            root.setdefault(x, x)
        while root[u] != u:
            root[u] = u = root[root[u]]
        while root[v] != v:
            root[v] = v = root[root[v]]
        root[max(u, v)] = min(u, v)
    for x in sorted(root):  # a root is smaller than what hangs on it
        root[x] = root[root[x]]
    return root


def _finished(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (e for b in batches for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        root = union_find(edges)
        yield pa.RecordBatch.from_arrays([pa.array(root.keys(), pa.int64()), pa.array(root.values(), pa.int64())], names=["id", "root"])

    return pairs.coalesce(1).mapInArrow(run, "id long, root long")


def _round(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hooks every node to its least neighbour and follows the hooks to their ends: (id, root), and the contracted graph."""
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    root = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("root")))
    while True:  # chains halve each time
        up = root.select(F.col("id").alias("root"), F.col("root").alias("top"))
        jumped = cut(root.join(up, "root").select("id", F.col("top").alias("root"), F.expr("top <> root").alias("moved")))
        root = jumped.select("id", "root")
        if jumped.where("moved").isEmpty():
            break
    at = lambda name, to: root.select(F.col("id").alias(name), F.col("root").alias(to))
    moved = pairs.join(at("u", "ru"), "u").join(at("v", "rv"), "v").where("ru <> rv")
    return root, cut(moved.select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).distinct())


def components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """(src, dst) -> (id, component): component is the least id reachable. Ids without a real edge are absent.

    Self-loops, repeated edges and edges with a null end are ignored; an empty table gives an empty result.
    """
    pairs = edges.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"))
    pairs = cut(pairs.where("u IS NOT NULL AND v IS NOT NULL AND u <> v"))
    labels, left = None, pairs.count()
    while left:
        if left <= finish:
            root, left = cut(_finished(pairs)), 0
        else:
            root, pairs = _round(pairs)
            left = pairs.count()
        if labels is None:
            labels = root
        else:
            up = root.select(F.col("id").alias("root"), F.col("root").alias("top"))
            labels = cut(labels.join(up, "root", "left").select("id", F.coalesce("top", "root").alias("root")))
    if labels is None:
        return pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return labels.select("id", F.col("root").alias("component"))
