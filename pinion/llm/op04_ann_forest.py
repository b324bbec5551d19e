"""Approximate nearest neighbours by a forest of random-projection trees.

Rows are dealt into blocks. Within a block TREES trees split the vectors at the medians of random projections down to LEAF
vectors. A query descends all trees through one priority queue, ordered by the least margin on the way to a node, and
collects leaves until SHARE of the block's rows are candidates; these are ranked by exact cosine in double precision.
The best of all blocks are merged. Every row is indexed. A block's rows come to its task first and are indexed once; queries
then stream by, CHUNK at a time, so memory is bounded by BLOCK rows and CHUNK queries.

SHARE is large because a random projection says little about directions that are spread evenly: on such vectors a forest
of this kind needs about half of all rows for a recall of 0.9, whatever the number of trees (see the README).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinion.llm.common import small, table
from pinion.llm.vectors import matrix, unit, valid_vectors

K, QUERY_STEP = 5, 50
TREES, LEAF, SHARE = 12, 160, 0.7
BLOCK, CHUNK = 32_768, 512


class Forest:
    def __init__(self, x: np.ndarray, seed: int, trees: int = TREES, leaf: int = LEAF):
        """x: unit rows. Nodes are numbered over all trees; below[k] holds a node's two children, a leaf's is ~its number."""
        rng = np.random.default_rng(seed)
        self.n = len(x)
        self.roots: list[int] = []
        self.leaves: list[np.ndarray] = []
        planes, bounds, below = [], [], []

        def grow(at: np.ndarray) -> int:
            if len(at) > leaf:
                for _ in range(3):
                    w = rng.normal(size=x.shape[1])
                    w /= np.linalg.norm(w)
                    p = x[at] @ w
                    t = float(np.median(p))
                    low = p <= t
                    if low.all():  # many equal values at the median
                        low = p < t
                    if low.any() and not low.all():
                        k = len(planes)
                        planes.append(w)
                        bounds.append(t)
                        below.append((0, 0))
                        below[k] = (grow(at[low]), grow(at[~low]))
                        return k
            self.leaves.append(at)  # small, or vectors that no plane tells apart
            return ~(len(self.leaves) - 1)

        for _ in range(trees):
            self.roots.append(grow(np.arange(len(x))))
        self.planes = np.array(planes).reshape(-1, x.shape[1])
        self.bounds, self.below = np.array(bounds), below

    def candidates(self, margins: np.ndarray, least: int) -> np.ndarray:
        """Rows of the leaves that one queue over all trees reaches first, at least `least` of them. margins: of all planes."""
        queue = [(-np.inf, r) for r in self.roots]
        heapq.heapify(queue)
        seen, count = np.zeros(self.n, bool), 0
        below, leaves, pop, push = self.below, self.leaves, heapq.heappop, heapq.heappush
        m = margins.tolist()
        while queue and count < least:
            cost, k = pop(queue)
            while k >= 0:  # on to the nearer side; the other side waits at the price of the margin
                near, far = below[k] if m[k] <= 0 else below[k][::-1]
                push(queue, (max(cost, abs(m[k])), far))
                k = near
            own = leaves[~k]
            count += len(own) - int(np.count_nonzero(seen[own]))
            seen[own] = True
        return np.flatnonzero(seen)


def nearest(q: np.ndarray, qid: np.ndarray, forest: Forest, x: np.ndarray, ids: np.ndarray, k: int, share: float) -> tuple[list, list, list]:
    """For each query the k nearest found among x: (query, id, score), by cosine and then id."""
    out: tuple[list, list, list] = ([], [], [])
    least = min(len(x), max(int(np.ceil(share * len(x))), 40 * k))
    margins = q @ forest.planes.T - forest.bounds
    for i in range(len(q)):
        at = forest.candidates(margins[i], least)
        at = at[ids[at] != qid[i]]
        if not len(at):
            continue
        s = x[at] @ q[i]
        if len(at) > k:
            at = at[s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9]  # and all that may tie
        s = np.einsum("ij,j->i", x[at], q[i])
        first = np.lexsort((ids[at], -s))[:k]
        out[0].extend([qid[i]] * len(first))
        out[1].extend(ids[at][first])
        out[2].extend(s[first])
    return out


def ann_search(vectors: DataFrame, queries: DataFrame, k: int = K, share: float = SHARE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found rows beside itself, largest cosine first, then least id.

    Vectors that are null, empty, zero or hold null or non-finite parts take no part, on either side, nor do rows with a null
    id; vectors are compared with those of their own length. Repeated rows count each; ties go to the least id. Empty tables
    give an empty result; other columns are ignored, whatever their names.
    """
    rows, asked = valid_vectors(vectors, id_col, vec_col), valid_vectors(queries, id_col, vec_col)
    n, m = rows.count(), asked.count()
    # copies of a block share its queries where there are fewer blocks than tasks that can run
    blocks = max(1, -(-n // BLOCK))
    copies = max(1, min(-(-m // CHUNK), vectors.sparkSession.sparkContext.defaultParallelism // blocks))
    block = F.pmod(F.xxhash64("id", "vec", F.lit(1)), F.lit(blocks))
    copy = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(copies))
    right = rows.select("id", "vec", F.size("vec").alias("d"), F.lit(False).alias("q"), block.alias("b"), F.explode(F.expr(f"sequence(0L, {copies - 1}L)")).alias("c"))
    left = asked.select("id", "vec", F.size("vec").alias("d"), F.lit(True).alias("q"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("b"), copy.alias("c"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, x, forest = None, [], [], None
        for batch in small(batches, CHUNK):
            b, c, d, q = (batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False) for name in ("b", "c", "d", "q"))
            change = np.flatnonzero((b[1:] != b[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1]) | (q[1:] != q[:-1])) + 1
            for s, e in zip([0, *change], [*change, len(b)], strict=True):
                if s == e:
                    continue
                own, vec = batch.column(0).slice(s, e - s).to_numpy(), unit(matrix(batch.column(1).slice(s, e - s)))
                if key != (b[s], c[s], d[s]):
                    key, ids, x, forest = (b[s], c[s], d[s]), [], [], None
                if not q[s]:
                    ids.append(own)
                    x.append(vec)
                elif len(ids):
                    if forest is None:
                        ids, x = np.concatenate(ids), np.concatenate(x)
                        forest = Forest(x, seed=int(b[s]))
                    out = nearest(vec, own, forest, x, ids, k, share)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    dealt = right.union(left).repartition(max(1, blocks * copies), "b", "c").sortWithinPartitions("b", "c", "d", "q", "id")
    found = dealt.select("id", "vec", "d", "q", "b", "c").mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann_search(rows, rows.where(F.col("vec_id") % QUERY_STEP == 0))
