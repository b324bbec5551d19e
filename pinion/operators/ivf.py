"""Inverted-file recall: seeding, Lloyd training and probing of one segment (numpy), and the relational form over segments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinion.errors import invalid
from pinion.functions.metrics import scores
from pinion.schema import COSINE, INNER_PRODUCT, IvfParams

#: Bounds are relaxed by this much, relatively, against rounding.
SLACK = 1e-9


@dataclass
class IvfIndex:
    """Centroids and, per entry, its list. Entries are in internal-id order."""

    metric: str
    centroids: np.ndarray
    lists: np.ndarray

    def populated(self) -> np.ndarray:
        return np.unique(self.lists)


def _best(metric: str, x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Each row's best list, the first of equals."""
    return np.stack([scores(metric, x, c) for c in centroids], 1).argmax(1)


def seeds(metric: str, x: np.ndarray, count: int) -> np.ndarray:
    """First the row least like the mean of all, then always the row whose best score to the seeds is least; first of equals."""
    chosen = [int(scores(metric, x, x.astype(np.float64).mean(0)).argmin())]
    best = scores(metric, x, x[chosen[0]])
    while len(chosen) < count:
        masked = best.copy()
        masked[chosen] = np.inf
        chosen.append(int(masked.argmin()))
        best = np.maximum(best, scores(metric, x, x[chosen[-1]]))
    return x[chosen].astype(np.float64)


def train(metric: str, x: np.ndarray, params: IvfParams) -> IvfIndex:
    """Lists are those of the last assignment; centroids are recomputed after it. An empty list takes the row of its number."""
    count = min(len(x), params.n_list)
    if not count:
        return IvfIndex(metric, np.empty((0, x.shape[1] if x.ndim > 1 else 0)), np.empty(0, np.int64))
    centroids = seeds(metric, x, count)
    for _ in range(params.training_iterations):
        lists = _best(metric, x, centroids)
        centroids = np.stack([x[lists == i].astype(np.float64).mean(0) if (lists == i).any() else x[i].astype(np.float64) for i in range(count)])
    return IvfIndex(metric, centroids, lists)


def bound(metric: str, c: np.ndarray, residual: float, q: np.ndarray) -> float:
    """The best score of any row within `residual` of the centroid; none is known for the cosine."""
    if metric == COSINE:
        return np.inf
    best = c @ q + np.sqrt(q @ q) * residual if metric == INNER_PRODUCT else -max(0.0, np.sqrt(((c - q) ** 2).sum()) - residual)
    return best + SLACK * (1 + abs(best))


def residuals(index: IvfIndex, x: np.ndarray) -> np.ndarray:
    """Each list's largest distance of a row to the centroid; 0 for empty lists."""
    out = np.zeros(len(index.centroids))
    for i in index.populated():
        out[i] = np.sqrt(((x[index.lists == i] - index.centroids[i]) ** 2).sum(1)).max()
    return out


def bounds(index: IvfIndex, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The best score that any row of each list can have."""
    out, far = np.full(len(index.centroids), -np.inf), residuals(index, x)
    for i in index.populated():
        out[i] = bound(index.metric, index.centroids[i], far[i], q)
    return out


def search(index: IvfIndex, x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, n_probe: int) -> list[tuple[int, float]]:
    """(internal id, score): score descending, id ascending. For inner product and L2 lists go on as long as a bound allows."""
    live = index.populated()
    if not len(live):
        return []
    q = q.astype(np.float64)
    near = scores(index.metric, index.centroids[live], q)
    ranked = live[np.lexsort((live, -near))]
    probed = ranked[: min(n_probe, len(ranked))]
    rows = np.flatnonzero(np.isin(index.lists, probed))
    if index.metric != COSINE:
        s = scores(index.metric, x[rows], q)
        cut = np.sort(s)[-k] if len(s) >= k else -np.inf
        more = np.flatnonzero(bounds(index, x, q) >= cut)
        rows = np.flatnonzero(np.isin(index.lists, np.union1d(probed, more)))
    s = scores(index.metric, x[rows], q)
    order = np.lexsort((ids[rows], -s))[:k]
    return [(int(ids[rows[i]]), float(s[i])) for i in order]


def build_lists(segments: DataFrame, metric: str, params: IvfParams) -> DataFrame:
    """(segment_id, _doc_id, vector) -> (segment_id, list, _doc_id, centroid, residual): one training task per segment. The last
    two are in the first row of each list only."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_doc_id")
        x = np.stack(pdf["vector"].to_list())
        index = train(metric, x, params)
        far, centroid, residual = residuals(index, x), [None] * len(x), [None] * len(x)
        for i, at in zip(*np.unique(index.lists, return_index=True), strict=True):
            centroid[at], residual[at] = index.centroids[i].tolist(), float(far[i])
        return pd.DataFrame({"segment_id": pdf["segment_id"].to_numpy(), "list": index.lists, "_doc_id": pdf["_doc_id"].to_numpy(), "centroid": centroid, "residual": residual})

    return segments.select("segment_id", "_doc_id", "vector").groupBy("segment_id").applyInPandas(one, "segment_id long, list int, _doc_id long, centroid array<double>, residual double")


#: Centroids that one row may hold and every executor get.
MOST_CENTROIDS = 65_536


def assign(rows: DataFrame, centroids: DataFrame, similarity, id_col: str, vector: str) -> DataFrame:
    """Rows with their best list: score descending, list ascending. centroids: (list, centroid), at most MOST_CENTROIDS.

    All centroids are one row that is broadcast, and each row's best list is an expression over it: no shuffle.
    """
    if centroids.count() > MOST_CENTROIDS:
        raise invalid(f"more than {MOST_CENTROIDS} centroids")
    one = centroids.agg(F.collect_list(F.struct("list", "centroid")).alias("__all"))
    best = F.array_max(F.transform("__all", lambda c: F.struct(similarity(F.col(vector), c["centroid"]).alias("s"), (-c["list"]).alias("l"))))
    return rows.select(id_col, vector).crossJoin(F.broadcast(one)).withColumn("b", best).select(id_col, (-F.col("b.l")).alias("list"))


def centroid_means(rows: DataFrame, list_col: str, vector: str) -> DataFrame:
    """(list, centroid): means per part, aggregated with map-side combine."""
    parts = rows.select(list_col, F.posexplode(vector).alias("pos", "x")).groupBy(list_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
    return parts.groupBy(F.col(list_col).alias("list")).agg(ordered.alias("centroid"))
