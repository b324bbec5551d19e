"""Graph recall: a layered small-world graph per segment. Pure Python kernels over numpy scores; deterministic."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pinion.functions.metrics import scores
from pinion.schema import HnswParams

#: Fixed values of the level hash (a public 64-bit finalizer) and the highest level.
GOLDEN, MULTIPLY_1, MULTIPLY_2, TOP_LEVEL, MASK = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 15, (1 << 64) - 1


def node_level(node: int, doc_id: int, scaling: int) -> int:
    x = (node ^ (doc_id * GOLDEN & MASK)) & MASK
    x = (x ^ (x >> 30)) * MULTIPLY_1 & MASK
    x = (x ^ (x >> 27)) * MULTIPLY_2 & MASK
    u = ((x ^ (x >> 31)) + 1) / 2.0**64
    return min(TOP_LEVEL, int(-math.log(min(max(u, 5e-324), 1.0)) / math.log(scaling)))


class Graph:
    """Nodes in insertion order; edges[level][node] are neighbours. Better scores come first, ties by lower internal id."""

    def __init__(self, metric: str, x: np.ndarray, ids: np.ndarray, params: HnswParams):
        self.metric, self.x, self.ids, self.p = metric, x.astype(np.float64), ids, params
        self.levels = [node_level(i, int(d), params.scaling_factor) for i, d in enumerate(ids)]
        self.edges: list[dict[int, list[int]]] = [{} for _ in range(max(self.levels, default=0) + 1)]
        self.entry = 0 if len(ids) else None

    def limit(self, level: int) -> int:
        return self.p.max_neighbors * (2 if level == 0 else 1)

    def score(self, nodes: list[int], q: np.ndarray) -> list[float]:
        return scores(self.metric, self.x[nodes], q).astype(np.float32).tolist()

    def key(self, node: int, s: float) -> tuple[float, int]:
        return (-s, int(self.ids[node]))

    def descend(self, q: np.ndarray, at: int, high: int, low: int) -> int:
        """Greedily to a local best on each level from high down to low + 1."""
        best = self.key(at, self.score([at], q)[0])
        for level in range(high, low, -1):
            moved = True
            while moved:
                moved = False
                near = self.edges[level].get(at, [])
                for n, s in zip(near, self.score(near, q) if near else [], strict=True):
                    if self.key(n, s) < best:
                        at, best, moved = n, self.key(n, s), True
        return at

    def search_layer(self, q: np.ndarray, at: int, level: int, limit: int, live: np.ndarray | None = None) -> list[tuple[float, int]]:
        """(key, node) of up to `limit` best nodes found, best first. Nodes that are not live lead on, but are not found."""
        first = (self.key(at, self.score([at], q)[0]), at)
        seen, frontier, found = {at}, [first], [(-first[0][0], -first[0][1], at)] if live is None or live[at] else []
        while frontier:
            key, node = heapq.heappop(frontier)
            if len(found) >= limit and -key[0] < found[0][0]:
                break
            near = [n for n in self.edges[level].get(node, []) if n not in seen]
            seen.update(near)
            for n, s in zip(near, self.score(near, q) if near else [], strict=True):
                k = self.key(n, s)
                if len(found) < limit or (-k[0], -k[1]) > found[0][:2]:
                    heapq.heappush(frontier, (k, n))
                    if live is not None and not live[n]:
                        continue
                    heapq.heappush(found, (-k[0], -k[1], n))
                    if len(found) > limit:
                        heapq.heappop(found)
        return sorted(((-a, -b), n) for a, b, n in found)

    def prune(self, node: int, candidates: list[int], level: int) -> list[int]:
        """Diverse neighbours: a candidate goes in if no chosen one is at least as near to it as the node; then a fill-up."""
        q = self.x[node]
        ranked = sorted((self.key(c, s), c) for c, s in zip(candidates, self.score(candidates, q), strict=True))[: self.p.prune_width] if candidates else []
        limit, chosen = self.limit(level), []
        for key, c in ranked:
            if len(chosen) >= limit:
                break
            if all(s < -key[0] for s in (self.score(chosen, self.x[c]) if chosen else [])):
                chosen.append(c)
        for _, c in ranked:
            if len(chosen) >= min(self.p.min_neighbor_count, limit):
                break
            if c not in chosen:
                chosen.append(c)
        return chosen

    def insert(self, node: int) -> None:
        if node == 0:
            return
        own, top, q = self.levels[node], self.levels[self.entry], self.x[node]
        at = self.descend(q, self.entry, top, own)
        planned = []
        for level in range(min(own, top), -1, -1):
            width = max(self.limit(level), self.p.ef_construction, self.p.prune_width)
            found = self.search_layer(q, at, level, width)
            at = found[0][1]
            planned.append((level, self.prune(node, [n for _, n in found], level)))
        for level, chosen in planned:
            for n in chosen:
                back = self.edges[level].setdefault(n, [])
                if node not in back:
                    self.edges[level][n] = self.prune(n, [*back, node], level)
            self.edges[level][node] = chosen
        if own > top:
            self.entry = node

    def build(self) -> Graph:
        for node in range(len(self.ids)):
            self.insert(node)
        return self

    def search(self, q: np.ndarray, k: int, ef: int, live: np.ndarray | None = None) -> list[tuple[int, float]]:
        """(internal id, score) of live nodes, score descending, id ascending."""
        if not len(self.ids):
            return []
        q = q.astype(np.float64)
        top = max(self.levels)
        at = max(i for i, n in enumerate(self.levels) if n == top)
        at = self.descend(q, at, top, 0)
        found = self.search_layer(q, at, 0, min(len(self.ids), max(k, ef)), live)
        return [(int(self.ids[n]), -key[0]) for key, n in found[:k]]

    def table(self) -> list[tuple[int, int, int]]:
        return [(level, int(self.ids[a]), int(self.ids[b])) for level, edges in enumerate(self.edges) for a, near in sorted(edges.items()) for b in near]

    def check(self) -> None:
        """Structural checks of a graph that was loaded or built."""
        n = len(self.ids)
        for level, edges in enumerate(self.edges):
            for a, near in edges.items():
                if not 0 <= a < n or self.levels[a] < level:
                    raise ValueError("a node has edges above its level")
                if len(near) > self.limit(level) or len(set(near)) != len(near) or a in near:
                    raise ValueError("bad neighbour list")
                if any(not 0 <= b < n or self.levels[b] < level for b in near):
                    raise ValueError("an edge leads to a node below its level")


def build_edges(segments: DataFrame, metric: str, params: HnswParams) -> DataFrame:
    """(segment_id, _doc_id, vector) -> (segment_id, level, a, b): one task per segment."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_doc_id")
        g = Graph(metric, np.stack(pdf["vector"].to_list()), pdf["_doc_id"].to_numpy(), params).build()
        rows = g.table()
        return pd.DataFrame({"segment_id": [int(pdf["segment_id"].iloc[0])] * len(rows), "level": [r[0] for r in rows], "a": [r[1] for r in rows], "b": [r[2] for r in rows]})

    return segments.select("segment_id", "_doc_id", "vector").groupBy("segment_id").applyInPandas(one, "segment_id long, level int, a long, b long")
