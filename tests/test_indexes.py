import numpy as np
import pytest

from pinion.functions.metrics import scores
from pinion.operators import ivf
from pinion.operators.hnsw import Graph, node_level
from pinion.schema import COSINE, INNER_PRODUCT, L2, HnswParams, IvfParams


def brute(metric, x, ids, q, k):
    s = scores(metric, x, q)
    return [int(ids[i]) for i in np.lexsort((ids, -s))[:k]]


def test_metrics():
    x, q = np.array([[3.0, 4.0], [0.0, 0.0]]), np.array([3.0, 4.0])
    assert scores(COSINE, x, q).tolist() == [1.0, 0.0]
    assert scores(INNER_PRODUCT, x, q).tolist() == [25.0, 0.0]
    assert scores(L2, x, q).tolist() == [0.0, -5.0]


@pytest.mark.parametrize("metric", [L2, INNER_PRODUCT])
def test_bounded_probing_is_exact(metric):
    rng = np.random.default_rng(5)
    for _ in range(200):
        n, d = int(rng.integers(1, 40)), int(rng.integers(1, 4))
        x, q = rng.integers(-3, 4, (n, d)).astype(float), rng.integers(-3, 4, d).astype(float)
        ids = rng.permutation(n) + 1
        index = ivf.train(metric, x, IvfParams(int(rng.integers(1, 9)), 1, 3))
        k = int(rng.integers(1, 6))
        assert [i for i, _ in ivf.search(index, x, ids, q, k, 1)] == brute(metric, x, ids, q, k)


def test_cosine_probes_exactly_so_many_lists():
    x = np.array([[1.0, 0], [0.9, 0.1], [0, 1.0], [0.1, 0.9]])
    index = ivf.train(COSINE, x, IvfParams(2, 1, 4))
    assert [i for i, _ in ivf.search(index, x, np.array([1, 2, 3, 4]), np.array([1.0, 0]), 4, 1)] == [1, 2]


def test_seeding_and_empty():
    index = ivf.train(L2, np.array([[0.0], [1], [10], [11]]), IvfParams(2, 1, 1))
    assert sorted(np.bincount(index.lists).tolist()) == [2, 2]
    x = np.array([[1.0], [0], [2], [3]])
    index = ivf.train(L2, x, IvfParams(2, 1, 4))
    assert sum(((x[i] - index.centroids[index.lists[i]]) ** 2).sum() for i in range(4)) == 1.0
    assert ivf.search(ivf.train(L2, np.empty((0, 2)), IvfParams()), np.empty((0, 2)), np.empty(0, int), np.zeros(2), 3, 1) == []


class Slow:
    """The layered graph once more, after its published description: sorted lists, no heaps, one score at a time."""

    def __init__(self, x, ids, p):
        self.x, self.ids, self.p = x, ids, p
        self.level = [node_level(i, int(d), p.scaling_factor) for i, d in enumerate(ids)]
        self.near = {(lv, n): [] for n in range(len(ids)) for lv in range(self.level[n] + 1)}
        self.entry = 0
        for n in range(1, len(ids)):
            self.add(n)

    def key(self, n, q):
        return -float(np.float32(scores(COSINE, self.x[[n]], q)[0])), int(self.ids[n])

    def walk(self, q, at, level):
        while (step := min([at, *self.near.get((level, at), [])], key=lambda n: self.key(n, q))) != at:
            at = step
        return at

    def layer(self, q, at, level, width):
        seen, todo, best = {at}, [at], [at]
        while todo:
            c = min(todo, key=lambda n: self.key(n, q))
            todo.remove(c)
            if len(best) >= width and self.key(c, q)[0] > self.key(best[-1], q)[0]:
                break
            for n in self.near.get((level, c), []):
                if n not in seen:
                    seen.add(n)
                    if len(best) < width or self.key(n, q) < self.key(best[-1], q):
                        todo.append(n)
                        best = sorted([*best, n], key=lambda m: self.key(m, q))[:width]
        return best

    def diverse(self, n, found, level):
        q, limit = self.x[n], self.p.max_neighbors * (1 if level else 2)
        ranked = sorted(found, key=lambda m: self.key(m, q))[: self.p.prune_width]
        out = []
        for c in ranked:
            if len(out) < limit and all(-self.key(o, self.x[c])[0] < -self.key(c, q)[0] for o in out):
                out.append(c)
        for c in ranked:
            if len(out) < min(self.p.min_neighbor_count, limit) and c not in out:
                out.append(c)
        return out

    def add(self, n):
        q, top, at = self.x[n], self.level[self.entry], self.entry
        for lv in range(top, self.level[n], -1):
            at = self.walk(q, at, lv)
        plan = {}
        for lv in range(min(top, self.level[n]), -1, -1):
            found = self.layer(q, at, lv, max(self.p.max_neighbors * (1 if lv else 2), self.p.ef_construction, self.p.prune_width))
            at, plan[lv] = found[0], self.diverse(n, found, lv)
        for lv, chosen in plan.items():
            for m in chosen:  # a neighbour weighs all it has anew
                self.near[lv, m] = self.diverse(m, [*self.near[lv, m], n], lv)
            self.near[lv, n] = chosen
        if self.level[n] > top:
            self.entry = n


@pytest.mark.parametrize("params", [(2, 2, 4, 2, 1, 3), (3, 3, 6, 4, 2, 4), (4, 2, 10, 8, 4, 10), (1, 50, 1, 1, 1, 1)])
def test_graph_equals_a_slow_build(params):
    rng = np.random.default_rng(sum(params))
    x, ids = rng.normal(size=(60, 5)), rng.permutation(60) + 1
    g, slow = Graph(COSINE, x, ids, HnswParams(*params)).build(), Slow(x, ids, HnswParams(*params))
    g.check()
    assert {(lv, n): near for lv, e in enumerate(g.edges) for n, near in e.items() if near} == {k: v for k, v in slow.near.items() if v}


def test_deleted_nodes_lead_on_but_are_not_found():
    rng = np.random.default_rng(3)
    x, ids = rng.normal(size=(120, 6)), np.arange(1, 121)
    g = Graph(COSINE, x, ids, HnswParams()).build()
    live = rng.random(120) < 0.3
    for q in rng.normal(size=(10, 6)):
        assert [i for i, _ in g.search(q, 5, 120, live)] == brute(COSINE, x[live], ids[live], q, 5)
    assert g.search(x[0], 3, 10, np.zeros(120, bool)) == []


def test_graph_ties_and_recall():
    g = Graph(INNER_PRODUCT, np.array([[1.0, 0], [1.0, 0]]), np.array([2, 1]), HnswParams()).build()
    assert [i for i, _ in g.search(np.array([1.0, 0]), 2, 2)] == [1, 2]
    rng = np.random.default_rng(0)
    x, ids = rng.normal(size=(150, 8)), np.arange(1, 151)
    g = Graph(COSINE, x, ids, HnswParams()).build()
    g.check()
    assert max(g.levels) == max(node_level(i, i + 1, 50) for i in range(150))
    for q in rng.normal(size=(10, 8)):
        assert [i for i, _ in g.search(q, 5, 150)] == brute(COSINE, x, ids, q, 5)
