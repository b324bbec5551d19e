"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors of cosine >= c lie within squared distance t = 2 - 2c. A random rotation spreads a vector's length evenly over
its parts; the parts are split into blocks of BLOCK_DIMS. If every block differed by more than its proportional share of t,
the whole would differ by more than t: so linked vectors lie within the share of some block. Each block is range-joined:
its first GRID_DIMS coordinates make grid cells, a vector is at home in one cell and visits all that its radius touches (on
evenly spread vectors, more dimensions prune little and send each vector to more cells).
Within a cell, boxes around ever fewer homes rule out visitors; what is left is tested by the block's distance and verified exactly; a link found in several blocks counts in
the first. Cells emit sums and a spanning forest of their links, never all pairs. Large cells are split into chunks of
homes and of visitors, and equal vectors are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinion.llm.common import cut, join_hot, table
from pinion.llm.components import components
from pinion.llm.vectors import all_vectors, matrix, unit

COSINE, BLOCK_DIMS, GRID_DIMS, CELL = 0.95, 16, 1, 3.2
#: Homes and visitors of one task, at most about.
HOMES, VISITORS = 32_768, 65_536
TILE = 8192
#: Homes that are tested side by side, and what single precision may add to a squared distance.
LEAF, SLACK = 128, 1e-5


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


class Blocks:
    """The blocks of d dimensions, with their shares of the squared distance."""

    def __init__(self, d: int, cosine: float):
        self.rotation, self.cosine = rotation(d), cosine
        count = max(1, round(d / BLOCK_DIMS))
        edges = [round(i * d / count) for i in range(count + 1)]
        self.spans = list(zip(edges, edges[1:], strict=False))
        total = max(0.0, 2 - 2 * cosine)
        self.budget = [total * (b - a) / d + 1e-9 for a, b in self.spans]

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("ij,jk->ik", unit(x), self.rotation)  # row by row: the same result in every batch

    def cells(self, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, cells and whether the row is at home there, for block k."""
        a, b = self.spans[k]
        reach = np.sqrt(self.budget[k])
        width, dims = CELL * reach, min(GRID_DIMS, b - a)
        side = int(2 / width) + 3
        rows, cell, home = np.arange(len(y)), np.zeros(len(y), np.int64), np.ones(len(y), bool)
        for j in range(dims):
            v = y[rows, a + j]
            own = np.floor(v / width)
            low, high = np.floor((v - reach) / width), np.floor((v + reach) / width)
            n = (high - low + 1).astype(np.int64)
            at = np.repeat(np.arange(len(rows)), n)
            c = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            rows, home, cell = rows[at], home[at] & (c == own[at]), cell[at] * side + (c + side // 2).astype(np.int64)
        return rows, cell, home


def spread(distinct: DataFrame, cosine: float, with_vectors: bool) -> DataFrame:
    """(id, n, vec) -> a row for each block and cell, or their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                b = Blocks(int(d), cosine)
                y = b.rotated(matrix(part.column(2)))
                for k in range(len(b.spans)):
                    rows, cell, home = b.cells(y, k)
                    if with_vectors:
                        take = part.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), d, np.int32)), pa.array(np.full(len(rows), k, np.int32)), pa.array(cell), pa.array(home), *take.columns], names=["d", "k", "cell", "home", "id", "n", "vec"])
                    else:
                        u, at = np.unique(cell, return_inverse=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), d, np.int32)), pa.array(np.full(len(u), k, np.int32)), pa.array(u), pa.array(np.bincount(at, home, len(u)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(u)))], names=["d", "k", "cell", "homes", "visitors"])

    return distinct.select("id", "n", "vec").mapInArrow(run, "d int, k int, cell long, " + ("home boolean, id long, n long, vec " + distinct.schema["vec"].dataType.simpleString() if with_vectors else "homes long, visitors long"))


def near(part: np.ndarray, homes: np.ndarray, visitors: np.ndarray, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Few homes at a time with the visitors that may lie within the squared distance `most` of one of them.

    Homes are split at the median of the dimension in which they spread most; a visitor that is further from the box around
    homes than that is near none of them, and is not looked at below.
    """
    todo = [(homes, visitors)] if len(homes) else []
    while todo:
        hs, vs = todo.pop()
        own = part[hs]
        low, high = own.min(0), own.max(0)
        x = part[vs]
        x -= np.clip(x, low, high)
        vs = vs[np.einsum("ij,ij->i", x, x) <= most]
        if not len(vs):
            continue
        if len(hs) <= LEAF:
            yield hs, vs
            continue
        half = len(hs) // 2
        by = np.argpartition(own[:, np.argmax(own.var(0))], half)
        todo += [(hs[by[:half]], vs), (hs[by[half:]], vs)]


def cell_links(t: pa.Table, cosine: float) -> pa.Table:
    """Of one chunk of a cell: (a, b, edge) with the copies linked to each home, and the edges of a spanning forest."""
    d, k = t.column("d")[0].as_py(), t.column("k")[0].as_py()
    as_home, as_visitor, ids, n = (t.column(c).to_numpy() for c in ("as_home", "as_visitor", "id", "n"))
    b = Blocks(d, cosine)
    x = unit(matrix(t.column("vec")))
    y = np.einsum("ij,jk->ik", x, b.rotation)
    lo, hi = b.spans[k]
    h, v = np.flatnonzero(as_home), np.flatnonzero(as_visitor)
    total, place = np.zeros(len(h), np.int64), np.cumsum(as_home) - 1
    root = np.arange(len(t))  # a union-find over the rows of this chunk
    edges: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    part = y[:, lo:hi].astype(np.float32)
    size, one = np.einsum("ij,ij->i", part, part)[:, None], np.ones((len(part), 1), np.float32)
    left, right = np.hstack([-2 * part, size, one]), np.hstack([part, one, size])  # a row of each gives the squared distance
    for hs, near_by in near(part, h, v, b.budget[k] + SLACK):
        for w in range(0, len(near_by), TILE):
            vs = near_by[w : w + TILE]
            i, j = np.divmod(np.flatnonzero((left[hs] @ right[vs].T).ravel() <= b.budget[k] + SLACK), len(vs))
            for z in range(0, len(i), 200_000):
                p, q = hs[i[z : z + 200_000]], vs[j[z : z + 200_000]]
                ok = (np.einsum("ij,ij->i", x[p], x[q]) >= cosine) & (ids[p] != ids[q])
                p, q, own = p[ok], q[ok], i[z : z + 200_000][ok]
                diff = (y[p] - y[q]) ** 2
                mine = diff[:, lo:hi].sum(1) <= b.budget[k]
                for e in range(k):  # an earlier block that holds the pair counts it
                    first, last = b.spans[e]
                    mine &= diff[:, first:last].sum(1) > b.budget[e]
                p, q, own = p[mine], q[mine], own[mine]
                total[place[hs]] += np.bincount(own, n[q], len(hs)).astype(np.int64)
                for u, o in zip(p.tolist(), q.tolist(), strict=True):
                    if root[u] != root[o] and (ru := find(u)) != (ro := find(o)):
                        root[ru] = ro
                        edges.append((ids[u], ids[o]))
    some = total > 0
    a = np.concatenate([ids[h[some]], np.array([u for u, _ in edges], np.int64)])
    c = np.concatenate([total[some], np.array([o for _, o in edges], np.int64)])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(c, pa.int64()), "edge": pa.array(np.arange(len(a)) >= some.sum())})


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors that are null, empty, zero or not finite are linked with nothing, are their own components and are kept. Rows with a
    null id are left out of the join and come back with nulls. Vectors are compared with those of their own length. Rows that
    share a vector are copies, whatever their ids; rows that share an id are told apart by their vectors. An empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    every = all_vectors(vectors, id_col, vec_col)
    rows = every.where("valid").select("id", "vec")
    same = cut(rows.groupBy("vec").agg(F.min("id").alias("low"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    total = same.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    grid = spread(same, cosine, False).groupBy("d", "k", "cell").agg(F.sum("homes").alias("homes"), F.sum("visitors").alias("visitors")).where("homes > 0")
    grid = grid.select("d", "k", "cell", F.ceil(F.col("homes") / HOMES).cast("int").alias("hs"), F.ceil(F.col("visitors") / VISITORS).cast("int").alias("vs"))
    at = spread(same, cosine, True).join(F.broadcast(grid), ["d", "k", "cell"])  # at most (blocks) x (cells of the unit cube) rows
    at = at.withColumn("h", F.pmod(F.xxhash64("id"), "hs")).withColumn("v", F.pmod(F.xxhash64("id"), "vs"))
    col = ["d", "k", "cell", "id", "n", "vec"]
    whole = F.expr("home AND hs = 1 AND vs = 1")  # in a cell of one chunk a row at home is its own visitor
    visit = at.where(~whole).select(*col, F.lit(False).alias("as_home"), F.lit(True).alias("as_visitor"), F.explode(F.expr("sequence(0L, hs - 1L)")).alias("h"), "v")
    own = at.where("home").select(*col, F.lit(True).alias("as_home"), whole.alias("as_visitor"), "h", F.explode(F.expr("sequence(0L, vs - 1L)")).alias("v"))
    found = cut(visit.union(own).groupBy("d", "k", "cell", "h", "v").applyInArrow(lambda t: cell_links(t, cosine), "a long, b long, edge boolean"))
    links = found.where("NOT edge").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    labels = components(found.where("edge").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    of = cut(same.join(links, "id", "left").join(labels, "id", "left").select("vec", "low", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("root")))
    least = of.groupBy("root").agg(F.min("low").alias("component_id"))
    of = of.join(least, "root").select("vec", "n", "n_links", "component_id")
    found = join_hot(rows, of, "vec", "n", total).select("id", "n_links", "component_id")
    alone = every.where("NOT valid").select("id", F.when(F.col("id").isNotNull(), F.lit(0).cast("long")), "id")
    out = found.union(alone).select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id")
    return out.withColumn("kept", F.col("component_id") == F.col(id_col))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, embedding::double[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(id, dst) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.dst = l.a),
least AS (SELECT id, min(dst) AS low FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::bigint AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least ON vec_id = id LEFT JOIN counts ON vec_id = a
"""
